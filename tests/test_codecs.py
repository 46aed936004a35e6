import zlib

import numpy as np
import pytest

from ndgrid.bench.fixtures import blosc_container
from ndgrid.functions import blosc, checksums
from ndgrid.functions.codecs import BitRound, Chain, Checksum, Delta, FixedScaleOffset, Shuffle, make
from ndgrid.functions.filters import shuffle_bytes as shuffle_column

BYTES = ["zstd", "lz4", "gzip", "zlib", "crc32c", "ndgrid.balanced", "ndgrid.bitpack", "ndgrid.cascaded", "ndgrid.snappy", "ndgrid.deflate", "ndgrid.gdeflate"]


def _payloads():
    rng = np.random.default_rng(7)
    sparse = np.zeros((128, 128), dtype=np.uint8)
    sparse[::8, ::8] = 42
    return [b"", b"\x00", rng.integers(0, 255, 4096, dtype=np.uint8).tobytes(), sparse.tobytes(), np.arange(4096, dtype="<i4").tobytes()]


@pytest.mark.parametrize("name", BYTES)
def test_byte_codecs_round_trip(name):
    codec = make({"name": name})
    for data in _payloads():
        assert codec.decode(codec.encode(data), len(data)) == data
    batch = [data or None for data in _payloads()]
    assert codec.decode_batch(codec.encode_batch(batch)) == batch


def test_crc32c_known_values():
    assert checksums.crc32c(b"123456789") == 0xE3069283
    assert checksums.crc32c(bytes(32)) == 0x8A9136AA
    assert checksums.crc32c(b"") == 0


@pytest.mark.parametrize("n", [0, 1, 3, 1000, 70_001])
def test_adler32_is_zlibs(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    assert checksums.adler32(data) == zlib.adler32(data)


def test_damage_is_found():
    codec = make({"name": "crc32c"})
    data = bytearray(codec.encode(b"some bytes of a chunk"))
    data[3] ^= 1
    with pytest.raises(Exception):
        codec.decode(bytes(data))


@pytest.mark.parametrize("width", [2, 4, 8])
def test_shuffles_are_inverse(width):
    data = np.random.default_rng(0).integers(0, 256, 64 * width, dtype=np.uint8).tobytes()
    assert blosc.unshuffle_bytes(blosc.shuffle_bytes(data, width), width) == data
    assert blosc.unshuffle_bits(blosc.shuffle_bits(data, width), width) == data
    want = np.frombuffer(data, np.uint8).reshape(-1, width).T.tobytes()
    assert blosc.shuffle_bytes(data, width) == want == Shuffle(elementsize=width).encode(data)


@pytest.mark.parametrize("shuffle", [None, "byte", "bit"])
@pytest.mark.parametrize("dtype", ["<f2", "<u4"])
def test_blosc_containers(shuffle, dtype):
    data = np.random.default_rng(0).integers(0, 1000, 65536).astype(dtype).tobytes()
    width = np.dtype(dtype).itemsize
    assert blosc.decode(blosc_container(data, width, 32768, shuffle)) == data


def test_delta_is_exact_for_ints():
    x = np.random.default_rng(0).integers(-1000, 1000, (16, 16)).astype("int32")
    d = Delta(dtype="int32")
    assert np.array_equal(d.decode(d.encode(x.ravel())).reshape(x.shape), x)


def test_fixed_scale_offset_is_close():
    x = (np.random.default_rng(0).standard_normal(256) * 100).astype("float32")
    f = FixedScaleOffset(offset=10, scale=0.5, dtype="float32", astype="int32")
    assert np.abs(f.decode(f.encode(x)) - x).max() <= 1 + 1e-4


@pytest.mark.parametrize(("dtype", "bits", "keep"), [("float32", 23, 10), ("float32", 23, 15), ("float64", 52, 12), ("float64", 52, 30)])
def test_bitround_bounds_and_ties(dtype, bits, keep):
    x = (np.random.default_rng(42).standard_normal(2048) * 100).astype(dtype)
    y = BitRound(keepbits=keep).encode(x)
    assert np.abs((y - x) / x).max() <= 2.0**-keep
    assert not (y.view(f"u{x.itemsize}") & ((1 << (bits - keep)) - 1)).any()
    # Halfway cases go to the even neighbour.
    one = np.array([1.0], dtype=dtype).view(f"u{x.itemsize}")[0]
    half = 1 << (bits - keep - 1)
    ties = np.array([one + half, one + 3 * half], dtype=f"u{x.itemsize}").view(dtype)
    assert BitRound(keepbits=keep).encode(ties).view(f"u{x.itemsize}").tolist() == [one, one + 4 * half]


def test_bitround_rejects_ints():
    with pytest.raises(TypeError):
        BitRound(keepbits=10).encode(np.arange(4, dtype="int32"))


def test_chain():
    x = np.arange(192, dtype="uint16").reshape(16, 12) % 251
    chain = Chain([{"name": "shuffle", "configuration": {"elementsize": 2}}, {"name": "zstd"}, {"name": "crc32c"}], "uint16", x.shape)
    assert np.array_equal(chain.decode(chain.encode(x)).reshape(x.shape), x)


def _stored_frame(data: bytes) -> bytes:
    """A zstd frame by the format's description, with one block that is not compressed: magic number, a one-byte size, block."""
    assert 0 < len(data) < 256
    return bytes.fromhex("28b52ffd") + bytes([0x20, len(data)]) + (len(data) << 3 | 1).to_bytes(3, "little") + data


def test_blosc_containers_by_hand():
    """Containers put together byte by byte from the format's description, not by a writer of ours."""
    head = lambda flags, width, n, block, size: bytes([2, 1, flags, width]) + b"".join(x.to_bytes(4, "little") for x in (n, block, size))
    plain = b"abcdefgh"
    assert blosc.decode(head(0x02, 1, 8, 8, 24) + plain) == plain  # copied as it is
    assert blosc.decode(head(0x80, 1, 0, 8, 16)) == b""
    frame = _stored_frame(plain)
    stream = len(frame).to_bytes(4, "little") + frame
    assert blosc.decode(head(0x90, 1, 8, 8, 20 + len(stream)) + (20).to_bytes(4, "little") + stream) == plain
    # Byte shuffle, width 4: first bytes of both elements, then second ones.
    assert blosc.decode(head(0x91, 4, 8, 8, 20 + len(stream)) + (20).to_bytes(4, "little") + stream) == b"acegbdfh"
    # Bit shuffle, width 1: plane k has bit k of the eight elements, the first element lowest.
    bits = bytes([0b00000011, 0, 0, 0, 0, 0, 0, 0b10000000])
    frame = _stored_frame(bits)
    stream = len(frame).to_bytes(4, "little") + frame
    assert blosc.decode(head(0x94, 1, 8, 8, 20 + len(stream)) + (20).to_bytes(4, "little") + stream) == bytes([1, 1, 0, 0, 0, 0, 0, 0x80])
    with pytest.raises(NotImplementedError):
        blosc.decode(head(0x10, 1, 8, 8, 20 + len(stream)) + (20).to_bytes(4, "little") + stream)


@pytest.mark.parametrize("name", ["ndgrid.balanced", "ndgrid.snappy", "ndgrid.deflate"])
def test_checksum_policies(name):
    data, of = bytes(range(200)), lambda p: make({"name": name, "configuration": {"checksum_policy": p}})
    for write in Checksum:
        raw = of(write.value).encode(data)
        damaged = raw[:9] + bytes([raw[9] ^ 1]) + raw[10:]
        for read in Checksum:
            reader = of(read.value)
            needs = read in (Checksum.VERIFY_IF_PRESENT, Checksum.COMPUTE_AND_VERIFY_IF_PRESENT, Checksum.COMPUTE_AND_VERIFY)
            if read is Checksum.COMPUTE_AND_VERIFY and not write.computes:
                with pytest.raises(ValueError):
                    reader.decode(raw)
                continue
            assert reader.decode(raw) == data
            if needs and write.computes:
                with pytest.raises(ValueError):
                    reader.decode(damaged)
            else:
                assert reader.decode(damaged) == data


def test_documents_and_sizes():
    for name in BYTES:
        codec = make(name)
        again = make(codec.to_dict() | {"extra": 1})
        assert again == codec and make({"name": name, **codec.to_dict()["configuration"], "unknown": 3}) == codec
    assert make("crc32c").encoded_size(10) == 14 and make("shuffle").encoded_size(8) == 8
    assert FixedScaleOffset(dtype="float64", astype="int16").encoded_size(80) == 20
    with pytest.raises(NotImplementedError):
        make("zstd").encoded_size(4)
    with pytest.raises(NotImplementedError):
        make("nothing")
    with pytest.raises(NotImplementedError):
        make("blosc").encode(b"x")


def test_shuffle_in_sql_is_the_codecs(spark):
    rows = [(np.random.default_rng(i).integers(0, 256, 8 * i, dtype=np.uint8).tobytes(),) for i in range(6)] + [(None,)]
    frame = spark.createDataFrame(rows, "b binary")
    for width in (2, 4, 8):
        got = frame.select("b", shuffle_column(frame.b, width, "sql").alias("x"), shuffle_column(frame.b, width, "udf").alias("y")).collect()
        assert all(r.x == r.y for r in got)
    with pytest.raises(ValueError):
        shuffle_column(frame.b, 4, "gpu")


def test_zstd_contexts_are_kept_by_thread():
    from concurrent.futures import ThreadPoolExecutor

    from ndgrid.functions.codecs import _zstd

    assert _zstd("decompressor") is _zstd("decompressor") and _zstd("compressor", 3) is not _zstd("compressor", 4)
    with ThreadPoolExecutor(1) as pool:
        assert pool.submit(_zstd, "decompressor").result() is not _zstd("decompressor")

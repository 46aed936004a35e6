"""Codecs of chunk payloads, and chains of them.

Filters turn arrays into arrays, the ``bytes`` serializer arrays into bytes, compressors bytes into bytes. The codecs
with a public bit stream (zstd, lz4, gzip, zlib, blosc, shuffle, crc32c, delta, fixedscaleoffset, bitround) carry
their usual names. Those in the ``ndgrid.`` namespace play the part of vendor formats that have no public
description: they round-trip here and claim no compatibility with anything else.
"""

from __future__ import annotations

import enum
import gzip
import math
import struct
import threading
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, fields

import numpy as np

from ndgrid.functions import blosc as _blosc
from ndgrid.functions.checksums import crc32c
from ndgrid.plans.meta import codec_configuration

REGISTRY: dict[str, type[Codec]] = {}


class Checksum(enum.Enum):
    """What an ``ndgrid.`` codec does with a CRC-32C of the decoded bytes."""

    NONE = "none"
    COMPUTE = "compute"
    COMPUTE_AND_VERIFY = "compute_and_verify"
    VERIFY_IF_PRESENT = "verify_if_present"
    COMPUTE_AND_VERIFY_IF_PRESENT = "compute_and_verify_if_present"

    @property
    def computes(self) -> bool:
        return self.value.startswith("compute")

    @property
    def verifies(self) -> bool:
        return "verify" in self.value


class Codec:
    """``name`` on disk; dataclass fields are its configuration. Unknown keys of a configuration are dropped."""

    name = ""

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        if cls.name:
            REGISTRY[cls.name] = cls

    def to_dict(self) -> dict:
        return {"name": self.name, "configuration": self._configuration()}

    def _configuration(self) -> dict:
        return {k: v.value if isinstance(v, enum.Enum) else v for k, v in asdict(self).items()}

    @classmethod
    def from_dict(cls, data: dict) -> Codec:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in codec_configuration(data).items() if k in known})


class Compressor(Codec):
    """bytes -> bytes, one chunk at a time; the batch forms keep None in its place."""

    def encode(self, data: bytes) -> bytes:
        raise NotImplementedError

    def decode(self, data: bytes, nbytes: int | None = None) -> bytes:
        raise NotImplementedError

    def encode_batch(self, chunks: Iterable[bytes | None]) -> list[bytes | None]:
        return [None if c is None else self.encode(c) for c in chunks]

    def decode_batch(self, chunks: Iterable[bytes | None], nbytes: int | None = None) -> list[bytes | None]:
        return [None if c is None else self.decode(c, nbytes) for c in chunks]

    def encoded_size(self, nbytes: int) -> int:
        raise NotImplementedError("the size of compressed bytes is not known before")


_own = threading.local()


def _zstd(part: str, level: int = 0, checksum: bool = False):
    """A thread's compressor of a level, or its decompressor: their contexts take longer to make than a small chunk."""
    import zstandard

    held = _own.__dict__.setdefault("zstd", {})
    key = (part, level, checksum)
    if key not in held:
        held[key] = zstandard.ZstdDecompressor() if part == "decompressor" else zstandard.ZstdCompressor(level=level, write_checksum=checksum)
    return held[key]


@dataclass(frozen=True)
class Zstd(Compressor):
    level: int = 0
    checksum: bool = False
    name = "zstd"

    def encode(self, data):
        return _zstd("compressor", self.level, self.checksum).compress(data)

    def decode(self, data, nbytes=None):
        return _zstd("decompressor").decompressobj().decompress(data)


@dataclass(frozen=True)
class LZ4(Compressor):
    """A block with its decoded size before it, 4 bytes, little-endian."""

    acceleration: int = 1
    name = "lz4"

    def encode(self, data):
        import pyarrow as pa

        return struct.pack("<I", len(data)) + (pa.compress(data, codec="lz4_raw", asbytes=True) if data else b"")

    def decode(self, data, nbytes=None):
        import pyarrow as pa

        (size,) = struct.unpack_from("<I", data)
        return pa.decompress(data[4:], size, codec="lz4_raw", asbytes=True) if size else b""


@dataclass(frozen=True)
class Gzip(Compressor):
    level: int = 5
    name = "gzip"

    def encode(self, data):
        return gzip.compress(data, compresslevel=self.level, mtime=0)

    def decode(self, data, nbytes=None):
        return gzip.decompress(data)


@dataclass(frozen=True)
class Zlib(Compressor):
    level: int = 5
    name = "zlib"

    def encode(self, data):
        return zlib.compress(data, self.level)

    def decode(self, data, nbytes=None):
        return zlib.decompress(data)


@dataclass(frozen=True)
class Blosc(Compressor):
    """Read only."""

    cname: str = "zstd"
    clevel: int = 5
    shuffle: str = "noshuffle"
    typesize: int = 4
    blocksize: int = 0
    name = "blosc"

    def encode(self, data):
        raise NotImplementedError("blosc is read, not written")

    def decode(self, data, nbytes=None):
        return _blosc.decode(data)


@dataclass(frozen=True)
class Crc32c(Compressor):
    """The payload and its CRC-32C, 4 bytes, little-endian. ``verify`` is a choice of the reader and not stored."""

    verify: bool = True
    name = "crc32c"

    def _configuration(self):
        return {}

    def encode(self, data):
        return data + struct.pack("<I", crc32c(data))

    def decode(self, data, nbytes=None):
        if self.verify and crc32c(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("crc32c of a chunk does not match")
        return data[:-4]

    def encoded_size(self, nbytes):
        return nbytes + 4


@dataclass(frozen=True)
class _Native(Compressor):
    """Decoded size, flag and CRC-32C stand before the body."""

    checksum_policy: Checksum = Checksum.NONE

    def __post_init__(self):
        object.__setattr__(self, "checksum_policy", Checksum(self.checksum_policy))

    def encode(self, data):
        flag = self.checksum_policy.computes
        return struct.pack("<QBI", len(data), flag, crc32c(data) if flag else 0) + self._pack(data)

    def decode(self, data, nbytes=None):
        size, flag, crc = struct.unpack_from("<QBI", data)
        out = self._unpack(data[13:], size)
        if self.checksum_policy.verifies:
            if flag and crc32c(out) != crc:
                raise ValueError(f"{self.name}: checksum does not match")
            if not flag and not self.checksum_policy.value.endswith("if_present"):
                raise ValueError(f"{self.name}: no checksum to verify")
        return out


@dataclass(frozen=True)
class Balanced(_Native):
    """An entropy coder's part: a general default."""

    name = "ndgrid.balanced"

    def _pack(self, data):
        return Zstd(1).encode(data)

    def _unpack(self, data, size):
        return Zstd().decode(data)


@dataclass(frozen=True)
class BitPack(_Native):
    """Fields of only the bits that the largest byte needs; ``algorithm_type`` 1 lists non-zero bytes instead."""

    algorithm_type: int = 0
    name = "ndgrid.bitpack"

    def _pack(self, data):
        a = np.frombuffer(data, dtype=np.uint8)
        if self.algorithm_type == 1:
            at = np.flatnonzero(a)
            return b"\x01" + Zstd(1).encode(struct.pack("<Q", len(at)) + np.diff(at, prepend=0).astype("<u4").tobytes() + a[at].tobytes())
        width = int(a.max()).bit_length() if len(a) else 0
        bits = np.unpackbits(a[:, None], axis=1, bitorder="little")[:, :width]
        return b"\x00" + bytes([width]) + np.packbits(bits.ravel(), bitorder="little").tobytes()

    def _unpack(self, data, size):
        out = np.zeros(size, dtype=np.uint8)
        if data[0] == 1:
            body = Zstd().decode(data[1:])
            (n,) = struct.unpack_from("<Q", body)
            out[np.cumsum(np.frombuffer(body, "<u4", n, 8).astype(np.int64))] = np.frombuffer(body, np.uint8, n, 8 + 4 * n)
        elif width := data[1]:
            bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=2), bitorder="little")[: size * width].reshape(size, width)
            out[:] = np.packbits(bits, axis=1, bitorder="little")[:, 0]
        return out.tobytes()


@dataclass(frozen=True)
class Cascaded(_Native):
    """Rounds of run lengths and byte differences, then bit packing."""

    num_rles: int = 2
    num_deltas: int = 1
    use_bitpack: bool = True
    name = "ndgrid.cascaded"

    def _pack(self, data):
        a, runs = np.frombuffer(data, dtype=np.uint8), []
        for i in range(max(self.num_rles, self.num_deltas)):
            if i < self.num_rles:
                first = np.flatnonzero(np.diff(a.astype(np.int16), prepend=-1)) if len(a) else np.zeros(0, np.int64)
                runs.append(np.diff(first, append=len(a)).astype("<u4").tobytes())
                a = a[first]
            if i < self.num_deltas:
                a = np.diff(a, prepend=np.uint8(0))
        body = BitPack()._pack(a.tobytes()) if self.use_bitpack else a.tobytes()
        head = struct.pack(f"<Q{len(runs)}Q", len(a), *map(len, runs))
        return Zstd(1).encode(head + b"".join(runs) + body)

    def _unpack(self, data, size):
        data = Zstd().decode(data)
        n, *lens = struct.unpack_from(f"<Q{self.num_rles}Q", data)
        at, runs = 8 * (1 + self.num_rles), []
        for k in lens:
            runs.append(np.frombuffer(data, "<u4", k // 4, at))
            at += k
        a = np.frombuffer(BitPack()._unpack(data[at:], n) if self.use_bitpack else data[at:], dtype=np.uint8)
        for i in reversed(range(max(self.num_rles, self.num_deltas))):
            if i < self.num_deltas:
                a = np.cumsum(a, dtype=np.uint8)
            if i < self.num_rles:
                a = np.repeat(a, runs[i])
        return a.tobytes()


@dataclass(frozen=True)
class Snappy(_Native):
    name = "ndgrid.snappy"

    def _pack(self, data):
        import pyarrow as pa

        return pa.compress(data, codec="snappy", asbytes=True)

    def _unpack(self, data, size):
        import pyarrow as pa

        return pa.decompress(data, size, codec="snappy", asbytes=True) if size else b""


@dataclass(frozen=True)
class Deflate(_Native):
    algorithm_type: int = 1
    name = "ndgrid.deflate"

    def _pack(self, data):
        c = zlib.compressobj(min(9, 1 + 2 * self.algorithm_type), zlib.DEFLATED, -15)
        return c.compress(data) + c.flush()

    def _unpack(self, data, size):
        return zlib.decompress(data, -15)


@dataclass(frozen=True)
class GDeflate(Deflate):
    """Deflate in independent tiles of 64 KiB."""

    name = "ndgrid.gdeflate"

    def _pack(self, data):
        tiles = [super(GDeflate, self)._pack(data[i : i + 65536]) for i in range(0, len(data), 65536)]
        return struct.pack(f"<I{len(tiles)}I", len(tiles), *map(len, tiles)) + b"".join(tiles)

    def _unpack(self, data, size):
        (n,) = struct.unpack_from("<I", data)
        at, out = 4 + 4 * n, []
        for k in struct.unpack_from(f"<{n}I", data, 4):
            out.append(zlib.decompress(data[at : at + k], -15))
            at += k
        return b"".join(out)


class Filter(Codec):
    """array -> array. ``stored`` is the dtype that it stores for arrays of a dtype."""

    def stored(self, dtype: np.dtype) -> np.dtype:
        return dtype

    def encoded_size(self, nbytes: int) -> int:
        return nbytes


@dataclass(frozen=True)
class Shuffle(Compressor):
    """Byte transpose of the whole chunk. It comes after the serializer."""

    elementsize: int = 4
    name = "shuffle"

    def encode(self, data):
        return _blosc.shuffle_bytes(data, self.elementsize)

    def decode(self, data, nbytes=None):
        return _blosc.unshuffle_bytes(data, self.elementsize)

    def encoded_size(self, nbytes):
        return nbytes


@dataclass(frozen=True)
class Delta(Filter):
    """The first element and then differences, over the chunk in C order; integers wrap."""

    dtype: str = "<f4"
    astype: str | None = None
    name = "delta"

    def stored(self, dtype):
        return np.dtype(self.astype or self.dtype)

    def encode(self, a: np.ndarray) -> np.ndarray:
        flat = a.astype(self.dtype, copy=False).ravel()
        out = flat.copy()
        with np.errstate(over="ignore"):
            out[1:] = flat[1:] - flat[:-1]
        return out.astype(self.stored(a.dtype)).reshape(a.shape)

    def decode(self, a: np.ndarray) -> np.ndarray:
        return np.cumsum(a.ravel().astype(self.dtype), dtype=self.dtype).reshape(a.shape)


@dataclass(frozen=True)
class FixedScaleOffset(Filter):
    """(x - offset) * scale, rounded half to even only if it is stored as integers."""

    offset: float = 0
    scale: float = 1
    dtype: str = "<f4"
    astype: str | None = None
    name = "fixedscaleoffset"

    def stored(self, dtype):
        return np.dtype(self.astype or self.dtype)

    def encode(self, a: np.ndarray) -> np.ndarray:
        x = (a.astype(self.dtype, copy=False) - self.offset) * self.scale
        to = self.stored(a.dtype)
        return (np.rint(x) if to.kind in "iu" else x).astype(to)

    def decode(self, a: np.ndarray) -> np.ndarray:
        x = a.astype(self.dtype) / self.scale + self.offset
        return (np.rint(x) if np.dtype(self.dtype).kind in "iu" else x).astype(self.dtype)

    def encoded_size(self, nbytes):
        return nbytes * np.dtype(self.astype or self.dtype).itemsize // np.dtype(self.dtype).itemsize


#: Mantissa bits of the floating-point formats.
MANTISSA = {"float16": 10, "float32": 23, "float64": 52}


@dataclass(frozen=True)
class BitRound(Filter):
    """Keeps the first ``keepbits`` mantissa bits, rounded half to even, by integer arithmetic on the bits."""

    keepbits: int = 12
    name = "bitround"

    def encode(self, a: np.ndarray) -> np.ndarray:
        if a.dtype.name not in MANTISSA:
            raise TypeError(f"bits of {a.dtype.name} are not rounded; only floating-point numbers are")
        drop = MANTISSA[a.dtype.name] - self.keepbits
        if drop <= 0:
            return a
        u = np.dtype(f"u{a.dtype.itemsize}").type
        bits = np.ascontiguousarray(a).view(u)
        odd = (bits >> u(drop)) & u(1)
        with np.errstate(over="ignore"):
            bits = bits + (u((1 << (drop - 1)) - 1) + odd)
        return (bits & ~u((1 << drop) - 1)).view(a.dtype)

    def decode(self, a: np.ndarray) -> np.ndarray:
        return a


@dataclass(frozen=True)
class Bytes(Codec):
    endian: str = "little"
    name = "bytes"


def make(codec: Codec | dict | str) -> Codec:
    """A codec from itself, its document or its name."""
    if isinstance(codec, Codec):
        return codec
    data = {"name": codec} if isinstance(codec, str) else codec
    if data.get("name") not in REGISTRY:
        raise NotImplementedError(f"codec {data.get('name')!r}")
    return REGISTRY[data["name"]].from_dict(data)


class Chain:
    """The codecs of an array in their order. ``encode`` takes an array of ``shape``, ``decode`` gives one."""

    def __init__(self, codecs: Iterable[Codec | dict | str], dtype, shape: tuple[int, ...]):
        self.dtype, self.shape = np.dtype(dtype), tuple(shape)
        made = [make(c) for c in codecs]
        self.filters = [c for c in made if isinstance(c, Filter)]
        self.compressors = [c for c in made if isinstance(c, Compressor)]
        self.order = next((c.endian for c in made if isinstance(c, Bytes)), "little")
        kinds = [0 if isinstance(c, Filter) else 1 if isinstance(c, Bytes) else 2 for c in made]
        if kinds != sorted(kinds):
            raise ValueError("filters come before the serializer and compressors after it")
        self.stored = [self.dtype]
        for f in self.filters:
            self.stored.append(f.stored(self.stored[-1]))

    def _wire(self) -> np.dtype:
        return self.stored[-1].newbyteorder("<" if self.order == "little" else ">")

    def encode(self, a: np.ndarray) -> bytes:
        a = np.ascontiguousarray(a, dtype=self.dtype)
        for f in self.filters:
            a = f.encode(a)
        data = np.ascontiguousarray(a, dtype=self._wire()).tobytes()
        for c in self.compressors:
            data = c.encode(data)
        return data

    def decode(self, data: bytes, name: object = "chunk") -> np.ndarray:
        return next(self.decode_batch([data], [name]))

    def decode_batch(self, payloads: list[bytes], names: list[object]) -> Iterator[np.ndarray]:
        """The arrays of several payloads, codec by codec for all of them up to the serializer."""
        for c in reversed(self.compressors):
            payloads = c.decode_batch(payloads)
        want = math.prod(self.shape) * self.stored[-1].itemsize
        for data, name in zip(payloads, names):
            if len(data) != want:
                raise ValueError(f"{name}: {len(data)} bytes decoded, {want} expected")
            a = np.frombuffer(data, dtype=self._wire()).astype(self.stored[-1], copy=False).reshape(self.shape)
            for f, dtype in zip(reversed(self.filters), reversed(self.stored[:-1])):
                a = f.decode(a).astype(dtype, copy=False)
            yield a

"""Reading blosc 1 containers whose blocks are zstd, with or without byte or bit shuffle."""

from __future__ import annotations

import struct

import numpy as np

_ZSTD = 4
_BYTE_SHUFFLE, _MEMCPY, _BIT_SHUFFLE = 0x01, 0x02, 0x04


def shuffle_bytes(data: bytes, width: int) -> bytes:
    """All first bytes of the elements, then all second ones, and so on."""
    if len(data) % width:
        raise ValueError(f"{len(data)} bytes are no whole number of elements of {width}")
    return np.frombuffer(data, dtype=np.uint8).reshape(-1, width).T.tobytes()


def unshuffle_bytes(data: bytes, width: int) -> bytes:
    if len(data) % width:
        raise ValueError(f"{len(data)} bytes are no whole number of elements of {width}")
    return np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T.tobytes()


def unshuffle_bits(data: bytes, width: int) -> bytes:
    """Undo a bit shuffle: plane k holds bit k of every element. The number of elements must divide by 8."""
    elements = len(data) // width
    if len(data) % width or elements % 8:
        raise ValueError(f"{elements} elements of {width} bytes are no whole number of planes")
    planes = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little").reshape(8 * width, elements)
    return np.packbits(planes.T.reshape(elements, 8 * width), axis=1, bitorder="little").tobytes()


def shuffle_bits(data: bytes, width: int) -> bytes:
    """The planes that :func:`unshuffle_bits` takes."""
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8).reshape(-1, width), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes()


def decode(data: bytes) -> bytes:
    """The bytes in a container. Blocks are decompressed one by one and unshuffled each on its own."""
    import zstandard

    flags, width = data[2], max(1, data[3])
    nbytes, block_size, _ = struct.unpack_from("<iii", data, 4)
    if nbytes == 0:
        return b""
    if flags & _MEMCPY:
        return data[16 : 16 + nbytes]
    if flags >> 5 != _ZSTD:
        raise NotImplementedError(f"blosc sub-codec {flags >> 5}; only zstd is read")
    n_blocks = -(-nbytes // block_size)
    out = []
    for i, at in enumerate(struct.unpack_from(f"<{n_blocks}i", data, 16)):
        want = min(block_size, nbytes - i * block_size)
        block = b""
        while len(block) < want:  # a block may be split into several streams
            (size,) = struct.unpack_from("<i", data, at)
            if size <= 0:
                raise ValueError(f"blosc stream of {size} bytes")
            part = data[at + 4 : at + 4 + size]
            block += zstandard.ZstdDecompressor().decompress(part, max_output_size=want) if part[:4] == b"\x28\xb5\x2f\xfd" else part
            at += 4 + size
        if flags & _BIT_SHUFFLE and width >= 1:
            whole = len(block) // (8 * width) * 8 * width  # what is left over is not shuffled
            block = unshuffle_bits(block[:whole], width) + block[whole:]
        elif flags & _BYTE_SHUFFLE and width > 1:
            whole = len(block) // width * width
            block = unshuffle_bytes(block[:whole], width) + block[whole:]
        out.append(block[:want])
    return b"".join(out)

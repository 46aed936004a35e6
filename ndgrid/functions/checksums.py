"""CRC-32C (Castagnoli) of byte strings, many lanes at a time in numpy; the zlib sums come with Python."""

from __future__ import annotations

import functools
import zlib

import numpy as np

#: Fixed value: the Castagnoli polynomial, bits reversed.
_POLY = 0x82F63B78
_LANES = 2048


@functools.cache
def _table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ (np.uint32(_POLY) * (x & np.uint32(1)))
    return x


def _apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A 32 by 32 bit matrix, as its 32 columns, times each of ``x``."""
    out = np.zeros_like(x)
    for i in range(32):
        out ^= matrix[i] * ((x >> np.uint32(i)) & np.uint32(1))
    return out


@functools.cache
def _skip(log2_bytes: int) -> np.ndarray:
    """The register after 2**log2_bytes zero bytes, as a matrix."""
    if log2_bytes == 0:
        x = np.uint32(1) << np.arange(32, dtype=np.uint32)
        return _table()[x & np.uint32(255)] ^ (x >> np.uint32(8))
    half = _skip(log2_bytes - 1)
    return _apply(half, half)


def _after_zeros(x: np.ndarray, n: int) -> np.ndarray:
    for i in range(n.bit_length()):
        if n >> i & 1:
            x = _apply(_skip(i), x)
    return x


def crc32c(data: bytes) -> int:
    """Lanes of equal length are stepped through together and then joined pairwise; the rest follows byte by byte."""
    a = np.frombuffer(data, dtype=np.uint8)
    table, width = _table(), len(a) // _LANES
    register = np.array([0xFFFFFFFF], dtype=np.uint32)
    if width >= 16:
        lanes = a[: width * _LANES].reshape(_LANES, width)
        x = np.zeros(_LANES, dtype=np.uint32)
        x[0] = 0xFFFFFFFF
        for i in range(width):
            x = table[(x ^ lanes[:, i]) & np.uint32(255)] ^ (x >> np.uint32(8))
        while len(x) > 1:
            x = _after_zeros(x[0::2], width) ^ x[1::2]
            width *= 2
        register, a = x, a[(len(a) // _LANES) * _LANES :]
    value = int(register[0])
    steps = table.tolist()
    for b in a.tolist():
        value = steps[(value ^ b) & 255] ^ (value >> 8)
    return value ^ 0xFFFFFFFF


def adler32(data: bytes) -> int:
    return zlib.adler32(data)

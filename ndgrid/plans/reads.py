"""From a box to the files and units it touches, and from a file's index to the bytes of its units. Needs no Spark.

Files and units are never listed for a whole box. A box is a grid of files, a task gets a run of their numbers, and
looks at sizes and shard indexes itself; within a file, units are rows of one integer array.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ndgrid.plans.coalesce import READ_FUSED_BYTES, Windows, fuse
from ndgrid.plans.meta import ABSENT, ArrayMeta
from ndgrid.plans.selection import Bounds

#: Runs of files that a box is dealt to, at most: the driver holds two numbers for each.
MAX_RUNS = 100_000


def cells_to_grid(bounds: Bounds, cell: tuple[int, ...]) -> Bounds:
    """The blocks of ``cell`` that a box touches, first and last + 1 on each axis; none where the box is empty."""
    return tuple((lo // k, -(-hi // k)) if hi > lo else (0, 0) for (lo, hi), k in zip(bounds, cell))


def grid_to_cells(grid: Bounds, cell: tuple[int, ...], shape: tuple[int, ...]) -> Bounds:
    """The cells of some blocks, cut at the array's edges."""
    return tuple((lo * k, min(hi * k, n)) for (lo, hi), k, n in zip(grid, cell, shape))


def grid_size(grid: Bounds) -> int:
    return math.prod(hi - lo for lo, hi in grid)


def grid_points(grid: Bounds) -> np.ndarray:
    """(points, axes): every point of a grid, the last axis fastest."""
    sides = [np.arange(lo, hi) for lo, hi in grid]
    return np.stack([x.ravel() for x in np.meshgrid(*sides, indexing="ij")], axis=1) if sides else np.zeros((1, 0), dtype=np.int64)


def selected_units(meta: ArrayMeta, bounds: Bounds) -> np.ndarray:
    """(units, axes): the units that a box touches."""
    return grid_points(cells_to_grid(bounds, meta.unit_shape))


def unit_box(meta: ArrayMeta, coords: tuple[int, ...]) -> Bounds:
    """The part of the array in a unit: at the edges less than a whole one. Outside of the grid: IndexError."""
    if len(coords) != meta.ndim or not all(0 <= c < n for c, n in zip(coords, meta.grid_shape)):
        raise IndexError(f"chunk {coords} is not in a grid of {meta.grid_shape}")
    return grid_to_cells(tuple((c, c + 1) for c in coords), meta.unit_shape, meta.shape)


def clip(meta: ArrayMeta, unit: tuple[int, ...], bounds: Bounds) -> Bounds:
    """The cells that a unit and a box share."""
    return tuple((max(a, c * k), max(a, c * k, min(b, (c + 1) * k, n))) for c, k, n, (a, b) in zip(unit, meta.unit_shape, meta.shape, bounds))


@dataclass(frozen=True)
class Run:
    """A task's work: files ``first`` to ``stop`` of the box's grid; of a large file only one of ``parts``."""

    first: int
    stop: int
    part: int = 0
    parts: int = 1


@dataclass(frozen=True)
class BoxPlan:
    """The files that hold a box of an array."""

    meta: ArrayMeta
    bounds: Bounds

    @property
    def files(self) -> Bounds:
        return cells_to_grid(self.bounds, self.meta.chunk_shape)

    def runs(self, nbytes: int, most: int = MAX_RUNS) -> list[Run]:
        """Runs of about ``nbytes`` of cells each, ``most`` at most."""
        n, most = grid_size(self.files), max(1, most)
        if not n:
            return []
        size = max(1, math.prod(self.meta.chunk_shape) * self.meta.dtype.itemsize)
        if size > nbytes and n < most:
            parts = min(-(-size // nbytes), math.prod(self.meta.units_per_file), most // n)
            if parts > 1:
                return [Run(i, i + 1, p, parts) for i in range(n) for p in range(parts)]
        step = max(1, nbytes // size, -(-n // most))
        return [Run(i, min(n, i + step)) for i in range(0, n, step)]

    def file(self, number: int) -> tuple[int, ...]:
        """The file with this number."""
        at = []
        for lo, hi in reversed(self.files):
            number, here = divmod(number, hi - lo)
            at.append(lo + here)
        return tuple(at[::-1])

    def units(self, file: tuple[int, ...], part: int = 0, parts: int = 1) -> np.ndarray:
        """The box's units in a file, or a part of them."""
        own = [(f * k, (f + 1) * k) for f, k in zip(file, self.meta.units_per_file)]
        box = cells_to_grid(self.bounds, self.meta.unit_shape)
        points = grid_points(tuple((max(a, lo), max(a, lo, min(b, hi))) for (a, b), (lo, hi) in zip(own, box)))
        return points[part * len(points) // parts : (part + 1) * len(points) // parts]


@dataclass(frozen=True)
class Located:
    """Units of a file with their bytes in it. ``data`` is the whole file if it was read to find them."""

    units: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    data: bytes | None = None

    @property
    def stored(self) -> np.ndarray:
        """Which units have bytes. An offset of all ones marks an absent one, and no payload is empty."""
        return (self.offset != ABSENT) & (self.length > 0)

    def windows(self, *, max_fused_bytes: int = READ_FUSED_BYTES, max_gap_bytes: int = 0) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(start, stop, [(number of the unit, where it begins in the window, its length)]) of each read."""
        held = np.flatnonzero(self.stored)
        at, n = self.offset[held].astype(np.int64), self.length[held].astype(np.int64)
        found: Windows = fuse(at, n, max_fused_bytes=max_fused_bytes, max_gap_bytes=max_gap_bytes)
        for lo, hi, some in found:
            yield lo, hi, list(zip(held[some].tolist(), (at[some] - lo).tolist(), n[some].tolist()))


def parse_index(meta: ArrayMeta, raw: bytes) -> np.ndarray:
    """(units along each axis, 2) of offset and length. Its checksum is not verified."""
    return np.frombuffer(raw, dtype="<u8").reshape(*meta.units_per_file, 2)


def locate(meta: ArrayMeta, store, file: tuple[int, ...], units: np.ndarray, *, whole_up_to: int = READ_FUSED_BYTES) -> Located:
    """Where a file has the bytes of ``units``. A file that is not there has none of them.

    A shard of which every unit is wanted is read whole, index and all, if it has at most ``whole_up_to`` bytes.
    """
    key, n = meta.chunk_key(file), len(units)
    size = store.size(key)
    nothing = Located(units, np.full(n, ABSENT, dtype=np.uint64), np.zeros(n, dtype=np.uint64))
    if size is None:
        return nothing
    if meta.sharding is None:
        return Located(units, np.zeros(n, dtype=np.uint64), np.full(n, size, dtype=np.uint64))
    per = meta.units_per_file
    width = 16 * math.prod(per)
    at = 0 if meta.sharding.at_start else size - width - 4 * meta.sharding.index_crc
    data = store.read(key, 0, size) if n == math.prod(per) and size <= whole_up_to else None
    index = parse_index(meta, data[at : at + width] if data is not None else store.read(key, at, width))
    entry = index[tuple((units % np.array(per)).T)] if meta.ndim else index.reshape(1, 2)
    return Located(units, entry[:, 0], entry[:, 1], data)


def payloads(meta: ArrayMeta, store, file: tuple[int, ...], located: Located, *, max_fused_bytes: int = READ_FUSED_BYTES, max_gap_bytes: int = 0) -> Iterator[list[tuple[tuple[int, ...], bytes]]]:
    """(unit, its bytes) of the stored ones, those of one fused read at a time."""
    key = meta.chunk_key(file)
    for lo, hi, members in located.windows(max_fused_bytes=max_fused_bytes, max_gap_bytes=max_gap_bytes):
        window = memoryview(located.data)[lo:hi] if located.data is not None else memoryview(store.read(key, lo, hi - lo))
        yield [(tuple(located.units[i].tolist()), bytes(window[at : at + n])) for i, at, n in members]

"""Fusing byte ranges of one file into fewer reads, over arrays of offsets and lengths. Nothing here needs Spark."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Length of a fused read, at most, unless one range alone is longer.
MAX_FUSED_BYTES = 4 << 20
#: What the reading operators pass instead of that default.
READ_FUSED_BYTES = 64 << 20


@dataclass(frozen=True)
class Windows:
    """Reads that cover all ranges, in order of offset; window i holds the ranges ``order[edge[i] : edge[i + 1]]``."""

    start: np.ndarray
    stop: np.ndarray
    order: np.ndarray
    edge: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, stop, numbers of the ranges) of each."""
        for i, (lo, hi) in enumerate(zip(self.start.tolist(), self.stop.tolist())):
            yield lo, hi, self.order[self.edge[i] : self.edge[i + 1]]


def fuse(offset, length, *, max_fused_bytes: int = MAX_FUSED_BYTES, max_gap_bytes: int = 0) -> Windows:
    """Cover ranges by windows, each range by one.

    In order of offset, then number, a range belongs to the window before it if at most ``max_gap_bytes`` lie between
    them and the window stays within ``max_fused_bytes``; ranges that overlap share bytes. Ranges that are empty or
    longer than the limit have windows of their own, and no window goes on behind one.

    A window is found at once: its ranges are among those that begin within the limit of its start, up to the first
    where the running end leaves a gap or passes the limit.
    """
    if max_fused_bytes <= 0:
        raise ValueError("max_fused_bytes must be positive")
    if max_gap_bytes < 0:
        raise ValueError("max_gap_bytes must not be negative")
    offset, length = np.asarray(offset, dtype=np.int64), np.asarray(length, dtype=np.int64)
    order = np.argsort(offset, kind="stable")
    lo, hi = offset[order], (offset + length)[order]
    single = (hi == lo) | (hi - lo > max_fused_bytes)
    # Behind each place, the next range that stands alone.
    barrier = np.minimum.accumulate(np.where(single, np.arange(len(lo)), len(lo))[::-1])[::-1]
    edge, stop, i = [0], [], 0
    while i < len(lo):
        end = i + 1
        if not single[i]:
            end = min(int(barrier[i]), int(np.searchsorted(lo, lo[i] + max_fused_bytes, side="right")))
            reach = np.maximum.accumulate(hi[i:end])
            bad = reach > lo[i] + max_fused_bytes
            bad[1:] |= lo[i + 1 : end] - reach[:-1] > max_gap_bytes
            end = i + int(bad.argmax()) if bad.any() else end
        stop.append(int(hi[i:end].max()))
        edge.append(end)
        i = end
    return Windows(lo[edge[:-1]], np.array(stop, dtype=np.int64), order, np.array(edge))

"""Fused reads against a scan of the ranges one by one."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from ndgrid.plans.coalesce import fuse


def _one_by_one(ranges, cap, gap):
    """(start, stop, numbers) by taking range after range."""
    out, free = [], False
    for i in sorted(range(len(ranges)), key=lambda i: (ranges[i][0], i)):
        lo, n = ranges[i]
        alone = n == 0 or n > cap
        if out and free and not alone and lo - out[-1][1] <= gap and max(out[-1][1], lo + n) - out[-1][0] <= cap:
            out[-1] = (out[-1][0], max(out[-1][1], lo + n), [*out[-1][2], i])
        else:
            out.append((lo, lo + n, [i]))
        free = not alone
    return out


@given(st.lists(st.tuples(st.integers(0, 500), st.integers(0, 90)), max_size=40), st.integers(1, 200), st.integers(0, 20))
def test_windows_are_those_of_a_scan(ranges, cap, gap):
    found = fuse([o for o, _ in ranges], [n for _, n in ranges], max_fused_bytes=cap, max_gap_bytes=gap)
    assert [(lo, hi, some.tolist()) for lo, hi, some in found] == _one_by_one(ranges, cap, gap)
    assert sorted(found.order.tolist()) == list(range(len(ranges)))


def test_limits_must_make_sense():
    for wrong in ({"max_fused_bytes": 0}, {"max_fused_bytes": -4}, {"max_gap_bytes": -1}):
        with pytest.raises(ValueError):
            fuse([0], [1], **wrong)
    assert len(fuse([], [])) == 0


def test_many_ranges_take_little_time():
    n = 200_000
    found = fuse(np.arange(n) * 10, np.full(n, 10), max_fused_bytes=1000)
    assert len(found) == n // 100 and (found.stop - found.start == 1000).all()

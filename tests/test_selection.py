"""Selections of arrays of many shapes, against numpy's own indexing of the same array."""

import numpy as np
import pytest
from hypothesis import assume, given
from hypothesis import strategies as st

from ndgrid.plans.selection import Stepped, hull, int_axes, normalize, orthogonal

_shapes = st.lists(st.integers(1, 7), min_size=0, max_size=4).map(tuple)
_ends = st.none() | st.integers(-9, 9)


@st.composite
def _basic(draw, steps=(None, 1)):
    """A shape and an index of integers, slices and at most one ellipsis that fits its number of axes."""
    shape = draw(_shapes)
    parts = draw(st.lists(st.integers(-9, 9) | st.builds(slice, _ends, _ends, st.sampled_from(steps)), max_size=len(shape)))
    if draw(st.booleans()):
        parts.insert(draw(st.integers(0, len(parts))), ...)
    return shape, tuple(parts)


def _numpy(shape, sel):
    """What numpy selects: the coordinates of the chosen cells, and the result's shape. None where it refuses."""
    x = np.arange(int(np.prod(shape))).reshape(shape)
    try:
        got = x[sel]
    except IndexError:
        return None
    return got


@given(_basic())
def test_bounds_select_what_numpy_selects(case):
    shape, sel = case
    want = _numpy(shape, sel)
    if want is None:
        with pytest.raises(IndexError):
            normalize(sel, shape)
        return
    bounds = normalize(sel, shape)
    assert len(bounds) == len(shape) and all(0 <= lo <= hi <= n for (lo, hi), n in zip(bounds, shape))
    kept = _numpy(shape, tuple(slice(lo, hi) for lo, hi in bounds))
    assert np.array_equal(kept.ravel(), np.asarray(want).ravel())
    dropped = int_axes(sel, len(shape))
    assert tuple(n for i, n in enumerate(kept.shape) if i not in dropped) == np.shape(want)


@given(_basic(), st.sampled_from([2, -1, -3]))
def test_steps_are_no_basic_selection(case, step):
    shape, sel = case
    assume(shape and len([p for p in sel if p is not ...]) < len(shape))
    at = sel.index(...) + 1 if ... in sel else len(sel)
    assume(_numpy(shape, sel) is not None)
    with pytest.raises(NotImplementedError):
        normalize((*sel[:at], slice(None, None, step), *sel[at:]), shape)


@pytest.mark.parametrize("part", [True, np.True_, "a", 0.5, [1], np.array([0])])
def test_other_kinds_are_no_basic_selection(part):
    with pytest.raises(TypeError):
        normalize(part, (4, 4))


@given(_shapes)
def test_too_many_axes(shape):
    with pytest.raises(IndexError):
        normalize((0,) * (len(shape) + 1), shape)
    with pytest.raises(IndexError):
        normalize((..., slice(None), ...), (*shape, 2))
    with pytest.raises(NotImplementedError):
        normalize((None,), (*shape, 2))


@given(st.data())
def test_orthogonal_selections_take_each_axis_on_its_own(data):
    shape = data.draw(st.lists(st.integers(1, 6), min_size=1, max_size=3).map(tuple))
    sel, want = [], []
    for n in shape:
        kind = data.draw(st.sampled_from(["step", "list", "mask", "one"]))
        if kind == "step":
            s = slice(data.draw(_ends), data.draw(_ends), data.draw(st.sampled_from([None, 1, 2, 3, -1, -2])))
            sel.append(s)
            want.append(list(range(n))[s])
        elif kind == "list":
            at = data.draw(st.lists(st.integers(-n, n - 1), min_size=1, max_size=5))
            sel.append(at)
            want.append([i % n for i in at])
        elif kind == "mask":
            mask = data.draw(st.lists(st.booleans(), min_size=n, max_size=n))
            sel.append(np.array(mask))
            want.append([i for i, m in enumerate(mask) if m])
        else:
            i = data.draw(st.integers(-n, n - 1))
            sel.append(i)
            want.append([i % n])
    axes = orthogonal(tuple(sel), shape)
    got = [list(range(a.start, a.stop, a.step)) if isinstance(a, Stepped) else list(a.at) for a in axes]
    assert got == want and [len(a) for a in axes] == list(map(len, want))
    assert [list(range(lo, hi))[:: max(1, hi - lo - 1)] for lo, hi in hull(axes)] == [sorted({min(w), max(w)}) if w else [] for w in want]
    with pytest.raises(IndexError):
        orthogonal(np.ones(shape[0] + 1, dtype=bool), shape)

"""Index expressions of an N-dimensional array, compiled to bounds on each axis. Nothing here needs Spark."""

from __future__ import annotations

import numbers
from dataclasses import dataclass

Bounds = tuple[tuple[int, int], ...]


def _expand(sel, ndim: int) -> list:
    """One entry for each axis: an ellipsis, or the missing end, becomes full slices."""
    parts = list(sel) if isinstance(sel, tuple) else [sel]
    dots = [i for i, p in enumerate(parts) if p is Ellipsis]
    if len(dots) > 1:
        raise IndexError("an index can have one ellipsis only")
    if any(p is None for p in parts):
        raise NotImplementedError("new axes are not supported")
    given = len(parts) - len(dots)
    if given > ndim:
        raise IndexError(f"{given} indices for an array of {ndim} dimensions")
    at = dots[0] if dots else len(parts)
    return parts[:at] + [slice(None)] * (ndim - given) + parts[at + len(dots) :]


def _is_bool(x) -> bool:
    return isinstance(x, bool) or type(x).__name__ in ("bool_", "bool")


def _position(i, size: int, axis: int) -> int:
    k = int(i) + size * (int(i) < 0)
    if not 0 <= k < size:
        raise IndexError(f"index {i} is out of bounds for axis {axis} of size {size}")
    return k


def normalize(sel, shape: tuple[int, ...]) -> Bounds:
    """(start, stop) for each axis of a basic selection: integers, slices of step 1 and an ellipsis.

    Slices are clamped to the axis; one whose stop is before its start is empty, at its start. Steps and new axes
    raise NotImplementedError; booleans, strings and arrays TypeError; integers out of bounds IndexError.
    """
    out = []
    for axis, (part, size) in enumerate(zip(_expand(sel, len(shape)), shape)):
        if _is_bool(part):
            raise TypeError("a boolean is not an index")
        if isinstance(part, numbers.Integral):
            k = _position(part, size, axis)
            out.append((k, k + 1))
        elif isinstance(part, slice):
            if part.step not in (None, 1):
                raise NotImplementedError(f"step {part.step} is not a basic selection")
            lo, hi, _ = part.indices(size)
            out.append((lo, max(lo, hi)))
        else:
            raise TypeError(f"{type(part).__name__} is not a basic index")
    return tuple(out)


def int_axes(sel, ndim: int) -> tuple[int, ...]:
    """The axes that a plain integer selects; numpy drops them from the result."""
    parts = _expand(sel, ndim)
    return tuple(a for a, p in enumerate(parts) if isinstance(p, numbers.Integral) and not _is_bool(p))


@dataclass(frozen=True)
class Stepped:
    """start, start + step, ... below stop."""

    start: int
    stop: int
    step: int = 1

    def __len__(self) -> int:
        return len(range(self.start, self.stop, self.step))


@dataclass(frozen=True)
class Points:
    """Positions along an axis, in the order of the result; they may repeat."""

    at: tuple[int, ...]

    def __len__(self) -> int:
        return len(self.at)


def orthogonal(sel, shape: tuple[int, ...]) -> tuple[Stepped | Points, ...]:
    """Like :func:`normalize`, and also steps (either way), lists of integers and boolean masks, axis by axis."""
    out: list[Stepped | Points] = []
    for axis, (part, size) in enumerate(zip(_expand(sel, len(shape)), shape)):
        if _is_bool(part):
            raise TypeError("a boolean is not an index")
        if isinstance(part, numbers.Integral):
            k = _position(part, size, axis)
            out.append(Stepped(k, k + 1))
        elif isinstance(part, slice):
            lo, hi, step = part.indices(size)
            out.append(Stepped(lo, max(lo, hi), step) if step > 0 else Points(tuple(range(lo, hi, step))))
        elif hasattr(part, "__len__") and not isinstance(part, (str, bytes)):
            items = list(part)
            if items and all(_is_bool(x) for x in items):
                if len(items) != size:
                    raise IndexError(f"a mask of {len(items)} for axis {axis} of size {size}")
                out.append(Points(tuple(i for i, x in enumerate(items) if x)))
            elif all(isinstance(x, numbers.Integral) and not _is_bool(x) for x in items):
                out.append(Points(tuple(_position(x, size, axis) for x in items)))
            else:
                raise TypeError("an index array holds integers or booleans")
        else:
            raise TypeError(f"{type(part).__name__} is not an index")
    return tuple(out)


def hull(axes: tuple[Stepped | Points, ...]) -> Bounds:
    """The smallest box around an orthogonal selection."""
    out = []
    for a in axes:
        if isinstance(a, Stepped):
            out.append((a.start, a.start + (len(a) - 1) * a.step + 1 if len(a) else a.start))
        else:
            out.append((min(a.at), max(a.at) + 1) if a.at else (0, 0))
    return tuple(out)

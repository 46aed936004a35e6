"""Benchmarks by name, with typed parameters and the values that a sweep goes through."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from types import SimpleNamespace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Case:
    """What a benchmark's setup gives: ``body`` is timed, ``check`` says whether what it returned is right."""

    body: Callable[[], object]
    check: Callable[[object], bool]
    nbytes: int | None = None  # uncompressed bytes that a run goes through


@dataclass(frozen=True)
class Context:
    """A run's parameters (``p.name``), its session and a folder that executors share."""

    spark: SparkSession
    folder: str
    p: SimpleNamespace


@dataclass(frozen=True)
class Benchmark:
    name: str
    setup: Callable[[Context], Case]
    params: dict[str, object] = field(default_factory=dict)
    sweep: dict[str, tuple] = field(default_factory=dict)

    def resolve(self, given: dict[str, object]) -> dict[str, object]:
        """The defaults with ``given`` in their place; strings become the default's type. Unknown names: KeyError."""
        if unknown := sorted(set(given) - set(self.params)):
            raise KeyError(f"{self.name} has no parameter {unknown[0]!r}; it has {', '.join(self.params) or 'none'}")
        return {k: _as(given[k], v) if k in given else v for k, v in self.params.items()}

    def points(self, given: dict[str, object]) -> Iterator[dict[str, object]]:
        """Every combination of the sweep's values; a given parameter stays as it is given."""
        axes = {k: v for k, v in self.sweep.items() if k not in given}
        for values in itertools.product(*axes.values()):
            yield self.resolve(given | dict(zip(axes, values)))


def _as(value: object, like: object) -> object:
    if not isinstance(value, str) or isinstance(like, str) or like is None:
        return value
    if isinstance(like, bool):
        if value.lower() not in ("true", "false", "1", "0", "yes", "no"):
            raise ValueError(f"{value!r} is neither true nor false")
        return value.lower() in ("true", "1", "yes")
    return type(like)(value)


REGISTRY: dict[str, Benchmark] = {}


def benchmark(name: str, *, params: dict[str, object] | None = None, sweep: dict[str, tuple] | None = None):
    """Register a setup function. A name can be taken once."""

    def add(setup: Callable[[Context], Case]) -> Callable[[Context], Case]:
        if name in REGISTRY:
            raise ValueError(f"there is a benchmark {name!r} already")
        REGISTRY[name] = Benchmark(name, setup, dict(params or {}), dict(sweep or {}))
        return setup

    return add

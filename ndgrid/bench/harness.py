"""Timing: a first run is verified, and only a right result is timed."""

from __future__ import annotations

import json
import os
import platform
import resource
import statistics
import time
from collections.abc import Callable
from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import SparkSession

from ndgrid.bench.registry import Benchmark, Context
from ndgrid.runtime import described, shared_path

WARMUPS, REPETITIONS = 2, 5


class WrongResult(AssertionError):
    """A benchmark's first run did not give what it should; it gets no time."""


def timed(body: Callable[[], object], *, warmups: int = WARMUPS, repetitions: int = REPETITIONS, after: Callable[[], object] = lambda: None) -> list[float]:
    """Seconds of each repetition behind the warm-ups; ``after`` clears up between runs, outside of the time."""
    seconds = []
    for _ in range(warmups + repetitions):
        start = time.perf_counter()
        body()
        seconds.append(time.perf_counter() - start)
        after()
    return seconds[warmups:]


def run(spark: SparkSession, bench: Benchmark, given: dict[str, object] | None = None, *, warmups: int = WARMUPS, repetitions: int = REPETITIONS) -> dict:
    """One row of results: the parameters, the median, least and greatest seconds, and GiB of cells a second."""
    params = bench.resolve(given or {})
    case = bench.setup(Context(spark, shared_path(spark, f"bench-{bench.name}"), SimpleNamespace(**params)))
    with described(spark, f"{bench.name}: verify"):
        if not case.check(case.body()):
            raise WrongResult(f"{bench.name} {params}")
    with described(spark, f"{bench.name}: timed"):
        seconds = timed(case.body, warmups=warmups, repetitions=repetitions)
    median = statistics.median(seconds)
    row = {"bench": bench.name, **params, "seconds": round(median, 4), "least": round(min(seconds), 4), "greatest": round(max(seconds), 4)}
    return row | ({"gib_s": round(case.nbytes / median / 2**30, 4)} if case.nbytes is not None else {})


def telemetry(spark: SparkSession) -> dict:
    """What the numbers depend on: versions, cores, memory of this process, and the session's settings."""
    conf = {k: v for k, v in spark.sparkContext.getConf().getAll() if k.startswith(("spark.sql.", "spark.master", "spark.driver.memory", "spark.executor"))}
    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    return {"spark": spark.version, "python": platform.python_version(), "machine": platform.machine(), "cores": os.cpu_count(), "default_parallelism": spark.sparkContext.defaultParallelism, "driver_peak_mb": peak // 1024, "conf": conf}


def write_jsonl(row: dict, path: str | os.PathLike | None = None) -> Path:
    """Append a row to a file of JSON lines; the default one is in $NDGRID_BENCH_DIR or the working folder."""
    at = Path(path) if path is not None else Path(os.environ.get("NDGRID_BENCH_DIR", ".")) / "bench.jsonl"
    at.parent.mkdir(parents=True, exist_ok=True)
    with at.open("a", encoding="utf-8") as f:
        f.write(json.dumps(row, default=str) + "\n")
    return at


def render_table(rows: list[dict]) -> str:
    """Rows as text in columns of even width, one for each key that any row has."""
    if not rows:
        return "(no rows)"
    names = list(dict.fromkeys(k for r in rows for k in r))
    cells = [names, *([str(r.get(n, "")) for n in names] for r in rows)]
    widths = [max(map(len, column)) for column in zip(*cells)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(line, widths)).rstrip() for line in cells)


class Capture:
    """Jobs of a block under one job group: how many jobs, stages and tasks Spark ran for it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, f"{name}-{time.time_ns()}"

    #: What a job group sets on the thread.
    PROPERTIES = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")

    def __enter__(self) -> Capture:
        self.before = {p: self.spark.sparkContext.getLocalProperty(p) for p in self.PROPERTIES}
        self.spark.sparkContext.setJobGroup(self.name, self.name)
        return self

    def __exit__(self, *exc) -> None:
        tracker = self.spark.sparkContext.statusTracker()
        jobs = tracker.getJobIdsForGroup(self.name)
        stages = {s for j in jobs if (info := tracker.getJobInfo(j)) for s in info.stageIds}
        self.jobs, self.stages = len(jobs), len(stages)
        self.tasks = sum(info.numTasks for s in stages if (info := tracker.getStageInfo(s)))
        for p, value in self.before.items():
            self.spark.sparkContext.setLocalProperty(p, value)

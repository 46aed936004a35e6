"""The benchmarks: reading files alone, reading and decoding Blosc chunks, and reading arrays in several ways."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ndgrid.array import Array, ReadOptions, open_array
from ndgrid.bench import fixtures
from ndgrid.bench.registry import Case, Context, benchmark
from ndgrid.plans.meta import ArrayMeta
from ndgrid.sources import datasource

_ZSTD = [{"name": "shuffle", "configuration": {"elementsize": 4}}, {"name": "zstd", "configuration": {"level": 1}}]


def _shape(mib: int, chunk_mib: float) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Rows of 1024 cells of 4 bytes: an array of ``mib`` in chunks of ``chunk_mib``."""
    rows = max(1, int(chunk_mib * 256))
    return (max(1, mib * 256 // rows) * rows, 1024), (rows, 1024)


def _logical(meta: ArrayMeta) -> int:
    return math.prod(meta.shape) * meta.dtype.itemsize


def _sums(cells: DataFrame) -> tuple:
    """Count, sum of values and of values times places: right only if every cell is there, in its place."""
    spot = F.col("c0") * 1024 + F.col("c1")
    return tuple(cells.agg(F.count("*"), F.sum(F.col("v").cast("bigint")), F.sum(F.col("v").cast("bigint") * spot)).first())


@benchmark("read-path", params={"mib": 64, "chunk_mib": 8.0, "fused_mib": 64, "sharded": False}, sweep={"chunk_mib": (1.0, 8.0), "sharded": (False, True), "fused_mib": (1, 64)})
def read_path(c: Context) -> Case:
    """Stored bytes off the disk, undecoded."""
    shape, chunk = _shape(c.p.mib, c.p.chunk_mib)
    shards = {"shards": (chunk[0] * max(1, shape[0] // chunk[0] // 2), chunk[1])} if c.p.sharded else {}
    if shards and shape[0] % shards["shards"][0]:
        shape = (-(-shape[0] // shards["shards"][0]) * shards["shards"][0], shape[1])
    meta = fixtures.noise_array(c.spark, c.folder, shape, chunk, _ZSTD, **shards)
    chunks = c.spark.read.format("ndgrid").options(view="chunks", max_fused_bytes=c.p.fused_mib << 20).load(meta.root)
    want = math.prod(meta.grid_shape)
    return Case(lambda: chunks.agg(F.count("payload"), F.sum("raw_nbytes")).first(), lambda r: tuple(r) == (want, want * meta.unit_nbytes), _logical(meta))


@benchmark("blosc-e2e", params={"mib": 32, "chunk_mib": 4.0}, sweep={"chunk_mib": (1.0, 4.0, 16.0)})
def blosc_e2e(c: Context) -> Case:
    """Blosc chunks read, decoded and handed to Spark as cells."""
    shape, chunk = _shape(c.p.mib, c.p.chunk_mib)
    meta = fixtures.blosc_store(c.spark, c.folder, shape, chunk)
    want = _sums(fixtures.noise_cells(c.spark, shape))
    datasource.register(c.spark)
    return Case(lambda: _sums(c.spark.read.format("ndgrid").load(meta.root)), lambda r: r == want, _logical(meta))


@benchmark("array-read", params={"mib": 32, "chunk_mib": 4.0, "way": "explicit"}, sweep={"way": ("explicit", "drop-in", "source"), "chunk_mib": (1.0, 4.0)})
def array_read(c: Context) -> Case:
    """A whole array through the explicit interface, the one that indexes as numpy does, and the source alone."""
    shape, chunk = _shape(c.p.mib, c.p.chunk_mib)
    meta = fixtures.noise_array(c.spark, c.folder, shape, chunk, _ZSTD)
    want = _sums(fixtures.noise_cells(c.spark, shape))
    ways = {
        "explicit": lambda: Array(meta, c.spark).retrieve_array_subset(..., ReadOptions()),
        "drop-in": lambda: open_array(meta.root, spark=c.spark)[...],
        "source": lambda: c.spark.read.format("ndgrid").load(meta.root),
    }
    return Case(lambda: _sums(ways[c.p.way]()), lambda r: r == want, _logical(meta))

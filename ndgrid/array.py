"""Array façades: an explicit one that keeps every axis, an asynchronous one, and one that indexes as numpy does."""

from __future__ import annotations

import asyncio
import math
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ndgrid.functions import filters
from ndgrid.operators import cells as ops
from ndgrid.plans.coalesce import READ_FUSED_BYTES
from ndgrid.plans.meta import ArrayMeta, clear_plan_cache, from_metadata, open_meta
from ndgrid.plans.reads import locate, unit_box
from ndgrid.plans.selection import hull, int_axes, normalize, orthogonal
from ndgrid.plans.store import open_store
from ndgrid.runtime import BATCH_ROWS, described
from ndgrid.sources import datasource


@dataclass(frozen=True)
class ReadOptions:
    """Choices of one read; none is stored with the array. ``max_workers`` is the most partitions it is dealt to."""

    max_fused_bytes: int = READ_FUSED_BYTES
    max_gap_bytes: int = 0
    partition_bytes: int | None = None
    max_workers: int | None = None


def _spark(spark: SparkSession | None) -> SparkSession:
    found = spark or SparkSession.getActiveSession()
    if found is None:
        raise RuntimeError("there is no active Spark session")
    return found


class Array:
    """A plan and what can be read with it. Reads are lazy DataFrames of cells; metadata costs no I/O."""

    def __init__(self, plan: ArrayMeta, spark: SparkSession | None = None):
        self.plan, self._session = plan, spark

    @classmethod
    def open(cls, root: str, *, cached: bool = True, spark: SparkSession | None = None) -> Array:
        return cls(open_meta(root, cached=cached), spark)

    @classmethod
    def from_metadata(cls, metadata: dict, root: str, *, spark: SparkSession | None = None) -> Array:
        return cls(from_metadata(metadata, root), spark)

    @property
    def shape(self) -> tuple[int, ...]:
        return self.plan.shape

    @property
    def dtype(self) -> np.dtype:
        return self.plan.dtype

    @property
    def ndim(self) -> int:
        return self.plan.ndim

    @property
    def chunk_shape(self) -> tuple[int, ...]:
        """Of what is decoded at a time: the inner chunk of a sharded array."""
        return self.plan.unit_shape

    @property
    def grid_shape(self) -> tuple[int, ...]:
        return self.plan.grid_shape

    @property
    def metadata(self) -> dict:
        return self.plan.raw

    @property
    def attrs(self) -> dict:
        return dict(self.plan.attributes)

    def __repr__(self) -> str:
        return f"<{type(self).__name__} {self.plan.root} shape={self.shape} dtype={self.dtype} chunks={self.chunk_shape}>"

    def retrieve_array_subset(self, sel=..., options: ReadOptions | None = None) -> DataFrame:
        """The cells of a basic selection, moved to the origin; every axis stays."""
        bounds = normalize(sel, self.shape)
        cells = datasource.read_box(_spark(self._session), self.plan, bounds, **asdict(options or ReadOptions()))
        return ops.box(cells, bounds)

    def __getitem__(self, sel) -> DataFrame:
        return self.retrieve_array_subset(sel)

    def retrieve_chunk(self, coords: tuple[int, ...], options: ReadOptions | None = None) -> DataFrame:
        """One unit, fill if it is not stored, cut at the array's edge. Outside of the grid: IndexError."""
        bounds = unit_box(self.plan, coords)
        cells = datasource.read_box(_spark(self._session), self.plan, bounds, **asdict(options or ReadOptions()))
        return ops.box(cells, bounds)

    def retrieve_encoded_chunk(self, coords: tuple[int, ...]) -> bytes | None:
        """A unit's stored bytes; None if it is not stored."""
        unit_box(self.plan, coords)
        file = tuple(c // n for c, n in zip(coords, self.plan.units_per_file))
        store = open_store(self.plan.root, read_only=True)
        found = locate(self.plan, store, file, np.array([coords], dtype=np.int64).reshape(1, self.ndim), whole_up_to=0)
        return store.read(self.plan.chunk_key(file), int(found.offset[0]), int(found.length[0])) if found.stored[0] else None

    def to_numpy(self, sel=..., *, out: np.ndarray | None = None) -> np.ndarray:
        """The selection as a dense array on the driver. ``out`` must have its shape and dtype, and is returned."""
        bounds = normalize(sel, self.shape)
        return _dense(self.retrieve_array_subset(sel), tuple(hi - lo for lo, hi in bounds), self.dtype, out)


def _dense(cells: DataFrame, shape: tuple[int, ...], dtype: np.dtype, out: np.ndarray | None = None) -> np.ndarray:
    if out is not None and (out.shape != shape or out.dtype != dtype):
        raise ValueError(f"out is {out.shape} {out.dtype}; the selection is {shape} {dtype}")
    a = np.zeros(shape, dtype=dtype) if out is None else out
    if math.prod(shape):
        with described(cells.sparkSession, f"read {shape} {dtype}"):
            got = cells.toPandas()
        values = got["v"].to_numpy().astype(dtype)
        a[tuple(got[f"c{i}"].to_numpy() for i in range(len(shape)))] = values if shape else values[0]
    return a


def read_array(root: str | None, sel=..., *, plan: ArrayMeta | None = None, options: ReadOptions | None = None, out: np.ndarray | None = None, spark: SparkSession | None = None) -> DataFrame | np.ndarray:
    """Open and read in one call; ``root`` does not count if there is a plan. With ``out`` the cells go there instead."""
    array = Array(plan if plan is not None else open_meta(root), spark)
    cells = array.retrieve_array_subset(sel, options)
    return cells if out is None else _dense(cells, tuple(hi - lo for lo, hi in normalize(sel, array.shape)), array.dtype, out)


class AsyncArray:
    """The same reads, awaitable; a read's jobs run from a thread, and Spark takes jobs from many at once."""

    def __init__(self, array: Array):
        self.array = array

    @classmethod
    async def open(cls, root: str, *, cached: bool = True, spark: SparkSession | None = None) -> AsyncArray:
        return cls(Array.open(root, cached=cached, spark=_spark(spark)))

    def __getattr__(self, name: str):
        return getattr(self.array, name)

    async def retrieve_array_subset(self, sel=..., options: ReadOptions | None = None) -> np.ndarray:
        bounds = normalize(sel, self.array.shape)
        frame = self.array.retrieve_array_subset(sel, options)
        return await asyncio.to_thread(_dense, frame, tuple(hi - lo for lo, hi in bounds), self.array.dtype)

    async def retrieve_chunk(self, coords: tuple[int, ...], options: ReadOptions | None = None) -> np.ndarray:
        shape = tuple(hi - lo for lo, hi in unit_box(self.array.plan, coords))
        return await asyncio.to_thread(_dense, self.array.retrieve_chunk(coords, options), shape, self.array.dtype)

    async def retrieve_encoded_chunk(self, coords: tuple[int, ...]) -> bytes | None:
        return await asyncio.to_thread(self.array.retrieve_encoded_chunk, coords)


class GridArray(Array):
    """Indexes as numpy does: integers drop their axis; steps, masks and index lists work, each on its own axis.

    ``array[sel]`` gives cells, ``array.to_numpy(sel)`` a dense array, ``array.write(sel, cells)`` overwrites.
    """

    @classmethod
    def wrap(cls, array: Array) -> GridArray:
        return cls(array.plan, array._session)

    def _fresh(self) -> ArrayMeta:
        """The metadata as of now: a rewritten document is read again."""
        self.plan = open_meta(self.plan.root)
        return self.plan

    def __getitem__(self, sel) -> DataFrame:
        meta = self._fresh()
        drop = int_axes(sel, self.ndim)
        spark = _spark(self._session)
        try:
            bounds = normalize(sel, self.shape)
        except (NotImplementedError, TypeError):
            axes = orthogonal(sel, self.shape)
            return ops.take(datasource.read_box(spark, meta, hull(axes)), axes, drop=drop)
        return ops.box(datasource.read_box(spark, meta, bounds), bounds, drop=drop)

    def result_shape(self, sel) -> tuple[int, ...]:
        drop = int_axes(sel, self.ndim)
        return tuple(len(a) for i, a in enumerate(orthogonal(sel, self.shape)) if i not in drop)

    def to_numpy(self, sel=..., *, out: np.ndarray | None = None) -> np.ndarray:
        return _dense(self[sel], self.result_shape(sel), self.dtype, out)

    def write(self, sel, values) -> None:
        """Overwrite a basic selection with cells (a DataFrame with coordinates from its origin), an array or a scalar."""
        bounds = normalize(sel, self.shape)
        spark, names = _spark(self._session), ops.axes(self.ndim)
        if isinstance(values, DataFrame):
            patch = values.select(*[(F.col(c) + lo).cast("bigint").alias(c) for c, (lo, _) in zip(names, bounds)], "v")
        else:
            shape = tuple(hi - lo for lo, hi in bounds)
            a = np.broadcast_to(np.asarray(values, dtype=self.dtype), shape)
            at = [x.ravel() + lo for x, (lo, _) in zip(np.indices(shape), bounds)]
            patch = spark.createDataFrame(pa.table([*map(pa.array, at), datasource._column(np.ascontiguousarray(a).ravel())], names=[*names, "v"]))
        datasource.write_region(patch, self.plan.root, bounds)
        clear_plan_cache()

    def __setitem__(self, sel, values) -> None:
        self.write(sel, values)


def open_array(root, *, spark: SparkSession | None = None) -> GridArray:
    return GridArray(open_meta(str(root)), spark)


def _auto_chunks(shape: tuple[int, ...], dtype: np.dtype, most: int = 8 << 20) -> tuple[int, ...]:
    """The array's shape, its longest axis halved until a chunk has at most ``most`` bytes."""
    chunk = [max(1, n) for n in shape]
    while math.prod(chunk) * dtype.itemsize > most:
        i = max(range(len(chunk)), key=chunk.__getitem__)
        chunk[i] = -(-chunk[i] // 2)
    return tuple(chunk)


def create_array(root, *, shape, dtype, chunks="auto", shards=None, compressors="auto", filters="auto", fill_value=0, overwrite: bool = False, attributes: dict | None = None, spark: SparkSession | None = None) -> GridArray:
    """A new array of fill values. ``auto``: chunks of at most 8 MiB, zstd, no filters."""
    shape, kind = tuple(shape), np.dtype(dtype)
    codecs = [*([] if filters in ("auto", None) else filters), *([{"name": "zstd", "configuration": {"level": 0, "checksum": False}}] if compressors == "auto" else compressors or [])]
    docs = [c.to_dict() if hasattr(c, "to_dict") else c for c in codecs]
    meta = datasource.create(str(root), overwrite=overwrite, shape=shape, dtype=kind, chunks=_auto_chunks(shape, kind) if chunks == "auto" else tuple(chunks), shards=shards, codecs=docs, fill_value=fill_value, attributes=attributes)
    return GridArray(meta, spark)


class Configuration:
    """What :func:`configure` set, and a context manager that puts the former settings back."""

    def __init__(self, spark: SparkSession, settings: dict[str, str | None], overrides: dict[str, str]):
        self.spark, self.settings, self.overrides = spark, settings, overrides

    def __enter__(self) -> Configuration:
        return self

    def __exit__(self, *exc) -> None:
        for k, v in self.settings.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)
        filters.set_overrides(self.overrides)


def configure(spark: SparkSession, *, batch_rows: int | None = None, shuffle_partitions: int | None = None, backend_overrides: dict[str, str] | None = None) -> Configuration:
    """Register the format and set the session's options at once; ``with configure(...):`` takes them back at the end."""
    wanted = {"spark.sql.python.filterPushdown.enabled": "true"}
    if batch_rows is not None:
        wanted[BATCH_ROWS] = str(batch_rows)
    if shuffle_partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    before = {k: spark.conf.get(k, None) for k in wanted}
    token = Configuration(spark, before, filters.get_overrides())
    for name, choice in (backend_overrides or {}).items():
        filters.resolve(name, choice)
    for k, v in wanted.items():
        spark.conf.set(k, v)
    datasource.register(spark)
    if backend_overrides is not None:
        filters.set_overrides(backend_overrides)
    return token

"""Arrays on disk as a Spark data source: ``spark.read.format("ndgrid")`` and ``df.write.format("ndgrid")``.

Reading. ``view=cells`` gives c0 .. c{n-1}, v; ``view=chunks`` gives g0 .. g{n-1}, payload, raw_nbytes (stored units
only). Comparisons on coordinates are pushed down: they become a box, and runs of the box's files become partitions.
Only there, in the tasks, are files looked for, shard indexes read, byte ranges fused, and units that no file holds made
up from the fill value (``fill=true``). Spark still applies every filter, so pushdown off gives the same rows.

Writing takes the chunk view. A file's units must come together, which :func:`write_chunks` sees to.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ndgrid.functions.checksums import crc32c
from ndgrid.functions.codecs import Chain
from ndgrid.operators import cells as ops
from ndgrid.plans.coalesce import READ_FUSED_BYTES
from ndgrid.plans.meta import ABSENT, ArrayMeta, clear_plan_cache, from_metadata, make_metadata, open_meta
from ndgrid.plans.reads import MAX_RUNS, BoxPlan, Run, cells_to_grid, clip, grid_to_cells, locate, payloads
from ndgrid.plans.selection import Bounds
from ndgrid.plans.store import open_store
from ndgrid.runtime import cut, ship

#: The narrowest Spark type that holds every value of a dtype.
SPARK_TYPES = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(),
}
_ARROW = {"uint8": pa.int16(), "uint16": pa.int32(), "uint32": pa.int64(), "uint64": pa.decimal128(20, 0), "float16": pa.float32()}

#: Bytes of cells that one partition reads: small chunk files share a task, large ones are dealt to several.
PARTITION_BYTES = 64 << 20
#: Cells of a record batch.
BATCH_CELLS = 1 << 18


def spark_type(dtype: np.dtype) -> T.DataType:
    if dtype.name not in SPARK_TYPES:
        raise NotImplementedError(f"{dtype} has no Spark type here")
    return SPARK_TYPES[dtype.name]


def _column(a: np.ndarray) -> pa.Array:
    if a.dtype.name == "uint64":
        import decimal

        return pa.array([decimal.Decimal(x) for x in a.tolist()], pa.decimal128(20, 0))
    to = _ARROW.get(a.dtype.name)
    return pa.array(a.astype(to.to_pandas_dtype()) if to else a)


class Part(InputPartition):
    def __init__(self, run: Run | None):
        super().__init__(None)
        self.run = run


class GridDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ndgrid"

    def _meta(self) -> ArrayMeta:
        return open_meta(self.options["path"])

    def schema(self) -> T.StructType:
        meta, chunks = self._meta(), self.options.get("view", "cells") == "chunks"
        at = [T.StructField(f"{'g' if chunks else 'c'}{i}", T.LongType(), False) for i in range(meta.ndim)]
        if chunks:
            return T.StructType([*at, T.StructField("payload", T.BinaryType()), T.StructField("raw_nbytes", T.LongType())])
        return T.StructType([*at, T.StructField("v", spark_type(meta.dtype))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return GridReader(self._meta(), self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return GridWriter(self._meta())


class GridReader(DataSourceReader):
    def __init__(self, meta: ArrayMeta, options: dict):
        self.meta = meta
        self.chunks = options.get("view", "cells") == "chunks"
        self.max_fused = int(options.get("max_fused_bytes", READ_FUSED_BYTES))
        self.max_gap = int(options.get("max_gap_bytes", 0))
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.most = int(options.get("max_workers", MAX_RUNS))
        self.fill = str(options.get("fill", "false")).lower() == "true" and not self.chunks
        self.limits = [[0, n] for n in (meta.grid_shape if self.chunks else meta.shape)]
        self.values = [-np.inf, np.inf]  # what a value must lie between, ends included

    @property
    def bounds(self) -> Bounds:
        lim = [(lo, max(lo, hi)) for lo, hi in self.limits]
        if not self.chunks:
            return tuple(lim)
        return grid_to_cells(tuple(lim), self.meta.unit_shape, self.meta.shape)

    def pushFilters(self, filters):
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if len(name) > 1 and name[0] == ("g" if self.chunks else "c") and name[1:].isdigit() and int(name[1:]) < self.meta.ndim:
                self._narrow(self.limits[int(name[1:])], f)
            elif name == "v" and not self.chunks:
                self._narrow_values(f)
            yield f  # Spark applies it as well: it clips units to the box

    @staticmethod
    def _narrow(limit: list[int], f) -> None:
        value = getattr(f, "value", None)
        if isinstance(f, In):
            values = [int(v) for v in value if v is not None]
            lo, hi = (min(values), max(values) + 1) if values else (0, 0)
        elif value is None:
            return
        elif isinstance(f, EqualTo):
            lo, hi = int(value), int(value) + 1
        elif isinstance(f, GreaterThan):
            lo, hi = int(value) + 1, limit[1]
        elif isinstance(f, GreaterThanOrEqual):
            lo, hi = int(value), limit[1]
        elif isinstance(f, LessThan):
            lo, hi = limit[0], int(value)
        elif isinstance(f, LessThanOrEqual):
            lo, hi = limit[0], int(value) + 1
        else:
            return
        limit[0], limit[1] = max(limit[0], lo), min(limit[1], hi)

    def _narrow_values(self, f) -> None:
        """Zone maps hold least and greatest values, so a strict limit is as good as one that is not."""
        value = getattr(f, "value", None)
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.values[0] = max(self.values[0], value)
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.values[1] = min(self.values[1], value)

    def _in_zone(self, store, file: tuple[int, ...], units: np.ndarray) -> np.ndarray:
        """The units that may hold a wanted value: all, unless the file has a zone map that says otherwise."""
        if self.values == [-np.inf, np.inf] or not len(units):
            return units
        zones = read_zones(store, self.meta.chunk_key(file))
        keep = [z is None or (z[0] <= self.values[1] and z[1] >= self.values[0]) for z in (zones.get(",".join(map(str, u))) for u in units.tolist())]
        return units[np.array(keep, dtype=bool)]

    def partitions(self) -> list[InputPartition]:
        runs = BoxPlan(self.meta, self.bounds).runs(self.partition_bytes, self.most)
        return [Part(r) for r in runs] or [Part(None)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if (run := partition.run) is None:
            return
        plan, store = BoxPlan(self.meta, self.bounds), open_store(self.meta.root, read_only=True)
        chain = Chain(self.meta.codecs, self.meta.dtype, self.meta.unit_shape)
        for number in range(run.first, run.stop):
            file = plan.file(number)
            units = self._in_zone(store, file, plan.units(file, run.part, run.parts))
            if not len(units):
                continue
            found = locate(self.meta, store, file, units, whole_up_to=self.max_fused)
            for read in payloads(self.meta, store, file, found, max_fused_bytes=self.max_fused, max_gap_bytes=self.max_gap):
                if self.chunks:
                    yield self._encoded(read)
                else:
                    arrays = chain.decode_batch([p for _, p in read], [f"{self.meta.root} {u}" for u, _ in read])
                    for (unit, _), values in zip(read, arrays):
                        yield from self._cells(unit, values)
            if self.fill:
                for unit in found.units[~found.stored].tolist():
                    yield from self._cells(tuple(unit), None)

    def _encoded(self, read: list[tuple[tuple[int, ...], bytes]]) -> pa.RecordBatch:
        cols = [pa.array([u[i] for u, _ in read], pa.int64()) for i in range(self.meta.ndim)]
        raw = pa.array([self.meta.unit_nbytes] * len(read), pa.int64())
        return pa.RecordBatch.from_arrays([*cols, pa.array([p for _, p in read], pa.binary()), raw], names=[*(f"g{i}" for i in range(self.meta.ndim)), "payload", "raw_nbytes"])

    def _cells(self, unit: tuple[int, ...], values: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """The box's cells of a unit, fill without values."""
        box = clip(self.meta, unit, self.bounds)
        shape = tuple(hi - lo for lo, hi in box)
        if values is not None:
            inside = values[tuple(slice(lo - c * k, hi - c * k) for (lo, hi), c, k in zip(box, unit, self.meta.unit_shape))]
            flat = np.ascontiguousarray(inside).ravel()
        else:
            flat = np.full(int(np.prod(shape, dtype=np.int64)), self.meta.fill_value, dtype=self.meta.dtype)
        names = [*(f"c{i}" for i in range(self.meta.ndim)), "v"]
        for lo in range(0, flat.size, BATCH_CELLS):
            hi = min(flat.size, lo + BATCH_CELLS)
            at = np.unravel_index(np.arange(lo, hi), shape) if shape else ()
            yield pa.RecordBatch.from_arrays([*(pa.array(a.astype(np.int64) + o) for a, (o, _) in zip(at, box)), _column(flat[lo:hi])], names=names)


class Written(WriterCommitMessage):
    def __init__(self, files: int):
        self.files = files


class GridWriter(DataSourceArrowWriter):
    """One file for each chunk, or for each run of rows of one shard. A file appears under its name when it is whole."""

    def __init__(self, meta: ArrayMeta):
        self.meta, self.store = meta, open_store(meta.root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        open_file, units, files = None, {}, 0
        self.zones: dict[str, list[float]] | None = None
        per = self.meta.units_per_file
        for batch in iterator:
            cols = [batch.column(f"g{i}").to_pylist() for i in range(self.meta.ndim)]
            payloads = batch.column("payload")
            zones = batch.column("zone").to_pylist() if "zone" in batch.schema.names else None
            for i, unit in enumerate(zip(*cols) if cols else [()] * len(batch)):
                payload = payloads[i].as_py()
                file = tuple(c // n for c, n in zip(unit, per))
                if file != open_file:
                    files += self._flush(open_file, units)
                    open_file, units = file, {}
                if payload is not None:
                    units[tuple(c % n for c, n in zip(unit, per))] = payload
                    if zones is not None:
                        self.zones = self.zones if self.zones is not None else {}
                        self.zones[",".join(map(str, unit))] = zones[i]
        files += self._flush(open_file, units)
        return Written(files)

    def _flush(self, file: tuple[int, ...] | None, units: dict[tuple[int, ...], bytes]) -> int:
        if file is None or not units:
            return 0
        key, zones = self.meta.chunk_key(file), self.zones
        self.zones = None
        known = read_zones(self.store, key)
        if known:  # until the file is there, its zone map says nothing
            self.store.set(f"{key}{ZONES}", b"{}")
        self.store.set(self.meta.chunk_key(file), shard_bytes(self.meta, units) if self.meta.sharding else next(iter(units.values())))
        if zones is not None:  # a unit that was carried over as it was has the zone it had
            held = {u: z if z is not None else known.get(u) for u, z in zones.items()}
            self.store.set(f"{key}{ZONES}", json.dumps({u: z for u, z in held.items() if z is not None}).encode())
        return 1

    def commit(self, messages) -> None:
        clear_plan_cache()

    def abort(self, messages) -> None:
        pass


#: Behind a file's key, the key of its zone map: JSON with the least and greatest value of each unit by its coordinates.
ZONES = ".zones"


def read_zones(store, key: str) -> dict[str, list[float]]:
    """A file's zone map; empty if there is none."""
    data = store.get(f"{key}{ZONES}")
    return json.loads(data) if data else {}


def _zone(a: np.ndarray) -> list[float] | None:
    """Least and greatest value, as doubles that are not inside them; none if there is no order or not all are finite."""
    if not a.size or a.dtype.kind not in "iuf":
        return None
    low, high = a.min().item(), a.max().item()
    lo, hi = float(low), float(high)
    if not (np.isfinite(lo) and np.isfinite(hi)):
        return None
    return [lo if lo <= low else float(np.nextafter(lo, -np.inf)), hi if hi >= high else float(np.nextafter(hi, np.inf))]


def shard_bytes(meta: ArrayMeta, units: dict[tuple[int, ...], bytes]) -> bytes:
    """A shard file: the units one after the other and the index of offsets and lengths, at the start or the end."""
    per = meta.units_per_file
    index = np.full((*per, 2), ABSENT, dtype="<u8")
    head = index.nbytes + 4 * meta.sharding.index_crc if meta.sharding.at_start else 0
    at, body = head, []
    for u in sorted(units):
        index[u] = at, len(units[u])
        at += len(units[u])
        body.append(units[u])
    raw = index.tobytes()
    if meta.sharding.index_crc:
        raw += crc32c(raw).to_bytes(4, "little")
    return b"".join([raw, *body] if meta.sharding.at_start else [*body, raw])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filter pushdown, and the package to its workers."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridDataSource)


def create(root: str, *, overwrite: bool = False, **metadata) -> ArrayMeta:
    """Write ``zarr.json`` (arguments of :func:`ndgrid.plans.meta.make_metadata`). Chunks that no one writes are fill."""
    store, doc = open_store(str(root)), make_metadata(**metadata)
    meta = from_metadata(doc, str(root))
    Chain(meta.codecs, meta.dtype, meta.unit_shape)  # before anything is written: are all codecs known
    if store.size("zarr.json") is not None:
        if not overwrite:
            raise FileExistsError(f"{root}/zarr.json")
        store.clear()
    store.set("zarr.json", json.dumps(doc, indent=1).encode())
    clear_plan_cache()
    return meta


def to_chunks(cells: DataFrame, meta: ArrayMeta, *, zones: bool = False) -> DataFrame:
    """Cells -> encoded units. Cells that are missing from a unit are fill; a unit without cells is not stored.

    With ``zones`` there is a column ``zone`` with the least and greatest value, which becomes the files' zone maps. Each unit is one group: its cells meet in one task as two Arrow columns, which the chunk shape bounds.
    """
    ship(cells.sparkSession)
    n, unit, dtype, fill_value = meta.ndim, meta.unit_shape, meta.dtype, meta.fill_value
    codecs, nbytes = list(meta.codecs), meta.unit_nbytes

    def encode(key, table):
        a = np.full(unit, fill_value, dtype=dtype)
        at = tuple(table.column(f"c{i}").to_numpy() % k for i, k in enumerate(unit))
        a[at] = np.array([int(x) for x in table.column("v").to_pylist()] if dtype.name == "uint64" else table.column("v").to_numpy(), dtype=dtype).reshape(a[at].shape)
        cols = {f"g{i}": pa.array([k.as_py()], pa.int64()) for i, k in enumerate(key)}
        out = {**cols, "payload": pa.array([Chain(codecs, dtype, unit).encode(a)], pa.binary()), "raw_nbytes": pa.array([nbytes], pa.int64())}
        return pa.table(out | ({"zone": pa.array([_zone(a)], pa.list_(pa.float64()))} if zones else {}))

    at = ", ".join(f"g{i} bigint" for i in range(n))
    rows = cells.select(*ops.axes(n), "v").withColumns({f"g{i}": g for i, g in enumerate(ops.chunk_of(unit))})
    return rows.groupBy(*[f"g{i}" for i in range(n)]).applyInArrow(encode, f"{at}{', ' if n else ''}payload binary, raw_nbytes bigint{', zone array<double>' if zones else ''}")


def write_chunks(chunks: DataFrame, meta: ArrayMeta) -> None:
    """Write encoded units; those of one shard file meet in one task, in order."""
    register(chunks.sparkSession)
    keys = [f"g{i}" for i in range(meta.ndim)]
    if meta.sharding:
        file = [F.expr(f"{g} div {n}") for g, n in zip(keys, meta.units_per_file)]
        chunks = chunks.repartition(*file).sortWithinPartitions(*file, *keys)
    chunks.select(*keys, "payload", *(["zone"] if "zone" in chunks.columns else [])).write.format("ndgrid").mode("append").save(meta.root)


def write_cells(cells: DataFrame, root: str, *, zones: bool = False, **metadata) -> ArrayMeta:
    """Create an array and write cells to it, with ``zones`` also zone maps, by which reads with a limit on v skip units."""
    meta = create(root, **metadata)
    write_chunks(to_chunks(cells, meta, zones=zones), meta)
    return meta


def write_region(patch: DataFrame, root: str, bounds: Bounds | None = None) -> None:
    """Overwrite some cells of an array. ``bounds`` is a box around them; without it one is looked for in ``patch``.

    Only units that the box touches are decoded, and of the array only the files that hold them are read at all. A
    shard is written whole, with the payloads of its other units as they are. The new files' contents are complete in
    the shared folder before any old file is replaced.
    """
    spark, meta = patch.sparkSession, open_meta(root)
    register(spark)
    n, names, keys = meta.ndim, ops.axes(meta.ndim), [f"g{i}" for i in range(meta.ndim)]
    if bounds is None and n:
        edges = patch.agg(*[f(c).alias(f"{f.__name__}{c}") for c in names for f in (F.min, F.max)]).first()
        if edges[0] is None:
            return
        bounds = tuple((edges[2 * i], edges[2 * i + 1] + 1) for i in range(n))
    units = cells_to_grid(bounds or (), meta.unit_shape)
    if any(hi <= lo for lo, hi in units):
        return
    old = spark.read.format("ndgrid").load(meta.root)
    new = patch.select(*names, F.col("v").cast(old.schema["v"].dataType).alias("v"))
    if n:
        new = ops.overwrite(ops.box(old, grid_to_cells(units, meta.unit_shape, meta.shape), shift=False), new, n)
    # Files keep zone maps if they have any: those of new units are made, those of others stay.
    chunks = to_chunks(new, meta, zones=True).select(*keys, "payload", "zone")
    if meta.sharding:
        files = cells_to_grid(grid_to_cells(units, meta.unit_shape, meta.shape), meta.chunk_shape)
        inside = [(F.col(g) >= lo) & (F.col(g) < hi) for g, (lo, hi) in zip(keys, units)]
        stored = spark.read.format("ndgrid").option("view", "chunks").load(meta.root)
        for g, (lo, hi), k in zip(keys, files, meta.units_per_file):
            stored = stored.where(F.col(g) >= lo * k).where(F.col(g) < hi * k)
        touched = inside[0] if inside else F.lit(True)
        for x in inside[1:]:
            touched &= x
        chunks = chunks.unionByName(stored.where(~touched).select(*keys, "payload", F.lit(None).cast("array<double>").alias("zone")))
    write_chunks(cut(chunks, "region"), meta)


def read_box(spark: SparkSession, meta: ArrayMeta, bounds: Bounds, *, filled: bool = True, **options) -> DataFrame:
    """Cells of a box with coordinates of the array; those of units that are not stored have the fill value."""
    register(spark)
    given = {k: str(v) for k, v in options.items() if v is not None} | {"fill": str(filled)}
    return ops.box(spark.read.format("ndgrid").options(**given).load(meta.root), bounds, shift=False)

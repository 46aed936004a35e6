"""The cell view of an array (c0 .. c{n-1}, v) and what selection, chunks and fill values mean on it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ndgrid.plans.selection import Bounds, Points, Stepped

#: Index lists of up to this many positions are sent along with the plan; longer ones are joined as a table.
MAX_LITERAL_POINTS = 10_000


def axes(ndim: int) -> list[str]:
    return [f"c{i}" for i in range(ndim)]


def explode_rows(df: DataFrame, row: str, values: str) -> DataFrame:
    """One array per row -> cells of a two-dimensional array."""
    return df.select(F.col(row).cast("bigint").alias("c0"), F.posexplode(values).alias("p", "v")).select("c0", F.col("p").cast("bigint").alias("c1"), "v")


def box(cells: DataFrame, bounds: Bounds, *, shift: bool = True, drop: tuple[int, ...] = ()) -> DataFrame:
    """The cells within ``bounds``, moved to the origin. Axes in ``drop`` lose their column, as integers do in numpy."""
    names = axes(len(bounds))
    keep = [F.col(c) >= lo for c, (lo, _) in zip(names, bounds)] + [F.col(c) < hi for c, (_, hi) in zip(names, bounds)]
    for k in keep:
        cells = cells.where(k)
    left = [(c, lo) for i, (c, (lo, _)) in enumerate(zip(names, bounds)) if i not in drop]
    cols = [(F.col(c) - lo if shift and lo else F.col(c)).cast("bigint").alias(f"c{i}") for i, (c, lo) in enumerate(left)]
    return cells.select(*cols, "v")


def numbered(positions: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(old) distinct positions -> (old, new): their place in ascending order, from 0.

    Positions are counted for each ``block`` of them; a window over those counts and one within each block do the rest,
    so no task sees all positions.
    """
    rows = positions.select(F.col("old").cast("bigint").alias("old"), F.expr(f"old div {block}").alias("b"))
    before = W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("b").count().select("b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(W.partitionBy("b").orderBy("old")) - 1
    return rows.withColumn("place", place).join(starts, "b").select("old", (F.col("start") + F.col("place")).cast("bigint").alias("new"))


def take(cells: DataFrame, selection: tuple[Stepped | Points | DataFrame, ...], *, drop: tuple[int, ...] = ()) -> DataFrame:
    """Orthogonal selection: steps become a remainder, masks and lists a join with (old, new) positions.

    Positions that are in a table already, such as those of a mask, may be given as a DataFrame (old, new).
    """
    spark = cells.sparkSession
    for i, a in enumerate(selection):
        c = F.col(f"c{i}")
        if isinstance(a, DataFrame):
            cells = cells.join(a, cells[f"c{i}"] == a["old"]).withColumn(f"c{i}", F.col("new")).drop("old", "new")
        elif isinstance(a, Stepped):
            cells = cells.where((c >= a.start) & (c < a.stop))
            if a.step > 1:
                cells = cells.where((c - a.start) % a.step == 0)
            new = F.expr(f"(c{i} - {a.start}) div {a.step}")
            cells = cells.withColumn(f"c{i}", new.cast("bigint"))
        else:
            pairs = spark.createDataFrame([(old, n) for n, old in enumerate(a.at)], "old bigint, new bigint")
            if len(a.at) <= MAX_LITERAL_POINTS:
                pairs = F.broadcast(pairs)
            cells = cells.join(pairs, cells[f"c{i}"] == pairs["old"]).withColumn(f"c{i}", F.col("new")).drop("old", "new")
    left = [i for i in range(len(selection)) if i not in drop]
    return cells.select(*[F.col(f"c{i}").alias(f"c{k}") for k, i in enumerate(left)], "v")


def chunk_of(chunk_shape: tuple[int, ...]) -> list[Column]:
    """g0 .. g{n-1}: the chunk that holds a cell."""
    return [F.expr(f"c{i} div {k}").cast("bigint").alias(f"g{i}") for i, k in enumerate(chunk_shape)]


def position_in(chunk_shape: tuple[int, ...]) -> Column:
    """Place of a cell in its chunk, in C order."""
    out, step = F.lit(0).cast("bigint"), 1
    for i, k in reversed(list(enumerate(chunk_shape))):
        out = out + F.col(f"c{i}") % k * step
        step *= k
    return out


def selected_units(cells: DataFrame, chunk_shape: tuple[int, ...], bounds: Bounds) -> DataFrame:
    """The chunks that hold a cell of the box."""
    return box(cells, bounds, shift=False).select(*chunk_of(chunk_shape)).distinct()


def chunk_stats(cells: DataFrame, chunk_shape: tuple[int, ...]) -> DataFrame:
    """Cells, least and greatest value of each chunk; partial sums combine before the shuffle."""
    return cells.groupBy(*chunk_of(chunk_shape)).agg(F.count("*").alias("n"), F.min("v").alias("min_v"), F.max("v").alias("max_v"))


def one_chunk(cells: DataFrame, chunk_shape: tuple[int, ...], coords: tuple[int, ...]) -> DataFrame:
    """The cells of a chunk, moved to its origin; at an edge there are fewer, as cells outside of the array do not exist."""
    return box(cells, tuple((g * k, (g + 1) * k) for g, k in zip(coords, chunk_shape)))


def grid(spark: SparkSession, bounds: Bounds) -> DataFrame:
    """Every coordinate of a box, made on the executors from one range of numbers."""
    sizes = [hi - lo for lo, hi in bounds]
    out, step = [], 1
    for i in reversed(range(len(sizes))):
        out.append(F.expr(f"id div {step} % {max(1, sizes[i])} + {bounds[i][0]}").cast("bigint").alias(f"c{i}"))
        step *= max(1, sizes[i])
    return spark.range(math.prod(sizes)).select(*reversed(out))


def fill(cells: DataFrame, bounds: Bounds, value) -> DataFrame:
    """Every cell of the box: the stored value, or ``value`` where none is stored."""
    names, element = axes(len(bounds)), cells.schema["v"].dataType
    full = grid(cells.sparkSession, bounds)
    return full.join(box(cells, bounds, shift=False), names, "left").select(*names, F.coalesce("v", F.lit(value).cast(element)).alias("v"))


def overwrite(cells: DataFrame, patch: DataFrame, ndim: int) -> DataFrame:
    """The array with the cells of ``patch`` in place of its own. Cells that only the patch has are added."""
    names = axes(ndim)
    new = patch.select(*names, F.col("v").alias("new"))
    return cells.join(new, names, "full").select(*names, F.coalesce("new", F.col("v")).cast(cells.schema["v"].dataType).alias("v"))


def pack(cells: DataFrame, chunk_shape: tuple[int, ...]) -> DataFrame:
    """g0 .., vals, places, nulls: the values of each chunk's cells in C order, fewer than its shape has at an edge or
    where cells are missing or null. One chunk's cells meet in one row, which bounds the group.

    ``places`` has each value's place in the chunk and then those of the ``nulls`` cells that hold null; it is null if
    they are 0, 1, 2 and so on, as in a whole chunk.
    """
    row = F.struct(F.col("v").isNull().alias("empty"), position_in(chunk_shape).alias("p"), F.col("v"))
    grouped = cells.groupBy(*chunk_of(chunk_shape)).agg(F.array_sort(F.collect_list(row)).alias("rows"), F.count_if(F.col("v").isNull()).cast("int").alias("nulls"))
    places = F.transform("rows", lambda r: r["p"])
    gapped = places != F.sequence(F.lit(0).cast("bigint"), F.size("rows").cast("bigint") - 1)
    held = F.slice("rows", F.lit(1), F.size("rows") - F.col("nulls"))
    return grouped.select(*[f"g{i}" for i in range(len(chunk_shape))], F.transform(held, lambda r: r["v"]).alias("vals"), F.when(gapped, places).alias("places"), "nulls")


def unpack(chunks: DataFrame, chunk_shape: tuple[int, ...], values: str = "vals") -> DataFrame:
    """Chunks of values with their places and nulls, as :func:`pack` gives them -> cells."""
    n = len(chunk_shape)
    empty = F.array_repeat(F.lit(None).cast(chunks.schema[values].dataType.elementType), F.col("nulls"))
    whole = F.when(F.col("nulls") == 0, F.col(values)).otherwise(F.concat(values, empty))
    cells = chunks.select(*[f"g{i}" for i in range(n)], "places", F.posexplode(whole).alias("i", "v"))
    cells = cells.select("*", F.when(F.col("places").isNull(), F.col("i")).otherwise(F.col("places")[F.col("i")]).cast("bigint").alias("p"))
    cols, step = [], 1
    for i in reversed(range(n)):
        along = f"floor(p / {step})"  # below 0 where the first coordinate is
        cols.append(F.expr(f"g{i} * {chunk_shape[i]} + {along if i == 0 else f'pmod({along}, {chunk_shape[i]})'}").cast("bigint").alias(f"c{i}"))
        step *= chunk_shape[i]
    return cells.select(*reversed(cols), "v")

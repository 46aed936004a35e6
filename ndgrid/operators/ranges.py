"""Shard indexes and range coalescing over DataFrames: one row for each unit that is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shard_index(units: DataFrame, shard: list[str], unit: str = "u", nbytes: str = "nbytes") -> DataFrame:
    """``off`` of each unit in its shard, units one after the other. A shard's units are one window partition."""
    before = W.partitionBy(*shard).orderBy(unit).rowsBetween(W.unboundedPreceding, -1)
    return units.withColumn("off", F.coalesce(F.sum(nbytes).over(before), F.lit(0)).cast("bigint"))


def islands(units: DataFrame, shard: list[str], *, max_gap_bytes: int = 0) -> DataFrame:
    """Fused reads without a length limit: gaps and islands over the running end. shard columns, off, fin, k."""
    if max_gap_bytes < 0:
        raise ValueError("max_gap_bytes must not be negative")
    order = W.partitionBy(*shard).orderBy("off", "u")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    fin = F.col("off") + F.col("nbytes")
    starts = F.coalesce(F.col("off") - F.max("fin").over(before) > max_gap_bytes, F.lit(True))
    marked = units.withColumn("fin", fin).withColumn("new", starts.cast("int"))
    return marked.withColumn("island", F.sum("new").over(order)).groupBy(*shard, "island").agg(F.min("off").alias("off"), F.max("fin").alias("fin"), F.count("*").alias("k")).drop("island")


def capped(units: DataFrame, shard: list[str], *, max_fused_bytes: int, max_gap_bytes: int = 0) -> DataFrame:
    """Fused reads of at most ``max_fused_bytes``: a fold over each shard's ranges in order of offset.

    The state is the finished reads and the open one. An empty or oversized range closes the open read and stands
    alone. A shard's ranges meet in one row; their number is that of the units in a shard file.
    """
    if max_fused_bytes <= 0:
        raise ValueError("max_fused_bytes must be positive")
    if max_gap_bytes < 0:
        raise ValueError("max_gap_bytes must not be negative")
    read = "struct<off:bigint,fin:bigint,k:bigint>"
    start = F.struct(F.array().cast(f"array<{read}>").alias("done"), F.lit(None).cast(read).alias("open"))

    def make(off, fin, k):
        return F.struct(off.cast("bigint").alias("off"), fin.cast("bigint").alias("fin"), k.cast("bigint").alias("k"))

    def closed(acc):
        return F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))

    def step(acc, x):
        own = make(x["off"], x["off"] + x["nbytes"], F.lit(1))
        fin = F.greatest(acc["open"]["fin"], own["fin"])
        alone = (x["nbytes"] == 0) | (x["nbytes"] > max_fused_bytes)
        fits = acc["open"].isNotNull() & (x["off"] - acc["open"]["fin"] <= max_gap_bytes) & (fin - acc["open"]["off"] <= max_fused_bytes)
        state = lambda done, open_: F.struct(done.alias("done"), open_.alias("open"))
        return (
            F.when(alone, state(F.array_append(closed(acc), own), F.lit(None).cast(read)))
            .when(fits, state(acc["done"], make(acc["open"]["off"], fin, acc["open"]["k"] + 1)))
            .otherwise(state(closed(acc), own))
        )

    rows = F.array_sort(F.collect_list(F.struct("off", "u", "nbytes")))
    folded = units.groupBy(*shard).agg(rows.alias("rows")).select(*shard, F.aggregate("rows", start, step, closed).alias("reads"))
    return folded.select(*shard, F.inline("reads"))

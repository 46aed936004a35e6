"""Connected components of links between 64-bit nodes, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ndgrid.runtime import cut, remove


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    return out.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its neighbours below it are tied to the least of them. Edges come with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    below = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links of bigint nodes -> (node, root): each node's least reachable node; roots themselves have no row.

    A node with a third of all links is no bottleneck: minima combine before the shuffle, and the joins are plain
    equi-joins that adaptive execution splits. Every round is written to the shared folder and the one before it
    deleted; the number of rounds grows with the logarithm of the longest path. Null nodes and loops are left out.
    """
    spark = links.sparkSession
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "cc-edges")
    path, state = edges.inputFiles(), None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(mark) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(mark)
        if not mark.n:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        after = cut(_small_star(_large_star(edges)), "cc-edges")
        if path:
            remove(spark, path[0].rsplit("/", 1)[0])
        edges, path = after, after.inputFiles()

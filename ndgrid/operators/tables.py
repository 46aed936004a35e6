"""The test tables as arrays: embeddings is N by 64 float32, events.value is a vector by its dense event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ndgrid.operators.cells import explode_rows

#: Chunks and shards of the embeddings array; chunks of the events vector.
CHUNK, SHARD, EVENT_CHUNK = (50, 16), (250, 32), 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("bigint").alias("c0"), F.col("value").alias("v"))

"""Token ids as ORC: integer run-length encoding, row indexes and Bloom filters on the document id.

A written set of shards is a folder of ORC files, one row for each document, in ascending order of the id or in an
order that is given:

    doc_id     the document's id; has the Bloom filter, and min and max in each stripe and row group
    shard      number of the range partition that holds the row; shards ascend with the order
    position   number of the row in its shard
    offset     ids in the shard before this row
    n_tokens   ids in this row
    ids        array<int>, run-length encoded by ORC (RLEv2)

The ids of all documents before a row are the totals of the shards before its own plus ``offset``, so any stripe can
be read on its own, and a reader of one document skips files, stripes and row groups by their metadata.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ndgrid.llm.tokenize import encoder
from ndgrid.runtime import lean, ship

#: Text bytes aimed at in one shard, and the most shards there are: beyond it each is larger. Only the number of shards
#: depends on these. It bounds the shuffle's partitions, the files, and the table of the shards' starts.
SHARD_TEXT_BYTES = 24 << 20
MAX_SHARDS = 20_000
#: Options of the ORC writer.
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "zstd"}

ROW = "shard int, position bigint, offset bigint, n_tokens bigint, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, shard_bytes: int = SHARD_TEXT_BYTES, order: list[Column] | None = None) -> None:
    """Encode every whole text, append ``end_id`` and write the shards under ``path``.

    Rows stand in ascending order of their id, or by the columns ``order`` and then their id. One range shuffle puts
    them there; its bounds are ids, hashes and ``order``, so the driver never samples texts.
    Encoding and writing then happen in the same task, so ids are never shuffled. The tokenizer's file is read on the
    driver and broadcast (a vocabulary, of fixed size).

    Defined cases: a null text is empty and has the end id alone; a null id sorts first; rows with the same id sort by
    a hash of the text, then by the text (null as empty), and each keep their row; an empty table writes an empty set;
    extra columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    key = f"{tokenizer_path}:{end_id}"
    before = [f"o{i}" for i in range(len(order or []))]
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *[c.alias(n) for c, n in zip(order or [], before)])
    size = rows.select(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    shards = min(MAX_SHARDS, max(1, -(-size // shard_bytes)))

    def run(batches):
        from pyspark import TaskContext

        shard, position, offset = TaskContext.get().partitionId(), 0, 0
        enc = encoder(key, vocabulary.value, end_id)
        for batch in batches:
            ids = enc.ids(batch.column(1))
            n = pc.list_value_length(ids).cast(pa.int64())
            after = offset + np.cumsum(n.to_numpy(zero_copy_only=False))
            rows = len(batch)
            if rows:
                first = np.concatenate(([offset], after[:-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(rows, shard, dtype=np.int32)), pa.array(np.arange(position, position + rows)), pa.array(first), n, ids], names=["doc_id", "shard", "position", "offset", "n_tokens", "ids"])
                position, offset = position + rows, int(after[-1])

    kind = rows.schema["doc_id"].dataType.simpleString()
    place = [*map(F.col, before), F.col("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(int(shards), *place).sortWithinPartitions(*place, F.col("text")).select("doc_id", "text")
    out = ordered.mapInArrow(lean(run), f"doc_id {kind}, {ROW}")
    out.write.options(**ORC_OPTIONS).orc(path)


def shard_starts(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(shard, ids of all shards before it), from the n_tokens column alone: MAX_SHARDS rows at most."""
    totals = sorted((r.shard, r.n) for r in spark.read.orc(path).groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    starts, n = [], 0
    for shard, k in totals:
        starts.append((shard, n))
        n += k
    return starts


def with_starts(rows: DataFrame, path: str) -> DataFrame:
    """Rows of ``path`` that have shard and offset, with ``start``: the ids of all documents before each.

    The starts are broadcast, 12 bytes for each of MAX_SHARDS shards at most.
    """
    starts = rows.sparkSession.createDataFrame(shard_starts(rows.sparkSession, path), "shard int, start bigint")
    return rows.join(F.broadcast(starts), "shard").withColumn("start", F.col("start") + F.col("offset"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every row, with its place. Stripes are read in parallel, in any order."""
    return with_starts(spark.read.orc(path), path)


def read_document(spark: SparkSession, path: str, doc_id) -> DataFrame:
    """The rows of one document: min and max and the Bloom filter let the reader skip the rest."""
    return spark.read.orc(path).where(F.col("doc_id") == F.lit(doc_id))


def ids_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned, of the ids as little-endian 32-bit integers), from the files.

    Ids go from the reader straight to the checksum; only their digests are joined with the shards' starts.
    """
    ship(spark)

    def run(batches):
        for batch in batches:
            ids = batch.column(4)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = ids.offsets.to_numpy()
            at = (at - at[0]).tolist()
            view = memoryview(np.ascontiguousarray(flat)).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, type=pa.int64())], names=["doc_id", "shard", "offset", "n_tokens", "ids_crc32"])

    rows = spark.read.orc(path).select("doc_id", "shard", "offset", "n_tokens", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    digests = rows.mapInArrow(lean(run), f"doc_id {kind}, shard int, offset bigint, n_tokens bigint, ids_crc32 bigint")
    return with_starts(digests, path).select("doc_id", "start", "n_tokens", "ids_crc32")

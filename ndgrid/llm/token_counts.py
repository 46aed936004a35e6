"""Delta-maintained token counts by source, language and tokenizer version.

A ledger under ``root`` holds, as Parquet:

    counts/batch=ID   doc, source, lang, version, tokens, sign: what each document's count was changed by
    deltas/batch=ID   source, lang, version, docs, tokens: the signed sum of the batch for each group

An insert adds +1 document and its tokens to its group. A revision takes the document's former row out of its group
(sign -1) and puts the new one in. A delete only takes out. Totals are the sum of all deltas, so a batch costs its own
rows and a lookup of the former ones, never a recount. A batch's folders are named by its id: a batch that is already
in ``deltas`` is left alone, and one that failed half way is written over. The lookup reads the history's ids and takes
on only the rows of the batch's documents; after ledger.MAX_PARTS batches the history is compacted to the rows that
still count, so it grows with the documents and not with the batches. Batches of one ledger come one after the other.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ndgrid.llm import ledger
from ndgrid.llm.rows import map_texts
from ndgrid.llm.tokenize import encoder

COUNTS = "doc string, source string, lang string, version string, tokens bigint, sign int"
DELTAS = "source string, lang string, version string, docs bigint, tokens bigint"


def batches(spark: SparkSession, root: str) -> list[str]:
    """The ids of the batches that are whole: their deltas, written last, are there."""
    return [n.removeprefix("batch=") for n in ledger.whole(spark, f"{root}/deltas")]


def _parts(spark: SparkSession, root: str) -> tuple[list[str], list[str]]:
    """(paths of the signed rows of whole batches, names of those outside of the base). What a failed one left is not read."""
    done = {f"batch={b}" for b in batches(spark, root)}
    paths, loose = ledger.live(spark, f"{root}/counts")
    return [p for p in paths if p.rsplit("/", 1)[1] not in set(loose) - done], [n for n in loose if n in done]


def count_tokens(docs: DataFrame, tokenizer_path: str, *, text: str = "text", keep: list[str]) -> DataFrame:
    """``keep`` in a struct ``row`` and ``tokens`` of the whole text. No shuffle.

    Defined cases: a null or empty text has 0 tokens; every row in gives one row out, repeated or not; an empty table
    gives an empty result; columns of any name may be kept, as they stay inside ``row``.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        enc = encoder(tokenizer_path, vocabulary.value)
        return lambda texts: [pc.list_value_length(enc.ids(texts)).cast(pa.int64())]

    return map_texts(docs, text, keep, make, "tokens bigint")


def current(spark: SparkSession, root: str, docs: DataFrame | None = None) -> DataFrame:
    """doc, source, lang, version, tokens, docs of every document as of the last batch: rows whose signs do not cancel.

    With ``docs`` (a column doc of keys) only theirs: the history's other rows are dropped before anything is grouped.
    """
    rows = ledger.read_paths(spark, _parts(spark, root)[0], COUNTS)
    if docs is not None:
        rows = rows.join(docs, "doc", "left_semi")
    live = rows.groupBy("doc", "source", "lang", "version", "tokens").agg(F.sum("sign").cast("bigint").alias("docs"))
    return live.where("docs > 0")


def compact(spark: SparkSession, root: str) -> None:
    """Replace the history by the rows that still count, a sign for each."""
    names = _parts(spark, root)[1]
    signed = current(spark, root).select("doc", "source", "lang", "version", "tokens", F.col("docs").cast("int").alias("sign"))
    ledger.compact(spark, f"{root}/counts", signed.repartitionByRange("doc").sortWithinPartitions("doc"), names)


def commit(counted: DataFrame, root: str, batch: str, *, version: str, deleted: DataFrame | None = None) -> bool:
    """Apply a batch: ``counted`` has doc, source, lang and tokens of new and revised documents, ``deleted`` has doc.

    Returns False, and changes nothing, if the batch is already there. Other versions' counts are left as they are.

    Defined cases: source and lang may be null and are a group then; a null doc is a key of its own; several rows of
    one doc in a batch all count, and a revision or delete takes all of them out; deleting what is not there does
    nothing; a document both deleted and counted in a batch is revised; an empty batch is recorded as empty.
    """
    spark = counted.sparkSession
    before = batches(spark, root)
    if batch in before:
        return False
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("null"))
    new = counted.select(key("doc").alias("doc"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("version"), F.col("tokens").cast("bigint").alias("tokens"), F.lit(1).alias("sign"))
    at = f"{root}/incoming/batch={batch}"
    new.write.mode("overwrite").parquet(at)
    new = spark.read.parquet(at).select("doc", "source", "lang", "version", "tokens", "sign")
    touched = new.select("doc")
    if deleted is not None:
        touched = touched.union(deleted.select(key("doc").alias("doc")))
    changes = new
    if before:
        former = current(spark, root, touched.distinct()).where(F.col("version") == version)
        out = former.select("doc", "source", "lang", "version", "tokens", (-F.col("docs")).cast("int").alias("sign"))
        changes = new.union(out)
    at = f"{root}/counts/batch={batch}"
    changes.write.mode("overwrite").parquet(at)
    done = spark.read.parquet(at)
    sums = done.groupBy("source", "lang", "version").agg(F.sum("sign").cast("bigint").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).cast("bigint").alias("tokens"))
    sums.write.mode("overwrite").parquet(f"{root}/deltas/batch={batch}")
    if len(_parts(spark, root)[1]) >= ledger.MAX_PARTS:
        compact(spark, root)
    return True


def totals(spark: SparkSession, root: str) -> DataFrame:
    """source, lang, version, docs, tokens: the sum of all batches' deltas; groups without documents are left out."""
    paths = [f"{root}/deltas/batch={b}" for b in batches(spark, root)]
    rows = ledger.read_paths(spark, paths, DELTAS)
    return rows.groupBy("source", "lang", "version").agg(F.sum("docs").cast("bigint").alias("docs"), F.sum("tokens").cast("bigint").alias("tokens")).where("docs <> 0")


def rebuild(spark: SparkSession, root: str) -> DataFrame:
    """The totals counted anew from the documents' rows; equal to :func:`totals`."""
    return current(spark, root).groupBy("source", "lang", "version").agg(F.sum("docs").cast("bigint").alias("docs"), F.sum(F.col("docs") * F.col("tokens")).cast("bigint").alias("tokens"))

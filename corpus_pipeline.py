"""A training-corpus pipeline over ``documents``: language ID, near-dedup, decontamination, mixing, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ndgrid.llm import decontaminate, langid, mixing, queries, simhash, token_orc
from ndgrid.runtime import cut, shared_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without a letter go, and with them null and empty texts.

    Repeated rows each stay or go; an empty table stays empty; columns that are not the text's are passed on.
    """
    found = langid.identify(docs, queries.language_model(docs))
    return found.where(F.col("lang_pred") != "und").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link: that with the smallest id, null last.

    Of repeated rows one stays; a null or empty text is in the group of fingerprint zero; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with fewer than one word in twenty inside a window of a benchmark item.

    Null and empty texts stay, as they hold no item; repeated rows each stay or go; an empty table stays empty.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_contamination(docs, items).where(~decontaminate.contaminated()).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, shard after shard and shuffled within, as often as their source's target takes them.

    Texts without words are in no shard; a null source is a source; a column ``n_chars`` follows the text that is left.
    """
    out = mixing.mixed_documents(docs, mixing.mix(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns, read back from them, each document's place and digest.

    Rows stand as in the files that ``docs`` is read from, so the token files hold the mix's shards in their order. A
    null text has the end id alone; a table that is not read from files, or an empty one, goes by id.
    """
    path = shared_path(spark, "pipeline-tokens")
    order = [F.col("_metadata.file_name"), F.col("_metadata.row_index")] if _from_files(docs) else None
    token_orc.write_tokens(docs, path, queries.tokenizer_path(), order=order)
    return token_orc.ids_digest(spark, path)


def _from_files(docs: DataFrame) -> bool:
    """Is this a table as it is read, whose rows know their file and place in it."""
    plan = docs._jdf.queryExecution().analyzed()
    return plan.getClass().getSimpleName() == "LogicalRelation" and bool(docs.inputFiles())


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mix", mix), ("token_files", token_files)]

#: SQL has none of language models, XXH64, drawn mixes or tokenizers: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's rows written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

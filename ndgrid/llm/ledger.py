"""Folders of a ledger: whole ones, and a base that stands for many of them.

A table of a ledger is a folder of parts. A part is whole once Spark's ``_SUCCESS`` is in it; others are left by a
failed job and never read. Parts are never changed. Compaction writes their rows as one base and, last, the list of the
parts that it covers; readers take the base that covers most and the whole parts that it does not cover.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Parts beside the base from which on a ledger is compacted.
MAX_PARTS = 32


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def whole(spark: SparkSession, table: str) -> list[str]:
    """Names of the whole parts of a table."""
    fs, p = _path(spark, f"{table}/*/_SUCCESS")
    return sorted(f.getPath().getParent().getName() for f in fs.globStatus(p) or [])


def _covered(spark: SparkSession, table: str) -> dict[str, set[str]]:
    """The bases and the parts that each covers."""
    fs, p = _path(spark, f"{table}-base/*/covers")
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString
    out = {}
    for f in fs.globStatus(p) or []:
        stream = fs.open(f.getPath())
        out[f.getPath().getParent().getName()] = set(text(stream, "UTF-8").splitlines())
        stream.close()
    return out


def live(spark: SparkSession, table: str) -> tuple[list[str], list[str]]:
    """(paths that hold the rows, names of the whole parts that no base covers)."""
    bases = _covered(spark, table)
    best = max(bases, key=lambda b: (len(bases[b]), b), default=None)
    loose = [n for n in whole(spark, table) if best is None or n not in bases[best]]
    return [*([f"{table}-base/{best}/rows"] if best else []), *(f"{table}/{n}" for n in loose)], loose


def read(spark: SparkSession, table: str, schema: str) -> DataFrame:
    paths, _ = live(spark, table)
    return read_paths(spark, paths, schema)


def read_paths(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def compact(spark: SparkSession, table: str, rows: DataFrame, names: list[str]) -> None:
    """Write ``rows``, made of the base and the parts ``names``, as the next base. Other parts are not covered by it."""
    at = f"{table}-base/{uuid.uuid4().hex}"
    covered = set(names).union(*_covered(spark, table).values())
    rows.write.parquet(f"{at}/rows")
    fs, p = _path(spark, f"{at}/covers")
    out = fs.create(p)
    out.write(bytearray("\n".join(sorted(covered)).encode()))
    out.close()

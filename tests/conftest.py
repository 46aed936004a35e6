import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    from ndgrid.runtime import clean_shared

    clean_shared(s)
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def same_rows(spark_frame, duck_frame) -> None:
    """Equal column names and equal rows, in any order."""
    assert sorted(spark_frame.columns) == sorted(duck_frame.columns)
    cols = sorted(spark_frame.columns)
    ours, theirs = (sorted(map(repr, f[cols].itertuples(index=False, name=None))) for f in (spark_frame, duck_frame))
    assert ours == theirs

"""The registered queries over their whole tables."""

import numpy as np
import pytest

import corpus_pipeline
from conftest import same_rows
from ndgrid.llm import decontaminate, langid, queries, simhash
from ndgrid.runtime import cut


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf, duck, name):
    same_rows(queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df())


def test_ten_queries_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op4_bitsliced_topk", "op9_token_rollups")])
def test_one_row_for_each_document(spark, sf, name):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert queries.QUERIES[name](spark, sf).count() == n


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_quality_ranking(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean() > 0.8


def test_held_out_language(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.9


def test_pipeline_stages(spark, sf):
    """Each stage keeps just what its operator says about its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = cut(stages["language"](spark, docs, sf), "t1")
    gone = docs.join(first, "doc_id", "left_anti").collect()
    assert all(not any(c.isalpha() for c in r.text or "") for r in gone)
    second = cut(stages["near_dedup"](spark, first, sf), "t2")
    comps = simhash.near_duplicates(first).select("component_id").distinct().count()
    assert second.count() == comps and simhash.near_duplicates(second).where("doc_id <> component_id").count() == 0
    third = cut(stages["decontamination"](spark, second, sf), "t3")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert third.count() == decontaminate.find_contamination(second, items).where(~decontaminate.contaminated()).count()
    fourth = cut(stages["mix"](spark, third, sf), "t4")
    assert first.columns == second.columns == third.columns == fourth.columns == docs.columns
    assert fourth.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    last = stages["token_files"](spark, fourth, sf).toPandas().sort_values("start")
    assert len(last) == fourth.count()
    assert np.array_equal(last.start.to_numpy()[1:], last.n_tokens.cumsum().to_numpy()[:-1])


def test_folds_are_by_crc32(spark):
    import zlib

    got = {r.i: r.f for r in spark.range(50).selectExpr("id as i").withColumn("f", langid.fold("i")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 for i in range(50)}

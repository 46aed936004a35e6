"""The operators applied to their whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ndgrid.llm import bitsliced, decontaminate, langid, licenses, mixing, quality, secrets, simhash, token_counts, token_orc
from ndgrid.runtime import cut, shared_path


def tokenizer_path() -> str:
    """The vocabulary file of the public word tokenizer; operators take any other path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens-orc")
    token_orc.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_orc.ids_digest(spark, path)


def op3_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.learn(docs, _table(spark, sf_dir, "labels"), lambda i: langid.fold(i) != 2)
    scored = quality.score(docs, model, keep=["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", _held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op4_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return bitsliced.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return hits.select("row.doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "hits.items").cast("binary"), 256).alias("items_sha256"), decontaminate.contaminated("hits").alias("contaminated"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    drawn = F.transform("runs", lambda r: F.concat_ws(":", r["shard"].cast("string"), r["epoch"].cast("string"), r["words"].cast("string")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.array_join(drawn, ",").alias("shards"))


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_path(spark, "secret-ledger")
    secrets.commit(_table(spark, sf_dir, "documents"), root, "1", path="doc_id")
    found = secrets.findings(spark, root, "1")
    listed = found.select(F.col("path").alias("doc_id"), "spans", secrets.spans_text(F.col("spans")).alias("text"))
    counts = [secrets.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return listed.select("doc_id", *counts, F.sha2(F.col("text").cast("binary"), 256).alias("base_sha256"), F.col("text").alias("spans"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string")))
    return found.select("row.doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.array_join(spans, ",").alias("spans"))


def op9_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of all documents, come to through inserts, revisions, deletes and a batch that is sent again.

    Batch 1 inserts the documents outside of fold 3: those of fold 1 filed under no source and language and with one
    token too many, all others as they are. Batch 2 inserts fold 3, revises fold 1 to what it is, and deletes fold 2.
    It comes twice. Batch 3 inserts fold 2 anew. Folds are of the id's crc32.
    """
    root = shared_path(spark, "token-counts")
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id", "source", "lang"])
    rows = cut(counted.select(F.col("row.doc_id").alias("doc"), "row.source", "row.lang", "tokens", F.coalesce(langid.fold("row.doc_id"), F.lit(0)).alias("fold")), "counted")
    draft = F.col("fold") == 1
    blank = lambda c: F.when(~draft, F.col(c)).alias(c)
    first = rows.where("fold <> 3").select("doc", blank("source"), blank("lang"), (F.col("tokens") + draft.cast("int")).alias("tokens"))
    token_counts.commit(first, root, "1", version="word_bpe_49k")
    for _ in range(2):
        token_counts.commit(rows.where("fold in (1, 3)"), root, "2", version="word_bpe_49k", deleted=rows.where("fold = 2").select("doc"))
    token_counts.commit(rows.where("fold = 2"), root, "3", version="word_bpe_49k")
    return token_counts.totals(spark, root)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, language_model(docs), keep=["doc_id"])
    return found.select("row.doc_id", _held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def language_model(docs: DataFrame) -> langid.Model:
    """Fitted on a bounded sample of the labelled documents outside the held-out fold."""
    return langid.fit(docs.where(langid.fold("doc_id") != 2), id_hash=F.xxhash64("doc_id"))


def _held_out(doc_id: str):
    return F.coalesce(langid.fold(doc_id) == 2, F.lit(False))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_token_orc, op3_quality_ranking, op4_bitsliced_topk, op5_decontamination, op6_source_mixing, op7_secret_ledger, op8_license_scan, op9_token_rollups, op10_language_id)}

_OP4 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""

#: Words of a text as DuckDB has them, and every window of ``items`` or of the documents.
_OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
lens AS (SELECT DISTINCT least(len(w), 13) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
m AS (SELECT dw.r, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""

#: A kind's matches and the gaps between them alternate, so their lengths add up to the offsets.
_OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT r, 0 AS o, 'assign' AS kind, 12 AS least, string_split_regex(t, '{assign}') AS gaps, regexp_extract_all(t, '{assign}', 0) AS m, regexp_extract_all(t, '{assign}', 2) AS g FROM d
  UNION ALL SELECT r, 1, 'access', 18, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT r, 2, 'hex', 16, string_split_regex(t, '[0-9a-f]{16,}'), regexp_extract_all(t, '[0-9a-f]{16,}'), regexp_extract_all(t, '[0-9a-f]{16,}') FROM d),
p AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
s AS (SELECT r, o, kind, CAST(list_sum(list_transform(gaps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(m[i]) AS n FROM p WHERE length(g[i]) >= least),
j AS (SELECT r, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) AS spans, count(*) FILTER (o = 0) AS x, count(*) FILTER (o = 1) AS y, count(*) FILTER (o = 2) AS z FROM s GROUP BY r)
SELECT doc_id, CAST(coalesce(x, 0) AS BIGINT) AS n_assign, CAST(coalesce(y, 0) AS BIGINT) AS n_access, CAST(coalesce(z, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (r)""".replace("{assign}", secrets.RULES[0].pattern.replace("'", "''"))

ORACLE_SQL = {"op4_bitsliced_topk": _OP4, "op5_decontamination": _OP5, "op7_secret_ledger": _OP7}

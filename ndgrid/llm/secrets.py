"""Secret scans with an incremental blob ledger, in DataFrame functions alone.

Every version of a file is named by the SHA-256 of its text. The ledger under ``root`` holds, as Parquet:

    paths/commit=ID   path, blob: which blob each path has in that commit
    scans/RUN         blob, rules, spans: what those rules (name and version) found in that blob

A commit scans each distinct blob once, and only with rules that no run has tried on it; findings are then joined back
to every path that holds the blob. What a rule finds in a blob depends on nothing else, so scans are only ever added,
by whichever commit comes first, and serve all others: running a commit again, with the same rows or with other ones,
takes nothing from the rest. A run that failed is not read, and its blobs are scanned again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ndgrid.llm import ledger
from ndgrid.runtime import cut


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose group ``group`` has ``least`` or more characters.

    ``hint`` is a regular expression without which the pattern cannot match. Matches that are too short still use up
    their text, unless the pattern itself rules them out.
    """

    kind: str
    version: int
    pattern: str
    hint: str
    group: int
    least: int

    @property
    def name(self) -> str:
        return f"{self.kind}/{self.version}"


#: Fixed values of the three base rules. A run of 16 or more hexadecimal digits, or of a key id of 18 or more
#: characters, begins where any such run begins, so their lengths stand in the patterns.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", r"AKIA[A-Z0-9]{14}", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", r"[0-9a-f]{16}", 0, 16),
)

SPAN = "struct<kind:string,version:int,start:bigint,end:bigint>"
FOUND = "struct<kind:string,start:bigint,end:bigint>"


def rule_spans(text: Column, rule: Rule) -> Column:
    """array<struct<kind, version, start, end>> of a rule's matches, in code points, end exclusive.

    The text between matches and the matches themselves alternate, so their lengths add up to the offsets.
    """
    gaps = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    parts = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(matches, F.length).alias("len"), F.transform(tested, F.length).alias("ok"))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        span = F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), start.cast("long").alias("start"), (start + p["len"]).cast("long").alias("end"))
        return F.struct((start + F.coalesce(p["len"], F.lit(0))).cast("long").alias("at"), F.when(p["ok"] >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(parts, empty, step, lambda acc: acc["out"])
    return F.when(text.rlike(rule.hint), found).otherwise(F.array().cast(f"array<{SPAN}>"))


SCANS = f"blob binary, rules array<string>, spans array<{SPAN}>"


def scans(spark: SparkSession, root: str) -> DataFrame:
    """blob, rules, spans of all whole runs."""
    return ledger.read(spark, f"{root}/scans", SCANS)


def commit(versions: DataFrame, root: str, commit_id: str, *, path: str = "path", text: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
    """Make the (path, text) rows of ``versions`` the commit's, and scan what is new in them.

    A path may occur with several texts, each a version. One representative (path, blob) row of each blob is scanned,
    found by a join on both columns, so a blob with a third of all rows is no hot key; the only wide rows that are
    shuffled are those of the join. Of the history only names of blobs and rules are read, and the rows of this
    commit's blobs go on: where those are few, they are broadcast by their size and the history is not shuffled.
    After ledger.MAX_PARTS runs the scans are compacted, ordered by blob.

    Defined cases: a null text is empty; a null path is a path of its own; repeated rows are one version; an empty
    table makes an empty commit; a commit that is made again has its last rows; extra columns are ignored.
    """
    spark = versions.sparkSession
    own, body = F.col(f"`{path}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("="), own.cast("string")), F.lit("null"))
    rows = versions.select(own.alias("path"), key.alias("key"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("blob"), body.alias("text"))
    at = f"{root}/paths/commit={commit_id}"
    rows.select("path", "key", "blob").write.mode("overwrite").parquet(at)
    names = F.array(*[F.lit(r.name) for r in rules])
    one = cut(spark.read.parquet(at).groupBy("blob").agg(F.min("key").alias("key")), "secret-blobs")
    known = scans(spark, root).select("blob", "rules").join(one.select("blob"), "blob", "left_semi")
    seen = known.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = one.join(seen, "blob", "left").select("blob", "key", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules"))
    todo = cut(todo.where(F.size("rules") > 0), "secret-todo")
    new = rows.select("key", "blob", "text").join(todo, ["key", "blob"])
    found = [F.when(F.array_contains("rules", r.name), rule_spans(F.col("text"), r)).otherwise(F.array().cast(f"array<{SPAN}>")) for r in rules]
    out = new.select("blob", "rules", F.concat(*found).alias("spans")).dropDuplicates(["blob"])
    out.write.parquet(f"{root}/scans/{uuid.uuid4().hex}")
    if len(ledger.live(spark, f"{root}/scans")[1]) >= ledger.MAX_PARTS:
        compact(spark, root)


def compact(spark: SparkSession, root: str) -> None:
    """Put the scans of all runs together, a row for each blob, in the order of blobs."""
    paths, names = ledger.live(spark, f"{root}/scans")
    both = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("rules", "spans")]
    rows = ledger.read_paths(spark, paths, SCANS).groupBy("blob").agg(*both)
    ledger.compact(spark, f"{root}/scans", rows.repartitionByRange("blob").sortWithinPartitions("blob"), names)


def findings(spark: SparkSession, root: str, commit_id: str, *, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, spans of every path of a commit: what ``rules`` have found in its blob in any run, by start and then kind.

    Blobs without findings are not joined. A blob's path rows are split by adaptive execution if they are many. A
    commit whose last run failed before its paths were whole raises; it has to be made again.
    """
    if not ledger.exists(spark, f"{root}/paths/commit={commit_id}/_SUCCESS"):
        raise ValueError(f"commit {commit_id!r} is not there or not whole")
    paths = spark.read.parquet(f"{root}/paths/commit={commit_id}")
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    named = F.array(*[F.lit(r.name) for r in rules])
    hits = scans(spark, root).where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s")).where(F.array_contains(named, F.concat_ws("/", "s.kind", F.col("s.version").cast("string"))))
    hits = hits.join(paths.select("blob"), "blob", "left_semi")
    sortable = F.struct(F.col("s.start").alias("start"), order[F.col("s.kind")].alias("order"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"))
    per_blob = cut(hits.groupBy("blob").agg(F.sort_array(F.collect_set(sortable)).alias("found")), "secret-findings")
    spans = F.transform("found", lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    joined = paths.select("path", "blob").join(per_blob, "blob", "left")
    return joined.select("path", F.coalesce(spans, F.array().cast(f"array<{FOUND}>")).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

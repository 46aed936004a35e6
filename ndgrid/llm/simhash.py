"""SimHash near-duplicates with pivot distance tables.

Each distinct fingerprint gets a row of its Hamming distances to PIVOTS reference fingerprints, computed once and kept
beside it in the shared folder. Two fingerprints that differ in k bits differ by at most k in every coordinate of their rows, so a pair whose largest coordinate difference
is above the limit cannot link; only survivors are compared bit by bit.

Which rows meet at all: with at most k differing bits and the 64 bits cut into k + 2 fields, at least two fields are
equal. There is a table for every pair of fields, keyed by their bits, and rows meet where they share a key. Within a
key, links are found breadth first: a row is taken from the front, compared with the rows not reached yet, and those
that link join the front. That gives a spanning forest of the key's links, never all pairs of a group of copies, and
compares a dense group only with what is left of it. A key with more than KEY_ROWS rows is cut into chunks, and every
pair of chunks is worked on by a task of its own, so no link is lost and no group is held by one task.
"""

from __future__ import annotations

import itertools
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ndgrid.llm.components import components
from ndgrid.llm.rows import map_texts
from ndgrid.runtime import cut, lean, ship

#: Reference fingerprints of the distance table.
PIVOTS = 16
#: Rows of one key that a task holds together.
KEY_ROWS = 2048
#: Shingles hashed at a time, so that a very long text needs no more memory.
SLICE = 1 << 16


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints by rule: the golden-ratio sequence, mixed; half of the bits of any two differ or so."""
    x = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def distance_rows(fingerprints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """(rows, pivots) of Hamming distances."""
    return np.bitwise_count(fingerprints[:, None] ^ references[None, :])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 bits, each set if it is set in over half of the XXH64 (seed 42) of the text's shingles, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    after = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    ends = (after - 1)[min(shingle, len(words)) - 1 :].tolist()
    starts = np.concatenate(([0], after[:-1]))[: len(ends)].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for i in range(0, len(ends), SLICE):
        a, b = starts[i : i + SLICE], ends[i : i + SLICE]
        h = np.fromiter([digest(joined[s:e], 42) for s, e in zip(a, b)], dtype=">u8", count=len(a))
        counts += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(ends)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, h, fp: one row for each row of ``docs``, without a shuffle.

    h is Spark's hash of the text, fp a bigint with the fingerprint's bits.
    """
    def make():
        return lambda texts: [pa.array(np.array([fingerprint(t, shingle) for t in texts.to_pylist()], dtype=np.uint64).view(np.int64))]

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text"))
    return map_texts(rows, "text", ["doc_id", "h"], make, "fp bigint").select("row.doc_id", "row.h", "fp")


def forest(fp: np.ndarray, table: np.ndarray, limit: int, side: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Spanning forest of the links among ``fp``, breadth first, as pairs of row numbers.

    ``table`` has the rows' pivot distances. With ``side`` (booleans) only links between the two sides count.
    """
    a, b = [], []
    left = np.argsort(table[:, 0], kind="stable")  # by the first coordinate: a window of it is all that can link
    first = table[left, 0].astype(np.int64)
    while len(left) > 1:
        front, left, first = deque([int(left[0])]), left[1:], first[1:]
        while front and len(left):
            x = front.popleft()
            lo, hi = np.searchsorted(first, [int(table[x, 0]) - limit, int(table[x, 0]) + limit + 1])
            near = left[lo:hi]
            if not len(near):
                continue
            keep = np.abs(table[near].astype(np.int16) - table[x].astype(np.int16)).max(axis=1) <= limit
            keep[keep] = np.bitwise_count(fp[near[keep]] ^ fp[x]) <= limit
            if side is not None:
                keep &= side[near] != side[x]
            if keep.any():
                found = near[keep].tolist()
                a += [x] * len(found)
                b += found
                front.extend(found)
                stay = np.ones(len(left), dtype=bool)
                stay[lo:hi] = ~keep
                left, first = left[stay], first[stay]
    return a, b


def distance_table(distinct: DataFrame, n_pivots: int = PIVOTS) -> DataFrame:
    """(fp) -> fp and its distances, eight to a bigint column d0, d1, ..."""
    columns = [f"d{i}" for i in range(-(-n_pivots // 8))]

    def run(batches):
        references = pivots(8 * len(columns))
        for batch in batches:
            packed = distance_rows(batch.column(0).to_numpy().view(np.uint64), references).astype(np.uint8).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in packed.reshape(len(batch), len(columns)).T)], names=["fp", *columns])

    return distinct.select("fp").mapInArrow(lean(run), ", ".join(f"{c} bigint" for c in ("fp", *columns)))


def _keys(limit: int) -> list[tuple[int, ...]]:
    """Bit masks of the tables: every pair out of limit + 2 fields of nearly equal width."""
    edges = [round(i * 64 / (limit + 2)) for i in range(limit + 3)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [x | y for x, y in itertools.combinations(masks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, *, limit: int = 4, key_rows: int = KEY_ROWS, n_pivots: int = PIVOTS) -> DataFrame:
    """(fp) distinct fingerprints -> (u, v): links that connect whatever pairs at ``limit`` or fewer bits connect."""
    spark = distinct.sparkSession
    ship(spark)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(_keys(limit))])
    near = cut(distance_table(distinct, n_pivots), "simhash-pivots")
    held_as = near.columns[1:]
    rows = near.select("fp", *held_as, F.explode(tables).alias("k")).select("k.t", "k.key", "fp", *held_as)
    sizes = cut(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-keys")
    met = rows.join(sizes, ["t", "key"])
    # A key that fits is one unit; a larger one has a unit for each pair of chunks, with the rows of both.
    met = met.withColumn("c", F.ceil(F.col("n") / F.lit(key_rows)).cast("int")).withColumn("i", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("c")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda j: F.struct(F.least("i", j).alias("lo"), F.greatest("i", j).alias("hi")))
    units = met.withColumn("pair", F.explode(pairs)).select("t", "key", "pair.lo", "pair.hi", "fp", F.col("i"), *held_as)
    units = units.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi")

    def run(batches):
        held = None

        def done(cols):
            fp = cols["fp"].view(np.uint64)
            cut_at = np.flatnonzero(np.any([np.diff(cols[c]) != 0 for c in ("t", "key", "lo", "hi")], axis=0)) + 1
            a, b = [], []
            table = np.stack([cols[c] for c in held_as], axis=1).view(np.uint8)
            for lo, hi in zip([0, *cut_at.tolist()], [*cut_at.tolist(), len(fp)]):
                if hi - lo == 2:  # the usual unit
                    if np.abs(table[lo].astype(np.int16) - table[lo + 1]).max() <= limit and int(fp[lo] ^ fp[lo + 1]).bit_count() <= limit:
                        a.append(lo)
                        b.append(lo + 1)
                elif hi - lo > 2:
                    side = cols["i"][lo:hi] == cols["lo"][lo] if cols["lo"][lo] != cols["hi"][lo] else None
                    x, y = forest(fp[lo:hi], table[lo:hi], limit, side)
                    a += [lo + i for i in x]
                    b += [lo + i for i in y]
            f = cols["fp"]
            return pa.RecordBatch.from_arrays([pa.array(f[a] if a else f[:0]), pa.array(f[b] if b else f[:0])], names=["u", "v"])

        names = ("t", "key", "lo", "hi", "fp", "i", *held_as)
        for batch in batches:
            cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            if held is not None:
                cols = {n: np.concatenate([held[n], cols[n]]) for n in names}
            # The last unit may go on in the next batch.
            n = len(cols["t"])
            if n:
                same = np.all([cols[c] == cols[c][-1] for c in ("t", "key", "lo", "hi")], axis=0)
                start = n - int(np.argmin(same[::-1])) if not same.all() else 0
                held = {k: v[start:] for k, v in cols.items()}
                if start:
                    yield done({k: v[:start] for k, v in cols.items()})
        if held is not None and len(held["t"]):
            yield done(held)

    return units.mapInArrow(lean(run), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, limit: int = 4, key_rows: int = KEY_ROWS) -> DataFrame:
    """doc_id, fp (bigint), component_id: one row for each row of ``docs``.

    Texts are read once and only ids and fingerprints are shuffled. Documents with equal fingerprints are linked by
    grouping; links between different ones come from :func:`links`, and components run over fingerprints, so copies
    never become pairs. component_id is the smallest id in the component, nulls aside.

    Defined cases: a text that is null or has no words has fingerprint zero and links like any other; repeated rows
    are in one component; a row with a null id has its component's id, null if no row there has one; an empty table
    gives an empty result; other columns are ignored.
    """
    marks = cut(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle), "simhash-fp")
    classes = _classes(marks, limit, key_rows)
    return marks.join(classes, "fp").select("doc_id", "fp", "component_id")


def _classes(marks: DataFrame, limit: int, key_rows: int) -> DataFrame:
    """fp, root (the component's least fingerprint), component_id: one row for each distinct fingerprint."""
    distinct = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), limit=limit, key_rows=key_rows))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, "simhash-roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return cut(rooted.join(ids, "root").select("fp", "root", "component_id"), "simhash-classes")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, limit: int = 4, key_rows: int = KEY_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their component: smallest id (null last), then hash.

    Of rows that are repeated as a whole (id and text), one stays. The rows to keep are found over ids, hashes and
    fingerprints; the texts are shuffled once, by id and hash, to meet them.
    """
    marks = cut(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle), "simhash-fp")
    tagged = marks.join(_classes(marks, limit, key_rows).select("fp", "root"), "fp")
    first = tagged.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("h"))).alias("first"))
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    kept = cut(first.select(key("first.doc_id").alias("__key"), F.col("first.h").alias("__h")), "simhash-kept")
    single = marks.groupBy("doc_id", "h").count().where("count > 1").isEmpty()
    rows = docs.select(F.struct("*").alias("row"), key(f"`{doc_id}`").alias("__key"), F.xxhash64(F.col(f"`{text}`")).alias("__h"))
    rows = rows.join(kept, ["__key", "__h"], "left_semi")
    return (rows if single else rows.dropDuplicates(["__key", "__h"])).select("row.*")

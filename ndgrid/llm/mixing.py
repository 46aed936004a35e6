"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A document of n words is cut into blocks of ``block_words`` consecutive words (the last may be shorter). The blocks of
a source are numbered, documents by a keyed hash, and permuted: a keyed bijection on the numbers gives each block its
draw in each pass over the source. A source whose target is e whole passes and a part takes every block e times, and
once more those with the first draws of another pass, the last of them only as far as the target goes.

The draws of all sources (exact block quotas) are split among the output shards by a tree: each node hands its left
half a multivariate-hypergeometric share of what is left of every source, down to one shard. Shard j then holds the
draws of each source between two running totals of its quotas: disjoint blocks from all over the source. Within a shard
rows are ordered by a hash. What a document gives is the sum of what the shards draw of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ndgrid.llm.rows import slices
from ndgrid.runtime import cut, lean, ship

#: Words of a block: documents of up to so many stay in one piece.
BLOCK_WORDS = 512
#: Words aimed at in one output shard.
SHARD_WORDS = 8_000_000
#: Words aimed at in a partition of mixed documents, of which there are MAX_PARTITIONS at most.
PART_WORDS = 2_000_000
MAX_PARTITIONS = 20_000
#: No document is taken more often than this.
MAX_REPEATS = 3
#: Ranges that each source's order and draws are counted in; no task ever ranks a whole source.
RANGES = 4096
#: Bytes of the broadcast table of quotas, a number for each source and shard. Where shards of the wanted size would
#: need more, there are as many shards as fit, each larger; what the mix takes is the same, and each block has a shard.
MAX_QUOTA_BYTES = 8 << 20
#: Draws less likely than the likeliest one by this factor are left out: no double from 0 to 1 tells them apart.
FAINT = 1e-30


def word_count(text) -> F.Column:
    """Number of maximal runs of characters other than space and \\t..\\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (1, 2, 3), most: float = MAX_REPEATS) -> dict[str | None, float]:
    """Words to take of each source: in proportion to its weight, never above ``most`` times its size.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes. Those above their
    limit get the limit, and what is left is shared again among the others, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    limit = {s: most * n for s, n in order}
    left, open_, out = float(sum(n for _, n in order)), [s for s, _ in order], {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if weight[s] * share > limit[s]]
        if not above:
            return out | {s: weight[s] * share for s in open_}
        for s in above:
            out[s] = float(limit[s])
            left -= limit[s]
        open_ = [s for s in open_ if s not in out]
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources): how many draws of each source every shard gets; columns sum to ``quotas``.

    Each inner node of the tree draws its own numbers from (seed, first shard, last shard), so the result depends on
    nothing else.
    """
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(lo: int, hi: int, q: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid = (lo + hi) // 2
        n = int(q.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = np.zeros_like(q)
        room, rest = n, int(q.sum())
        for i, k in enumerate(q):  # one source after the other: their marginals are hypergeometric
            rest -= int(k)
            left[i] = _hypergeometric(rng, int(k), rest, room)
            room -= int(left[i])
        split(lo, mid, left)
        split(mid, hi, q - left)

    if shards:
        split(0, shards, np.array(quotas, dtype=np.int64))
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Of n drawn from good + bad, how many are good; beyond numpy's 10**9 by the inverse of the distribution.

    Its probabilities, over that of the mode, are products of the ratios of neighbours; what is left out at either end
    is less likely than the mode by FAINT. They take memory in proportion to the root of good + bad.
    """
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    lo, hi = max(0, n - bad), min(good, n)
    mode = min(max((good + 1) * (n + 1) // (good + bad + 2), lo), hi)
    up = _products(lambda j: (good - mode - j) / (mode + j + 1) * ((n - mode - j) / (bad - n + mode + j + 1)), hi - mode)
    down = _products(lambda j: (mode - j) / (good - mode + j + 1) * ((bad - n + mode - j) / (n - mode + j + 1)), mode - lo)
    share = np.cumsum(np.concatenate((down[::-1], [1.0], up)))
    return mode - len(down) + int(np.searchsorted(share, rng.random() * share[-1], side="right"))


def _products(ratio: Callable[[np.ndarray], np.ndarray], steps: int) -> np.ndarray:
    """ratio(0), ratio(0) ratio(1) and so on for ``steps`` falling ratios, as long as they are above FAINT."""
    out, last = [np.zeros(0)], 1.0
    for lo in range(0, steps, 1 << 16):
        piece = last * np.cumprod(ratio(np.arange(lo, min(steps, lo + (1 << 16)), dtype=np.int64)))
        out.append(piece[piece > FAINT])
        last = float(piece[-1])
        if last <= FAINT:
            break
    return np.concatenate(out)


RUNS = "array<struct<shard:int,epoch:int,words:bigint,blocks:array<bigint>,part:bigint,part_words:bigint>>"


@dataclass
class Source:
    """What is taken of a source: ``epochs`` whole passes and ``rest`` words of another."""

    size: int
    blocks: int
    target: float
    epochs: int = 0
    rest: int = 0
    last: int = 0  # draws of the last pass
    last_words: int = 0  # of the last of them

    @property
    def draws(self) -> int:
        return self.epochs * self.blocks + self.last


def permuted(x: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed bijection of 0 .. size - 1: a Feistel network on the next power of four, walked until it is inside."""
    half = np.uint64(max(1, -(-max(1, (size - 1).bit_length()) // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.Generator(np.random.PCG64(key)).integers(0, 1 << 63, 6, dtype=np.uint64)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def _pass_key(seed: int, source: str, epoch: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{seed}:{epoch}:{source}".encode("utf-8", "replace"))


def _blocks(size: np.ndarray, n_blocks: np.ndarray, first: np.ndarray, block_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number in its document, number in its source, words) of every block of some documents."""
    row = np.repeat(np.arange(len(size)), n_blocks)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    return row, at, first[row] + at, np.minimum(block_words, size[row] - at * block_words)


def _key(column: str) -> F.Column:
    """A column as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit("null"))


def _hash(doc_id: str, text: str, seed: int) -> F.Column:
    return F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), F.col(f"`{text}`"))


def _placed(rows: DataFrame, weights: tuple[float, ...], block_words: int) -> tuple[DataFrame, dict[str, Source]]:
    """Each row's first block in its source's numbering; the sources by key."""
    shift = 64 - int(math.log2(RANGES))
    rows = rows.withColumns({"n_blocks": F.ceil(F.col("size") / F.lit(block_words)).cast("long"), "range": F.shiftright("h", shift)})
    ranges = cut(rows.groupBy("sk", "range").agg(F.first("source").alias("source"), F.sum("size").alias("w"), F.sum("n_blocks").alias("b")), "mix-ranges")
    # One row for each source, two numbers and a name: what any catalogue of sources holds.
    sizes = ranges.groupBy("sk").agg(F.first("source").alias("source"), F.sum("w").alias("w"), F.sum("b").alias("b")).collect()
    goal = targets([(r.source, r.w) for r in sizes], weights)
    sources = {r.sk: Source(r.w, r.b, float(goal[r.source])) for r in sizes}
    for s in sources.values():
        if s.size:
            s.epochs = min(MAX_REPEATS, int(s.target // s.size))
            s.rest = 0 if s.epochs == MAX_REPEATS else min(s.size, max(0, round(s.target - s.epochs * s.size)))
    sums = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("sk", "range", sums("b", W.partitionBy("sk").orderBy("range")).alias("b0"))
    rows = rows.withColumn("b1", sums("n_blocks", W.partitionBy("sk", "range").orderBy("h", "id")))
    return rows.join(ranges, ["sk", "range"]).withColumn("first_block", F.col("b0") + F.col("b1")).drop("b0", "b1", "range"), sources


def _find_last(placed: DataFrame, sources: dict[str, Source], block_words: int, seed: int) -> None:
    """How many draws of the last pass the rest of each source's target needs, and the words of the last of them.

    Words are summed over RANGES ranges of draws; the draws of the range where the rest is reached are then looked at
    one by one, one range for each source.
    """
    spark = placed.sparkSession
    open_ = {k: s for k, s in sources.items() if s.rest}
    if not open_:
        return
    sent = spark.sparkContext.broadcast((open_, {k: -(-s.blocks // RANGES) for k, s in open_.items()}))

    def draws(batch):
        """(source, draws of the last pass, words) for the batch's blocks."""
        col = {n: batch.column(n).to_numpy() for n in ("size", "n_blocks", "first_block")}
        keys = np.array(batch.column("sk").to_pylist(), dtype=object)
        for k in set(keys) & set(sent.value[0]):
            on = keys == k
            _, _, number, words = _blocks(col["size"][on], col["n_blocks"][on], col["first_block"][on], block_words)
            s = sent.value[0][k]
            yield k, permuted(number, s.blocks, _pass_key(seed, k, s.epochs)), words

    def summed(batches):
        for batch in batches:
            for k, at, words in draws(batch):
                total = np.bincount(at // sent.value[1][k], weights=words)
                held = np.flatnonzero(total)
                yield rows_of(k, held, total[held], sent.value[0][k].rest)

    def rows_of(k: str, place: np.ndarray, words: np.ndarray, rest: int) -> pa.RecordBatch:
        n = len(place)
        return pa.RecordBatch.from_arrays([pa.array([k] * n, pa.string()), pa.array([rest] * n, pa.int64()), pa.array(place.astype(np.int64)), pa.array(words.astype(np.int64))], names=["sk", "rest", "place", "words"])

    def reached(work) -> list:
        """The row of each source where the running total of words, in the order of places, gets to the rest."""
        own = placed.select("sk", "size", "n_blocks", "first_block").where("n_blocks > 0")
        rows = own.mapInArrow(lean(work), "sk string, rest bigint, place bigint, words bigint").groupBy("sk", "rest", "place").agg(F.sum("words").alias("words"))
        rows = rows.withColumn("upto", F.sum("words").over(W.partitionBy("sk").orderBy("place")))
        return rows.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest"))).collect()

    here = spark.sparkContext.broadcast({r.sk: (r.place, r.rest - (r.upto - r.words)) for r in reached(summed)})

    def listed(batches):
        for batch in batches:
            for k, at, words in draws(batch):
                where, left = here.value[k]
                on = at // sent.value[1][k] == where
                yield rows_of(k, at[on], words[on], left)

    for r in reached(listed):
        sources[r.sk].last, sources[r.sk].last_words = r.place + 1, r.rest - (r.upto - r.words)


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 7) -> DataFrame:
    """Every row of ``docs`` with what the mix takes of it.

    Returns id, h (a hash of id and text), size, source_size, target (of the source), taken (the words that all shards
    draw of the row) and ``runs``: for each shard and pass that draws of it the words, the numbers of the blocks, and
    the block of which only the first ``part_words`` are taken, if there is one. Texts are read once, for their sizes
    and hashes, and never shuffled.

    Sizes and hashes are computed once and written to the shared folder. Numbers come from counts for each (source,
    hash range) and a rank within the range, so a source with a third of all rows is spread over RANGES groups. Only
    one row for each source goes to the driver, and the quotas back, one number for each source and shard.

    Defined cases: a null or empty text has size 0 and no runs; a null source is one source, the last; rows with the
    same id and text are interchangeable and each keep their row; an empty table gives an empty result; extra columns
    are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), _hash(doc_id, text, seed).alias("h"), F.col(f"`{source}`").cast("string").alias("source"), _key(source).alias("sk"), word_count(F.col(f"`{text}`")).alias("size"))
    placed, sources = _placed(cut(rows, "mix-sizes"), weights, block_words)
    placed = cut(placed.select("id", "h", "sk", "size", "n_blocks", "first_block"), "mix-placed")
    _find_last(placed, sources, block_words, seed)
    keys = sorted(sources)
    total = sum(s.epochs * s.size + s.rest for s in sources.values())
    shards = max(1, min(-(-int(total) // shard_words), MAX_QUOTA_BYTES // (8 * max(1, len(keys)))))
    ends = np.cumsum(split_quotas([sources[k].draws for k in keys], shards, seed), axis=0)
    sent = spark.sparkContext.broadcast({k: (sources[k], ends[:, i]) for i, k in enumerate(keys)})

    def run(batches):
        for batch in batches:
            yield _with_runs(batch, sent.value, block_words, seed)

    kind = placed.schema["id"].dataType.simpleString()
    out = placed.mapInArrow(lean(run), f"id {kind}, h bigint, size bigint, source_size bigint, target double, runs {RUNS}")
    taken = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["words"])
    return out.select("id", "h", "size", "source_size", "target", taken.alias("taken"), "runs")


def _with_runs(batch: pa.RecordBatch, sources: dict[str, tuple[Source, np.ndarray]], block_words: int, seed: int) -> pa.RecordBatch:
    """The rows of a batch with the runs of blocks that the shards draw of each."""
    names = ("size", "n_blocks", "first_block")
    col = {n: batch.column(n).to_numpy() for n in names}
    keys = np.array(batch.column("sk").to_pylist(), dtype=object)
    drawn: list[list[np.ndarray]] = [[] for _ in range(6)]
    for k in sorted(set(keys)):
        s, ends = sources[k]
        on = np.flatnonzero(keys == k)
        row, at, number, words = _blocks(*(col[n][on] for n in names), block_words)
        for epoch in range(s.epochs + (s.last > 0)):
            place = permuted(number, s.blocks, _pass_key(seed, k, epoch))
            use = place < (s.last if epoch == s.epochs else s.blocks)
            cut_off = (place[use] == s.last - 1) if epoch == s.epochs else np.zeros(int(use.sum()), dtype=bool)
            got = np.where(cut_off, s.last_words, words[use])
            for held, x in zip(drawn, (on[row[use]], np.full(len(got), epoch), np.searchsorted(ends, epoch * s.blocks + place[use], side="right"), at[use], got, cut_off & (got < words[use]))):
                held.append(x)
    row, epoch, shard, at, words, partial = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in drawn)
    order = np.lexsort((at, shard, epoch, row))
    row, epoch, shard, at, words, partial = (x[order] for x in (row, epoch, shard, at, words, partial))
    new = np.flatnonzero(np.any([np.diff(x, prepend=-1) != 0 for x in (row, epoch, shard)], axis=0)) if len(row) else np.zeros(0, dtype=np.int64)
    part, part_words = np.full(len(new), -1), np.zeros(len(new), dtype=np.int64)
    in_run = np.searchsorted(new, np.flatnonzero(partial), side="right") - 1
    part[in_run], part_words[in_run] = at[partial.astype(bool)], words[partial.astype(bool)]
    blocks = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(at.astype(np.int64)))
    runs = pa.StructArray.from_arrays(
        [pa.array(shard[new].astype(np.int32)), pa.array(epoch[new].astype(np.int32)), pa.array(np.add.reduceat(words, new).astype(np.int64) if len(new) else np.zeros(0, dtype=np.int64)), blocks, pa.array(part.astype(np.int64)), pa.array(part_words)],
        names=["shard", "epoch", "words", "blocks", "part", "part_words"],
    )
    upto = np.searchsorted(row[new], np.arange(len(batch) + 1)).astype(np.int32)
    out = [batch.column(n) for n in ("id", "h", "size")]
    out += [pa.array([sources[k][0].size for k in keys], pa.int64()), pa.array([sources[k][0].target for k in keys], pa.float64()), pa.ListArray.from_arrays(pa.array(upto), runs)]
    return pa.RecordBatch.from_arrays(out, names=["id", "h", "size", "source_size", "target", "runs"])


def block_texts(text: str, runs: list[dict], block_words: int) -> list[str | None]:
    """The text of each run of blocks, in the blocks' order; None for one that has all words.

    What is taken of a block goes on to the next word, taken or not, so the blocks of a text put together are the text.
    """
    data = text.encode("utf-8", "replace")
    raw = np.frombuffer(data, dtype=np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    edges = np.append(starts[::block_words], len(data)).tolist()
    edges[0] = 0
    out: list[str | None] = []
    for run in runs:
        if run["words"] >= len(starts):
            out.append(None)
            continue
        stop, behind = run["part"], run["part"] * block_words + run["part_words"]
        end = int(starts[behind]) if behind < len(starts) else len(data)
        out.append(b"".join(data[edges[b] : end if b == stop else edges[b + 1]] for b in run["blocks"]).decode())
    return out


def mixed_documents(docs: DataFrame, mixed: DataFrame, *, text: str = "text", doc_id: str = "doc_id", seed: int = 7, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix's documents, in the columns of ``docs``: a row for each shard and pass that draws of a document.

    A document whose blocks all go to one shard in a pass keeps its text as it is; else a row has the text of the
    shard's blocks. Rows come out by shard, and within a shard by a hash, so written files hold the shards one after
    the other, each with its exact quota of every source. Texts are shuffled twice: to meet their draws, and to the
    partition of their shard, which follows from shard and hash, so nothing is sampled. A document that many rows
    repeat is met by the draws of all of them, one by one.

    Defined cases are those of :func:`mix`; a document of which nothing is taken has no row.
    """
    ship(docs.sparkSession)
    runs = cut(mixed.where(F.size("runs") > 0).select(_key("id").alias("__key"), F.col("h").alias("__h"), "size", "taken", "runs"), "mix-runs")
    last = F.max(F.array_max(F.transform("runs", lambda r: r["shard"]))).alias("shard")
    top = runs.agg(last, F.sum("taken").alias("words")).first()
    shards = (top.shard or 0) + 1
    parts = max(1, min(-(-(top.words or 0) // (shards * PART_WORDS)), MAX_PARTITIONS // shards))
    rows = docs.select(F.struct("*").alias("row"), _key(doc_id).alias("__key"), _hash(doc_id, text, seed).alias("__h"))
    if not runs.groupBy("__key", "__h").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["__key", "__h"])
    others = [c for c in docs.columns if c != text]
    met = rows.join(runs, ["__key", "__h"]).select(F.struct(*[F.col(f"row.`{c}`").alias(c) for c in others]).alias("row") if others else F.lit(None).cast("struct<none:int>").alias("row"), F.col(f"row.`{text}`").alias("text"), "__h", "runs", "size")

    def draw(batches):
        for batch in batches:
            for lo, n in slices(batch.column(1)):
                yield _drawn(batch.slice(lo, n), block_words)

    out = T.StructType([met.schema["row"], *T.StructType.fromDDL("text string, __h bigint, shard int, epoch int").fields])
    drawn = met.mapInArrow(lean(draw), out)
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "__h", F.col("epoch"), F.col("shard")), 33)
    drawn = drawn.select("row", "text", "shard", place.alias("place"))
    partition = (F.col("shard") * parts + F.shiftright(F.col("place") * parts, 31)).cast("int")
    ordered = drawn.repartitionById(shards * parts, partition).sortWithinPartitions("shard", "place")
    return ordered.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _drawn(batch: pa.RecordBatch, block_words: int) -> pa.RecordBatch:
    """A row for each run of the batch's documents, with the run's text. Whole texts are not touched."""
    texts, runs = batch.column(1), batch.column(3)
    flat, upto = runs.flatten(), runs.offsets.to_numpy() - runs.offsets[0].as_py()
    of = np.repeat(np.arange(len(batch)), np.diff(upto))
    some = flat.field("words").to_numpy(zero_copy_only=False) < batch.column(4).to_numpy()[of]
    pieces: list[str | None] = [None] * len(of)
    for i in np.unique(of[some]).tolist():
        mine = slice(int(upto[i]), int(upto[i + 1]))
        pieces[mine] = block_texts(texts[i].as_py(), flat.slice(mine.start, mine.stop - mine.start).to_pylist(), block_words)
    cut_up = np.array([p is not None for p in pieces], dtype=bool)
    whole = texts.take(pa.array(of, mask=cut_up))
    text = pc.coalesce(pa.array(pieces, pa.string()).cast(whole.type), whole)
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), text, batch.column(2).take(pa.array(of)), flat.field("shard"), flat.field("epoch")], names=["row", "text", "__h", "shard", "epoch"])

"""Exact top-k inner products with a bit-sliced index.

The index cuts the vectors into blocks. In a block, component d of every row, less the block's least value there, is
held as bit slices: bitmap j has a bit for each row whose value has bit j set. A query's scores are a sum of slices:
q_d is a sum of signed powers of two, as few as there can be (no two next to each other), so slice j of dimension d
counts at weight j + i for each 2**i among them, inverted for each -2**i. Carry-save addition (three bitmaps of a weight give one of that weight and
one of the next) turns them into the bit slices of the score. From the highest slice down, the rows that can still be
among the k best are narrowed by bitmap AND; rows equal in every slice are at the boundary and go by their id.

Slices have no width of their own, so components may be of any size: those beyond 64 bits are Python integers while
they are cut into slices, and scores are added up as such.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ndgrid.runtime import cut, lean, ship

#: Rows of an index block; a task holds one block at a time.
BLOCK_ROWS = 16384
#: Queries that go past a block in one unit of work; they come to it in batches, so memory does not depend on it.
QUERY_ROWS = 1024
#: Quantised components below this are 64-bit integers.
SMALL = 1 << 60
#: The range of a long; ranks are exact beyond it, the score that is shown stops there.
LONG = (-(1 << 63), (1 << 63) - 1)

INDEX = "block int, ids binary, least array<string>, bits array<int>, slices binary"
FOUND = "query_id bigint, query bigint, vec_id bigint, score bigint, place binary"


def quantise(vectors: list, scale: float = 256.0) -> np.ndarray:
    """(rows, dimensions) of floor(scale * x); shorter vectors have zeros at the end. Python integers if any is large."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), dtype=np.float64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    out = np.floor(out * scale)
    if out.size and np.abs(out).max() >= SMALL:
        wide = np.empty(out.shape, dtype=object)
        wide[...] = [[int(x) for x in row] for row in out.tolist()]
        return wide
    return out.astype(np.int64)


def build(values: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(least value, number of slices) of each dimension, and the slices: (all slices, words) of uint64."""
    rows, dims = values.shape
    words = -(-rows // 64)
    least = [int(x) for x in values.min(axis=0)] if rows else [0] * dims
    bits, slices = np.zeros(dims, dtype=np.int32), []
    for d in range(dims):
        x = values[:, d] - (least[d] if values.dtype == object else np.int64(least[d]))
        bits[d] = int(x.max()).bit_length() if rows else 0
        for j in range(bits[d]):
            on = np.zeros(words * 64, dtype=np.uint8)
            on[:rows] = (x >> j) & 1
            slices.append(np.packbits(on, bitorder="little").view(np.uint64))
    return least, bits, np.array(slices, dtype=np.uint64).reshape(len(slices), words)


def add_slices(columns: dict[int, list[np.ndarray]]) -> dict[int, np.ndarray]:
    """Sum of bitmaps: columns[w] holds arrays of bitmaps that count 2**w each; gives the sum's slice for each w."""
    out, w = {}, min(columns, default=0)
    while columns:
        if w not in columns:
            w += 1
            continue
        m = np.concatenate(columns.pop(w)) if len(columns[w]) > 1 else columns.pop(w)[0]
        carries = []
        while len(m) > 1:
            if len(m) == 2:
                carries.append(m[:1] & m[1:])
                m = m[:1] ^ m[1:]
            else:
                n = len(m) // 3
                a, b, c, rest = m[:n], m[n : 2 * n], m[2 * n : 3 * n], m[3 * n :]
                ab = a ^ b
                carries.append((a & b) | (c & ab))
                m = np.concatenate((ab ^ c, rest)) if len(rest) else ab ^ c
        out[w] = m[0]
        if carries:
            columns.setdefault(w + 1, []).extend(carries)
        w += 1
    return out


def top_k(score: dict[int, np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k rows of ``allowed`` with the highest sums, boundary rows by position."""
    count = lambda m: int(np.bitwise_count(m).sum())
    sure, maybe = np.zeros_like(allowed), allowed
    n_sure = 0
    for w in sorted(score, reverse=True):
        with_bit = maybe & score[w]
        n = n_sure + count(with_bit)
        if n > k:
            maybe = with_bit
        else:
            sure, n_sure, maybe = sure | with_bit, n, maybe & ~score[w]
            if n == k:
                maybe = np.zeros_like(maybe)
                break
    positions = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    return np.concatenate((positions(sure), positions(maybe)[: max(0, k - n_sure)]))


class Block:
    """A block of the index, ready for queries. Rows stand in ascending order of id."""

    def __init__(self, ids: np.ndarray, least: list[int], bits: np.ndarray, slices: np.ndarray):
        self.ids, self.least, self.bits, self.n_slices = ids, least, bits, len(slices)
        words = -(-len(ids) // 64)
        self.rows = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)
        # All slices, and their inverses behind them.
        self.both = np.concatenate((slices, ~slices))

    @classmethod
    def of(cls, row: dict) -> Block:
        """From a row of the index."""
        bits, ids = np.array(row["bits"], dtype=np.int32), np.frombuffer(row["ids"], dtype=np.int64)
        slices = np.frombuffer(row["slices"], dtype=np.uint64).reshape(int(bits.sum()), -(-len(ids) // 64))
        return cls(ids, [int(x) for x in row["least"]], bits, slices)

    def search(self, q: np.ndarray, query_id: int, k: int) -> list[tuple[int, int]]:
        """(row id, score) of the k best rows for the quantised query ``q``."""
        dims = min(len(self.bits), len(q))
        q = q[:dims]
        # Binary digits 1, 0 and -1 of each component: plus and minus are the sums of those of either sign.
        half = np.abs(q) >> 1
        third = np.abs(q) + half
        plus, minus = third & (half ^ third), half & (half ^ third)
        plus, minus = np.where(q < 0, minus, plus), np.where(q < 0, plus, minus)
        constant = sum(x * low - m * ((1 << b) - 1) for x, low, m, b in zip(q.tolist(), self.least, minus.tolist(), self.bits.tolist()))
        place = np.arange(int(third.max()).bit_length() if dims else 0)
        bit = lambda x: ((x[:, None] >> place) & 1).astype(bool)
        down = bit(minus)
        dim, i = np.nonzero(bit(plus) | down)
        n, first = self.bits[dim], (np.cumsum(self.bits) - self.bits)[dim]
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        rows = np.repeat(first + down[dim, i] * self.n_slices, n) + j
        weights = j + np.repeat(i, n)
        order = np.argsort(weights, kind="stable")
        edges = np.flatnonzero(np.diff(weights[order], prepend=-1))
        columns = {int(weights[some[0]]): [self.both[rows[some]]] for some in np.split(order, edges[1:]) if len(some)}
        score = add_slices(columns)
        own = self.rows
        if len(same := np.arange(np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, side="right"))):
            own = own.copy()
            np.bitwise_and.at(own, same // 64, ~(np.uint64(1) << (same % 64).astype(np.uint64)))
        total = lambda p: sum(1 << w for w, m in score.items() if int(m[p // 64]) >> (p % 64) & 1)
        return [(int(self.ids[p]), total(p) + constant) for p in top_k(score, own, k).tolist()]


def place(score: int) -> bytes:
    """Bytes in the order of the integers they stand for: sign, length, value, the latter two inverted below zero."""
    value = abs(score).to_bytes(max(1, -(-abs(score).bit_length() // 8)), "big")
    body = len(value).to_bytes(4, "big") + value
    return b"\x01" + body if score >= 0 else b"\x00" + bytes(255 - b for b in body)


def usable(df: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """vec_id, x of the rows that take part."""
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(finite, F.lit(False)))


def build_index(rows: DataFrame, k: int, scale: float, block_rows: int) -> tuple[DataFrame, int]:
    """The index of (vec_id, x) rows, a row for each block, in the shared folder; the number of blocks.

    Rows that are equal in id and vector are counted first, with partial counts before the shuffle, and at most k + 1
    of them go on: no result can hold more. So no block gets more than its share, whatever repeats.
    """
    counted = rows.groupBy("vec_id", "x").agg(F.least(F.count("*"), F.lit(k + 1)).cast("int").alias("copies"))
    counted = cut(counted, "bitsliced-rows")
    blocks = max(1, -(-counted.count() // block_rows))

    def to_index(key, table):
        times = table.column("copies").to_numpy()
        ids = np.repeat(table.column("vec_id").to_numpy(), times)
        order = np.argsort(ids, kind="stable")
        least, bits, slices = build(np.repeat(quantise(table.column("x").to_pylist(), scale), times, axis=0)[order])
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "ids": [np.ascontiguousarray(ids[order]).tobytes()], "least": pa.array([[str(x) for x in least]], pa.list_(pa.string())), "bits": pa.array([bits.tolist()], pa.list_(pa.int32())), "slices": pa.array([slices.tobytes()], pa.binary())})

    placed = counted.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)).cast("int"))
    return cut(placed.groupBy("block").applyInArrow(to_index, INDEX), "bitsliced-index"), blocks


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` with the highest inner product for each query row.

    The index is built once, a task for each block, and written to the shared folder. A unit of work is a block and up
    to ``query_rows`` queries: the block comes first, and the queries stream past it in batches. So a block is sent
    once for every ``query_rows`` queries, and each hands on k rows for each query; the best of those are ranked.
    Nothing is broadcast and nothing but two counts reaches the driver. The work is the queries times the rows, as
    exact search needs.

    Defined cases: a vector that is null or holds a null or non-finite component (times ``scale``) takes no part, nor
    does a row with a null id; vectors of other lengths count as if zeros followed; a query leaves out rows with its
    own id, and other rows that share an id are candidates each; equal scores go by the smaller id; query rows that are
    equal in id and vector are answered once, those with one id and other vectors each on their own; components and
    scores may be of any size, and a score beyond a long is ranked by its value and shown as the nearest long; empty
    tables give an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    asked = cut(usable(queries, vec_id, embedding, scale).dropDuplicates(["vec_id", "x"]), "bitsliced-queries")
    index, blocks = build_index(usable(vectors, vec_id, embedding, scale), k, scale, block_rows)
    parts = max(1, -(-asked.count() // query_rows))
    none = lambda kind: F.lit(None).cast(kind)
    left = index.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), none("bigint").alias("query_id"), none("bigint").alias("query"), none("array<double>").alias("x"), "ids", "least", "bits", "slices")
    hashed = F.xxhash64("vec_id", "x")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(hashed, F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("vec_id").alias("query_id"), hashed.alias("query"), "x", none("binary").alias("ids"), none("array<string>").alias("least"), none("array<int>").alias("bits"), none("binary").alias("slices"))
    units = left.unionByName(right).repartition("block", "part").sortWithinPartitions("block", "part", "kind")

    def ask(batches):
        block, unit = None, None
        for batch in batches:
            found: list[tuple] = []
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    block, unit = Block.of(row), (row["block"], row["part"])
                elif unit == (row["block"], row["part"]):
                    q = quantise([row["x"]], scale)[0]
                    found += [(row["query_id"], row["query"], i, min(max(s, LONG[0]), LONG[1]), place(s)) for i, s in block.search(q, row["query_id"], k)]
            cols = list(zip(*found)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["query_id", "query", "vec_id", "score", "place"])

    best = units.mapInArrow(lean(ask), FOUND)
    rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("place"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Benchmark decontamination with one Aho-Corasick automaton, scanning each text once.

A window is ``size`` consecutive words of an item. Items that have as many are cut into pieces of (size + 1) / 2 words:
wherever a window begins, it has a whole piece inside. The automaton holds the pieces, so it has about a node for each
character of the items and not for each character of all their windows. Where a piece is found in a text, the words
before and behind it are compared with the item's; a run of ``size`` equal words or more is made of windows, and none is
missed. Items with fewer words are patterns as they are.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ndgrid.llm.rows import map_texts, slices
from ndgrid.runtime import lean, ship

#: A-Z fold to a-z, digits and every byte of a non-ASCII character stay, all else separates words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

#: Characters of items in one automaton (about 50 bytes of memory each). A larger benchmark has several; the texts go
#: past one after the other, each in a Python worker of its own that builds it once, within one pass over the table.
MAX_AUTOMATON_CHARS = 4_000_000

HITS = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>"
_OUT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("item", pa.string())]))


def fold_words(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class Patterns:
    """What is searched: for each pattern the items that have it and where (-1: the item is the pattern)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.key, self.items, self.window = uuid.uuid4().hex, items, window
        self.found: dict[bytes, list[tuple[int, int]]] = {}
        piece = (window + 1) // 2
        for i, (_, words) in enumerate(items):
            if len(words) < window:
                self.found.setdefault(b" ".join(words), []).append((i, -1))
            else:
                known = set()
                for at in range(0, len(words) - piece + 1, piece):
                    # Places with the same words around them are in the same windows; a repetitive item has many.
                    around = (tuple(words[max(0, at - window + piece) : at]), tuple(words[at : at + window]))
                    if around in known:
                        continue
                    known.add(around)
                    self.found.setdefault(b" ".join(words[at : at + piece]), []).append((i, at))

    def automaton(self):
        """Built once per worker process, which keeps the last one."""
        import ahocorasick

        if self.key not in _built:
            _built.clear()
            a = ahocorasick.Automaton()
            for pattern, places in self.found.items():
                # One character per byte, padded, so that a match begins and ends at word boundaries.
                a.add_word(f" {pattern.decode('latin-1')} ", (pattern.count(b" ") + 1, places))
            if self.found:
                a.make_automaton()
            _built[self.key] = a
        return _built[self.key]

    def runs(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(first word, word behind the last, item) of the runs of words that a text shares with an item."""
        if not words or not self.found:
            return []
        joined = b" " + b" ".join(words) + b" "
        found = list(self.automaton().iter(joined.decode("latin-1")))
        if not found:
            return []
        spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
        ends = np.searchsorted(spaces, [end for end, _ in found]).tolist()
        out = []
        for stop, (_, (length, places)) in zip(ends, found):
            first = stop - length
            for i, at in places:
                name, item = self.items[i]
                if at < 0:
                    out.append((first, stop, name))
                    continue
                # A window with this piece inside reaches so far at most; a longer run has other pieces.
                lo, hi, shift = first, stop, at - first
                least, most = max(0, -shift, stop - self.window), min(len(words), len(item) - shift, first + self.window)
                while lo > least and words[lo - 1] == item[lo + shift - 1]:
                    lo -= 1
                while hi < most and words[hi] == item[hi + shift]:
                    hi += 1
                if hi - lo >= self.window:
                    out.append((lo, hi, name))
        return out


_built: dict[str, object] = {}


def summary(text: str | None, n_words: int, runs: list[tuple[int, int, str]]) -> dict:
    """The ``hits`` of a text with these runs. Words come in the same order in the original, so their numbers give its offsets."""
    if not runs:
        return {"n_words": n_words, "n_hit": 0, "items": [], "spans": []}
    step = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(step, [a for a, _, _ in runs], 1)
    np.add.at(step, [b for _, b, _ in runs], -1)
    hit = np.cumsum(step[:n_words]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    at = [m.span() for m in _WORD.finditer(text)]
    spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(edges[::2], edges[1::2])]
    return {"n_words": n_words, "n_hit": int(hit.sum()), "items": sorted({name for _, _, name in runs}), "spans": spans}


def item_patterns(items: DataFrame, item_id: str, item_text: str, window: int) -> list[Patterns]:
    """The items' patterns, in groups of at most MAX_AUTOMATON_CHARS characters or of one item."""
    groups: list[list[tuple[str, list[bytes]]]] = [[]]
    room = MAX_AUTOMATON_CHARS
    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t")).where("i is not null and t is not null")
    for r in rows.distinct().toLocalIterator():
        if words := fold_words(r.t):
            size = sum(map(len, words)) + len(words)
            if size > room and groups[-1]:
                groups.append([])
                room = MAX_AUTOMATON_CHARS
            room -= size
            groups[-1].append((r.i, words))
    return [Patterns(sorted(g), window) for g in groups]


def find_contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` with what they share with the benchmark ``items``.

    Returns ``keep`` (default: all columns) in a struct ``row``, and a struct ``hits``: n_words, n_hit (words inside any
    occurrence of a window), items (ids with an occurring window, sorted as strings) and spans (character offsets in the
    original text of the maximal runs of hit words). Texts are read whole, one row in gives one row out, so there is no
    shuffle. The items' words are the only thing broadcast; they go through the driver, and an executor's memory grows
    with the benchmark, as an automaton must. Above MAX_AUTOMATON_CHARS characters it is spread over several workers.

    Defined cases: a null or empty text has no words and no hits; an item without words matches nothing; items with a
    null id are left out, as they cannot be named; items with the same id are one item; repeated documents each get
    their row; an empty table gives an empty result; columns of any name may be kept, as they stay inside ``row``.
    """
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(p) for p in item_patterns(items, item_id, item_text, window)]
    if len(sent) > 1:
        return _in_passes(docs, sent, text, docs.columns if keep is None else keep)

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            hits = []
            for t in texts.to_pylist():
                words = fold_words(t)
                hits.append(summary(t, len(words), sent[0].value.runs(words)))
            return [pa.array(hits, type=_OUT)]

        return work

    return map_texts(docs, text, keep, make, f"hits {HITS}")


def _in_passes(docs: DataFrame, sent: list, text: str, keep: list[str]) -> DataFrame:
    """The same with several automata: each pass adds its runs of words to a column."""
    ship(docs.sparkSession)
    runs = "array<struct<first:bigint,stop:bigint,item:string>>"
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("t"), F.array().cast(runs).alias("runs"))

    def add(patterns):
        def run(batches):
            for batch in batches:
                for lo, n in slices(batch.column(1)):
                    part = batch.slice(lo, n)
                    held = part.column(2).to_pylist()
                    for t, known in zip(part.column(1).to_pylist(), held):
                        known += [dict(zip(("first", "stop", "item"), r)) for r in patterns.value.runs(fold_words(t))]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(held, _RUNS)], names=["row", "t", "runs"])

        return run

    def summed(batches):
        for batch in batches:
            for lo, n in slices(batch.column(1)):
                part = batch.slice(lo, n)
                hits = [summary(t, len(fold_words(t)), [tuple(r.values()) for r in known]) for t, known in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hits, _OUT)], names=["row", "hits"])

    for patterns in sent:
        rows = rows.mapInArrow(lean(add(patterns)), rows.schema)
    out = T.StructType([rows.schema["row"], *T.StructType.fromDDL(f"hits {HITS}").fields])
    return rows.mapInArrow(lean(summed), out)


def contaminated(hits: str = "hits") -> F.Column:
    """At least one word in twenty is inside a window of a benchmark item."""
    return (F.col(f"{hits}.n_hit") > 0) & (20 * F.col(f"{hits}.n_hit") >= F.col(f"{hits}.n_words"))

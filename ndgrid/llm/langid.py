"""Language ID: scripts narrow the candidates, then Viterbi over word scores labels spans of mixed text.

A word is a maximal run of letters. Its score for a language is the sum, over its letters, of the log probability of
the letter with its two neighbours (word ends count as a neighbour). Languages that do not use the script of the
word's first letter are no candidates for it; a word in a script that no language uses says nothing. The best labels
of a text's words maximise the sum of scores less a penalty for each change of language.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ndgrid.llm.rows import map_texts, slices
from ndgrid.runtime import lean, ship

#: Labelled rows that a model is fitted on at most, by a hash of their id.
TRAIN_ROWS = 20_000
#: Hashed neighbourhoods of a letter.
BUCKETS = 1 << 16
#: What a change of language costs, in units of log probability.
SWITCH = 12.0
#: A language uses a script if so many of its letters are in it.
SCRIPT_SHARE = 0.01
#: Characters of text that are worked on together; a longer text goes part by part.
SLICE = 1_000_000
#: Words that a path is followed through one by one; pieces of a text move side by side.
PIECE = 512

#: Script ranges (first code point of each; a range goes on to the next): fixed values of the Unicode blocks.
RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0750, "Arabic"), (0x0780, "Other"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x18B0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C60, "Other"), (0x2E80, "Han"),
    (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE30, "Other"),
    (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"), (0x30000, "Han"),
)
SCRIPTS = sorted({s for _, s in RANGES})


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: is it a letter, its lower case, its script's number."""
    n = 0x110000
    letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(n)), dtype=bool, count=n)
    lower = np.arange(n, dtype=np.uint32)
    for c in np.flatnonzero(letter).tolist():
        if len(x := chr(c).lower()) == 1:
            lower[c] = ord(x)
    edges = [a for a, _ in RANGES] + [n]
    script = np.repeat(np.array([SCRIPTS.index(s) for _, s in RANGES], dtype=np.uint8), np.diff(edges))
    return letter, lower, script


@dataclass
class Words:
    """The letters and words of some texts, each text's words together and in order."""

    buckets: np.ndarray  # of each letter
    first: np.ndarray  # of each word, its first letter's number
    script: np.ndarray  # of each word
    start: np.ndarray  # of each word, its first character in its text
    length: np.ndarray  # of each word, in letters
    text: np.ndarray  # of each word, its text's number


def words_of(texts: list[str | None]) -> Words:
    letter, lower, script = _tables()
    joined = "\x00".join(t or "" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letter[points] if len(points) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(is_letter)
    padded = np.zeros(len(points) + 2, dtype=np.uint32)
    padded[1:-1][at] = lower[points[at]]
    mixed = padded[at] * np.uint32(0x9E3779B1) + padded[at + 1] * np.uint32(0x85EBCA77) + padded[at + 2] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    buckets = (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(16)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    begin = np.concatenate(([0], np.cumsum([len(t or "") + 1 for t in texts])))
    text = np.searchsorted(begin, at[first], side="right") - 1
    return Words(buckets, first, script[points[at[first]]], at[first] - begin[text], np.diff(first, append=len(at)), text)


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # (BUCKETS, languages)
    uses: np.ndarray  # (scripts, languages): is it a candidate there
    switch: float = SWITCH

    def scores(self, w: Words) -> np.ndarray:
        """(words, languages); a language that is no candidate is far below all that are."""
        if not len(w.first):
            return np.zeros((0, len(self.languages)), dtype=np.float32)
        out = np.stack([np.add.reduceat(self.log_p[:, i][w.buckets], w.first) for i in range(len(self.languages))], axis=1)
        uses = self.uses[w.script]
        out[~uses] = -1e6
        out[~uses.any(axis=1)] = 0
        return out


def _advance(scores: np.ndarray, begin: np.ndarray, n: np.ndarray, entry: np.ndarray, switch: float, back: np.ndarray | None = None) -> np.ndarray:
    """Path sums at the end of each piece, given those before its first word; all pieces move one word at a time.

    Piece i is words ``begin[i]`` to ``begin[i] + n[i]`` of ``scores``. ``back``, if given, takes for each word and
    language the language before it on the best path. Pieces that have ended drop off, so longer ones must come first.
    """
    best = entry.astype(np.float64)
    active = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    own = np.arange(scores.shape[1])
    for t, m in enumerate(active.tolist()):
        now = best[:m]
        top = now.argmax(axis=1)
        jump = now[np.arange(m), top][:, None] - switch
        if back is not None:
            back[begin[:m] + t] = np.where(now < jump, top[:, None], own)
        best[:m] = np.maximum(now, jump) + scores[begin[:m] + t]
    return best


def _retreat(back: np.ndarray, begin: np.ndarray, n: np.ndarray, last: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """From the language of each piece's last word back to the one before its first; ``last`` may have several a piece.

    ``labels``, if given, takes the language of every word (``last`` has one a piece then).
    """
    now = last.copy()
    active = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    for t in range(len(active) - 1, -1, -1):
        m = int(active[t])
        if labels is not None:
            labels[begin[:m] + t] = now[:m, 0]
        now[:m] = np.take_along_axis(back[begin[:m] + t], now[:m], axis=1)
    return now


class Lattice:
    """The best paths through some runs of words, each run going on from given sums (zeros: a text begins).

    Runs are cut into pieces of PIECE words that move side by side. What a piece makes of the sums before it is a
    max-plus matrix, so the sums before every piece are known after one pass from each language; a second one writes
    the language before each word, a byte for each word and language. That is all that is kept of a long text.
    """

    def __init__(self, scores: np.ndarray, n_words: np.ndarray, entry: np.ndarray, switch: float):
        n_words = np.asarray(n_words, dtype=np.int64)
        k = scores.shape[1]
        pieces = -(-n_words // PIECE)
        self.run = np.repeat(np.arange(len(n_words)), pieces)
        number = np.arange(len(self.run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.begin = np.repeat(np.cumsum(n_words) - n_words, pieces) + number * PIECE
        self.n = np.minimum(PIECE, np.repeat(n_words, pieces) - number * PIECE)
        self.first, self.last = np.cumsum(pieces) - pieces, np.cumsum(pieces) - 1
        self.exit = entry.astype(np.float64)
        before = self.exit[self.run]
        parted = np.flatnonzero(pieces > 1)
        inner = np.flatnonzero(np.isin(self.run, parted))  # pieces whose effect on others must be known first
        if len(inner):
            order = inner[np.argsort(-self.n[inner], kind="stable")]
            unit = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)
            made = _advance(scores, np.repeat(self.begin[order], k), np.repeat(self.n[order], k), np.tile(unit, (len(order), 1)), switch)
            matrix = dict(zip(order.tolist(), made.reshape(len(order), k, k)))
            for r in parted.tolist():
                sums = self.exit[r]
                for p in range(int(self.first[r]), int(self.last[r]) + 1):
                    before[p] = sums
                    sums = (sums[:, None] + matrix[p]).max(axis=0)
        self.back = np.zeros((len(scores), k), dtype=np.uint8 if k <= 256 else np.uint16)
        self.order = np.argsort(-self.n, kind="stable")
        after = np.empty_like(before)
        after[self.order] = _advance(scores, self.begin[self.order], self.n[self.order], before[self.order], switch, self.back)
        some = pieces > 0
        self.exit[some] = after[self.last[some]]
        self.parted, self.some = parted, some

    def labels(self, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the language of every word, the one before each run's first), given that of each run's last word."""
        k = self.back.shape[1]
        ends = np.zeros((len(self.run), 1), dtype=np.int64)
        ends[self.last[self.some], 0] = last[self.some]
        inner = np.flatnonzero(np.isin(self.run, self.parted))
        if len(inner):
            order = inner[np.argsort(-self.n[inner], kind="stable")]
            came = _retreat(self.back, self.begin[order], self.n[order], np.tile(np.arange(k), (len(order), 1)))
            source = dict(zip(order.tolist(), came))
            for r in self.parted.tolist():
                for p in range(int(self.last[r]), int(self.first[r]), -1):
                    ends[p - 1, 0] = source[p][ends[p, 0]]
        out, o = np.zeros(len(self.back), dtype=np.int32), self.order
        start = np.zeros_like(ends)
        start[o] = _retreat(self.back, self.begin[o], self.n[o], ends[o], out)
        before = last.copy()
        before[self.some] = start[self.first[self.some], 0]
        return out, before


def viterbi(scores: np.ndarray, n_words: np.ndarray, switch: float) -> np.ndarray:
    """The best language of every word; ``n_words`` of each text, whose words follow one another in ``scores``."""
    lattice = Lattice(scores, n_words, np.zeros((len(n_words), scores.shape[1])), switch)
    return lattice.labels(lattice.exit.argmax(axis=1))[0]


def cuts(text: str, most: int) -> list[tuple[int, int]]:
    """(start, stop) of parts of about ``most`` characters that end where no letter follows, so no word is in two."""
    letter, out, lo = _tables()[0], [], 0
    while lo < len(text):
        hi = min(len(text), lo + most)
        while hi < len(text) and letter[ord(text[hi])]:
            hi += 1
        out.append((lo, hi))
        lo = hi
    return out


def label(model: Model, texts: list[str | None]) -> list[tuple[str, float, list[dict]]]:
    """(language, its share of the letters, spans) of each text; 'und', 0 and no spans if there is no letter."""
    out: list = [None] * len(texts)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= SLICE):
            size += len(texts[hi] or "")
            hi += 1
        if size <= SLICE:
            w = words_of(texts[lo:hi])
            out[lo:hi] = _named(model, w.text, w.start, w.length, viterbi(model.scores(w), np.bincount(w.text, minlength=hi - lo), model.switch), hi - lo)
        else:
            out[lo] = _label_long(model, texts[lo])
        lo = hi
    return out


def _label_long(model: Model, text: str) -> tuple[str, float, list[dict]]:
    """A text longer than SLICE, part by part: sums go on from one to the next, and only the way back is kept."""
    sums, parts = np.zeros((1, len(model.languages))), []
    for lo, hi in cuts(text, SLICE):
        w = words_of([text[lo:hi]])
        lattice = Lattice(model.scores(w), np.array([len(w.first)]), sums, model.switch)
        sums = lattice.exit - lattice.exit.max()
        parts.append((lattice, w.start + lo, w.length.astype(np.int32)))
    last, labels = sums.argmax(axis=1), []
    for lattice, _, _ in reversed(parts):
        found, last = lattice.labels(last)
        labels.append(found)
    start, length = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    return _named(model, np.zeros(len(start), dtype=np.int64), start, length, np.concatenate(labels[::-1]), 1)[0]


def _named(model: Model, text: np.ndarray, start: np.ndarray, length: np.ndarray, labels: np.ndarray, n_texts: int) -> list[tuple[str, float, list[dict]]]:
    """What :func:`label` gives, from each word's text, place and language."""
    n = len(model.languages)
    letters = np.bincount(text * n + labels, weights=length, minlength=n_texts * n).reshape(n_texts, n)
    new = np.flatnonzero((np.diff(labels, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    last = np.append(new[1:], len(labels)) - 1
    spans: list[list[dict]] = [[] for _ in range(n_texts)]
    ends = start + length
    for t, a, b, k in zip(text[new].tolist(), start[new].tolist(), ends[last].tolist() if len(new) else [], labels[new].tolist()):
        spans[t].append({"start": a, "end": b, "lang": model.languages[k]})
    total, top = letters.sum(axis=1), letters.argmax(axis=1)
    return [(model.languages[k], float(x[k] / s), p) if s else ("und", 0.0, []) for x, s, k, p in zip(letters, total, top.tolist(), spans)]


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, mod 4; null for a null id."""
    ids = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(ids.cast("string").cast("binary")), F.lit(4))


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", id_hash=None, max_rows: int = TRAIN_ROWS, switch: float = SWITCH) -> Model:
    """Counts of hashed letter neighbourhoods and scripts for each language of the labelled rows of ``docs``.

    Only rows with a language are used, and ``max_rows`` of them at most (those with the lowest ``id_hash``, chosen
    by its range, if given). Counting happens on the executors; the driver gets one number for each language and
    bucket that occurs.

    Defined cases: a null or empty text adds nothing to its language, which is known all the same; rows without a
    language are left out, repeated rows count each; without any labelled row the only language is 'und'.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where(F.col(f"`{lang}`").isNotNull())
    if id_hash is not None:
        n = rows.count()
        if n > max_rows:
            rows = rows.where(id_hash.bitwiseAND(F.lit((1 << 40) - 1)) < F.lit(int((1 << 40) * max_rows / n)))

    def run(batches):
        for batch in batches:
            totals: dict[str, np.ndarray] = {}
            for lo, n in slices(batch.column(1)):
                langs, texts = batch.column(0).slice(lo, n).to_pylist(), batch.column(1).slice(lo, n).to_pylist()
                for k in set(langs):
                    own = [t for t, x in zip(texts, langs) if x == k]
                    for part in [own] if n > 1 else [[t[a:b]] for t in own if t for a, b in cuts(t, SLICE)]:
                        w = words_of(part)
                        script = np.bincount(w.script, weights=w.length, minlength=len(SCRIPTS)).astype(np.int64)
                        counts = np.concatenate((np.bincount(w.buckets, minlength=BUCKETS), script))
                        totals[k] = totals[k] + counts if k in totals else counts
                    totals.setdefault(k, np.zeros(BUCKETS + len(SCRIPTS), dtype=np.int64))
            for k, counts in sorted(totals.items()):
                at = np.flatnonzero(counts)
                if len(at) == 0:
                    at = np.array([0])  # a language whose texts have no letters is known all the same
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["lang", "bucket", "n"])

    counted = rows.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).mapInArrow(lean(run), "lang string, bucket int, n bigint")
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique().tolist())
    counts = np.zeros((BUCKETS + len(SCRIPTS), max(1, len(languages))), dtype=np.float64)
    if languages:
        counts[found["bucket"].to_numpy(), found["lang"].map(languages.index).to_numpy()] = found["n"].to_numpy()
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    log_p = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
    uses = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0))
    return Model(languages or ["und"], log_p, uses, switch)


SPANS = "array<struct<start:bigint,end:bigint,lang:string>>"
_OUT = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) in a struct ``row``, with lang_pred, score and spans. No shuffle.

    ``lang_pred`` is the language with the most letters in the spans (the first by name if equal), ``score`` its share
    of the letters; spans are in characters of the text, from the first letter of a run to the last. The model is
    broadcast: its size is BUCKETS times the number of languages.

    Defined cases: a null or empty text, or one without letters, is 'und' with score 0 and no spans; every row in
    gives one row out, repeated or not; an empty table gives an empty result; columns of any name may be kept, as
    they stay inside ``row``. A text longer than SLICE gives the same paths as in one go, in memory of a few bytes
    for each word.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            found = label(sent.value, texts.to_pylist())
            return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], _OUT)]

        return work

    return map_texts(docs, text, keep, make, f"lang_pred string, score double, spans {SPANS}")

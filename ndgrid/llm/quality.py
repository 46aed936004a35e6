"""Quality scores learnt from preference pairs (Bradley-Terry), thresholded at a quantile.

A document with label 1 is preferred to one with label 0. The chance that a is preferred to b is modelled as
sigmoid(w . (f(a) - f(b))), so w is fitted by logistic loss on feature differences of pairs, and w . f is a score that
puts documents in order. The threshold is the quantile of the training scores at the share of label 0; scores are
shifted so that it lies at ``cut`` and mapped to 0..1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ndgrid.llm.rows import map_texts

#: Labelled rows that are learnt from at most, by a hash of their id.
TRAIN_ROWS = 20_000
#: Preference pairs drawn from them.
PAIRS = 200_000
#: A document is good from this score on.
CUT = 0.7

#: Marks that running text has; all others count as odd.
_USUAL = ".,;:'\"?-()\n "
#: Characters of a text that are split into words at a time.
SLICE = 4_000_000
_SPACE = re.compile(r"\s")

FEATURES = (
    "log_words", "word_length", "upper", "digits", "odd_marks", "distinct_words", "top_word",
    "repeated_words", "repeated_lines", "log_line_length", "stops", "long_words", "non_ascii", "one_letter",
    "odd_word_ends", "distinct_lines",
)


def _parts(text: str) -> Iterator[str]:
    """Runs of about SLICE characters that end before white space, so that no word is in two of them."""
    lo = 0
    while lo < len(text):
        hi = lo + SLICE
        if hi < len(text) and (space := _SPACE.search(text, hi)):
            hi = space.start()
        elif hi < len(text):
            hi = len(text)
        yield text[lo:hi]
        lo = hi


def _lines(text: str) -> Iterator[str]:
    lo = 0
    while lo <= len(text):
        hi = text.find("\n", lo)
        hi = len(text) if hi < 0 else hi
        if hi > lo:
            yield text[lo:hi]
        lo = hi + 1


def features(text: str | None) -> np.ndarray:
    """Figures of a whole text, none of which grows with its length but ``log_words``; all 0 for an empty text.

    They do not depend on SLICE: words of a long text are counted part by part, and its lines one by one.
    """
    t = text or ""
    words, again, n_chars, n_words, odd_ends, before = Counter(), 0, len(t), 0, 0, None
    for part in _parts(t):
        w = part.split()
        n_words += len(w)
        words.update(w)
        again += sum(map(str.__eq__, w, w[1:])) + (before is not None and w[:1] == [before])
        before = w[-1] if w else before
    lines = Counter(t.split("\n") if n_chars <= SLICE else _lines(t))
    del lines[""]
    if not n_words:
        return np.zeros(len(FEATURES))
    n_lines, letters = sum(lines.values()), 0
    word_chars = upper = long_words = single = 0
    for w, n in words.items():
        k = len(w)
        word_chars += n * k
        long_words += n * (k > 15)
        single += n * (k == 1)
        odd_ends += n * (not w[-1].isalnum() and w[-1] not in ".,")
    ascii_bytes = np.frombuffer(t.encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.zeros(256, dtype=np.int64)
    for i in range(0, len(ascii_bytes), SLICE):
        counts += np.bincount(ascii_bytes[i : i + SLICE], minlength=256)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    letters = upper + lower + int(counts[128:].sum())
    digits = int(counts[48:58].sum())
    marks = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    odd = marks - sum(int(counts[ord(c)]) for c in _USUAL[:-2])
    share = lambda n: n / max(1, n_chars)
    return np.array([
        math.log1p(n_words), word_chars / n_words, upper / max(1, letters), share(digits), share(odd),
        len(words) / n_words, max(words.values()) / n_words, again / n_words, 1 - len(lines) / max(1, n_lines), math.log1p(word_chars / max(1, n_lines)), share(int(counts[46])),
        long_words / n_words, share(int(counts[128:].sum())), single / n_words, odd_ends / n_words, math.log1p(len(lines)),
    ])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: float

    def expand(self, f: np.ndarray) -> np.ndarray:
        """Standardised, held within 4 deviations; with their squares, and how far each is out on either side."""
        x = np.clip((f - self.mean) / self.scale, -4, 4)
        return np.concatenate((x, x * x, np.maximum(x - 1, 0), np.maximum(-x - 1, 0)), axis=1)

    def order(self, f: np.ndarray) -> np.ndarray:
        return self.expand(f) @ self.weights

    def score(self, f: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.order(f) + self.shift, -30, 30)))


def fit_pairs(f: np.ndarray, good: np.ndarray, *, pairs: int = PAIRS, ridge: float = 5.0, cut: float = CUT, seed: int = 11) -> Model:
    """Newton steps on the logistic loss of feature differences. With one label only, every score is at the cut."""
    mean = f.mean(axis=0) if len(f) else np.zeros(len(FEATURES))
    scale = np.maximum(f.std(axis=0), 1e-6) if len(f) else np.ones(len(FEATURES))
    logit = math.log(cut / (1 - cut))
    model = Model(mean, scale, np.zeros(4 * len(mean)), logit)
    up, down = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(up) or not len(down):
        return model
    rng = np.random.default_rng(seed)
    x = model.expand(f)
    # Every labelled row takes part in about as many pairs as any other of its label.
    a = np.concatenate([rng.permutation(up) for _ in range(-(-pairs // len(up)))])[:pairs]
    b = np.concatenate([rng.permutation(down) for _ in range(-(-pairs // len(down)))])[:pairs]
    w = model.weights
    for _ in range(25):
        grad, hess = ridge * w, ridge * np.eye(len(w))
        for i in range(0, pairs, 20_000):  # so that the differences need little memory at a time
            d = x[a[i : i + 20_000]] - x[b[i : i + 20_000]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            grad = grad - d.T @ p
            hess = hess + (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    s = x @ w
    return Model(mean, scale, w, logit - float(np.quantile(s, len(down) / (len(up) + len(down)))))


def _figures(texts: pa.Array) -> np.ndarray:
    return np.array([features(t) for t in texts.to_pylist()]).reshape(len(texts), len(FEATURES))


def _labelled_figures():
    def work(texts: pa.Array) -> list[pa.Array]:
        flat = pa.array(_figures(texts).ravel())
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(FEATURES)), flat)]

    return work


def learn(docs: DataFrame, labels: DataFrame, allowed, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = TRAIN_ROWS, cut: float = CUT) -> Model:
    """Fit on the labelled rows whose id passes ``allowed`` (a column over ``doc_id``), ``max_rows`` at most.

    The sample is a range of a hash of the id. It is bounded by ``max_rows``, so it may be broadcast and its figures
    collected. Rows without a label of 0 or 1 or without an id are left out; repeated labels count once, and an id
    with both labels counts for both.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1)).where(allowed(F.col("id"))).dropDuplicates()
    n = known.count()
    if n > max_rows:
        known = known.where(F.xxhash64("id").bitwiseAND(F.lit((1 << 40) - 1)) < F.lit(int((1 << 40) * max_rows / n)))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t")).join(F.broadcast(known), "id")
    figures = map_texts(rows.withColumn("h", F.xxhash64("id", "t", "y")), "t", ["h", "y"], _labelled_figures, "f array<double>")
    # Ids that many documents share may give more rows than labels: the first by their hash are taken.
    got = figures.select("row.h", "row.y", "f").orderBy("h").limit(max_rows).toPandas()
    f = np.array(got["f"].tolist()).reshape(len(got), len(FEATURES))
    return fit_pairs(f, got["y"].to_numpy(), cut=cut)


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) in a struct ``row`` and the score, 0 to 1. One row for each, no shuffle.

    Defined cases: a null or empty text, or one of white space, has the score of a text whose figures are all 0;
    repeated rows each get theirs; an empty table gives an empty result; columns of any name may be kept.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: [pa.array(sent.value.score(_figures(texts)))]

    return map_texts(docs, text, keep, make, "score double")

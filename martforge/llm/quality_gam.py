"""Quality classifier: a generalised additive model with pairwise terms.

Features of the whole text are cut into bins. Cyclic boosting visits one
feature after the other; each visit fits a shallow tree to the log-loss
gradients of that feature's bins and adds its leaves, shrunk, to the feature's
lookup table. Then pairs of features, chosen by how much of the remaining
gradient a coarse grid explains, get two-way tables the same way. A score is
the sum of the looked-up bins, vectorised over a batch.

The model is fitted on a bounded sample of the labelled rows (``MAX_TRAIN``,
by the smallest hash of doc_id); everything else covers all rows. Only the
text enters a score.

Defined results: a null or empty text has zero features and gets the score
the tables give them; labels that are null or neither 0 nor 1 are ignored, of
repeated labels of a document the mean decides; documents without label are
scored, not learned from; without any usable label the score is 0.5 for all,
and ``keep_good`` rejects nothing; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: Labelled rows the model is fitted on, at most.
MAX_TRAIN = 8000
BINS = 32
PAIR_BINS = 8
ROUNDS = 60
PAIR_ROUNDS = 30
PAIRS = 6
RATE = 0.15
LEAVES = 4
RIDGE = 2.0

_BYTES = np.arange(256)
#: Byte classes whose shares are features.
_CLASSES = {
    "lower": (_BYTES >= 97) & (_BYTES <= 122), "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digit": (_BYTES >= 48) & (_BYTES <= 57), "high": _BYTES >= 128,
    "blank": _BYTES == 32, "newline": _BYTES == 10, "stop": np.isin(_BYTES, list(b".!?")),
    "comma": np.isin(_BYTES, list(b",;:")), "bracket": np.isin(_BYTES, list(b"()[]{}<>")),
    "bar": np.isin(_BYTES, list(b"|/\\")), "sign": np.isin(_BYTES, list(b"#$%&*@^~_+=")),
    "quote": np.isin(_BYTES, list(b"\"'`-")),
}
_WEIGHTS = np.array([m for m in _CLASSES.values()], dtype=np.float64).T
FEATURES = [*_CLASSES, "length", "entropy", "word_length", "distinct_words", "top_word", "repeat_next", "long_word",
            "line_length", "repeated_lines", "short_lines", "line_end_stop", "words_per_stop"]


def features(text: str | None) -> np.ndarray:
    """The feature vector of a whole text."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    hist = np.bincount(raw, minlength=256).astype(np.float64)
    n = max(1.0, hist.sum())
    share = hist[hist > 0] / n
    words = (text or "").split()
    count = Counter(words)
    m = max(1, len(words))
    lines = [x for x in (text or "").split("\n") if x.strip()]
    k = max(1, len(lines))
    stops = hist[list(b".!?")].sum()
    return np.concatenate([hist @ _WEIGHTS / n, [
        math.log1p(hist.sum()), float(-(share * np.log(share)).sum()), (n - hist[32] - hist[10]) / m, len(count) / m,
        (count.most_common(1)[0][1] / m) if count else 0.0,
        sum(a == b for a, b in zip(words, words[1:])) / m, sum(len(w) > 14 for w in words) / m,
        math.log1p(sum(map(len, lines)) / k), 1 - len(set(lines)) / k, sum(len(x) < 20 for x in lines) / k,
        sum(x.rstrip()[-1] in ".!?" for x in lines) / k, math.log1p(m / (1 + stops))]])


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def learned(self) -> bool:
        """False if there was nothing to learn from."""
        return self.tables.shape[1] > 1

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1 for each row of features: bins looked up and added."""
        out = np.full(len(x), self.base)
        coarse = {}
        for j, edges in enumerate(self.edges):
            out += self.tables[j, np.searchsorted(edges, x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            for j in (a, b):
                if j not in coarse:
                    coarse[j] = np.searchsorted(self.pair_edges[j], x[:, j], side="right")
            out += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _leaves(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """A shallow tree over the ordered bins of one feature: greedy best
    splits; the value of each bin's leaf."""
    gain = lambda lo, hi: grad[lo:hi].sum() ** 2 / (hess[lo:hi].sum() + RIDGE)
    cuts = [0, len(grad)]
    while len(cuts) <= leaves:
        best, at = 1e-9, None
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo < 2:
                continue
            g, h = np.cumsum(grad[lo:hi])[:-1], np.cumsum(hess[lo:hi])[:-1]
            g_all, h_all = grad[lo:hi].sum(), hess[lo:hi].sum()
            got = g * g / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - gain(lo, hi)
            if got.max() > best:
                best, at = got.max(), lo + 1 + int(got.argmax())
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.zeros(len(grad))
    for lo, hi in zip(cuts, cuts[1:]):
        out[lo:hi] = grad[lo:hi].sum() / (hess[lo:hi].sum() + RIDGE)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Deterministic: no randomness, quantile bins, cyclic visits."""
    d = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if len(y) == 0:
        return Model(0.0, [np.empty(0)] * d, np.zeros((d, 1)), [], [np.empty(0)] * d, [])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    pair_edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for j in range(d)]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(pair_edges)]
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    margin, tables = np.full(len(y), base), np.zeros((d, BINS + 1))
    for _ in range(ROUNDS):
        for j in range(d):
            p = 1 / (1 + np.exp(-margin))
            step = RATE * _leaves(np.bincount(bins[j], y - p, BINS + 1), np.bincount(bins[j], p * (1 - p), BINS + 1), LEAVES)
            tables[j] += step
            margin += step[bins[j]]
    p = 1 / (1 + np.exp(-margin))
    size = PAIR_BINS + 1
    found = []
    for a in range(d):
        for b in range(a + 1, d):
            cell = coarse[a] * size + coarse[b]
            g, h = np.bincount(cell, y - p, size * size), np.bincount(cell, p * (1 - p), size * size)
            found.append((float((g * g / (h + RIDGE)).sum()), a, b))
    pairs = [(a, b) for _, a, b in sorted(found, key=lambda f: (-f[0], f[1:]))[:PAIRS]]
    pair_tables = [np.zeros((size, size)) for _ in pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(pairs, pair_tables):
            p = 1 / (1 + np.exp(-margin))
            cell = coarse[a] * size + coarse[b]
            g = np.bincount(cell, y - p, size * size).reshape(size, size)
            h = np.bincount(cell, p * (1 - p), size * size).reshape(size, size)
            # a tree of depth two: a split of one feature, then of the other in each half
            rows = _leaves(g.sum(1), h.sum(1), 2)
            step = np.zeros((size, size))
            for value in np.unique(rows):
                part = rows == value
                step[part] = _leaves(g[part].sum(0), h[part].sum(0), 2)
            step *= RATE
            table += step
            margin += step.ravel()[cell]
    return Model(base, edges, tables, pairs, pair_edges, pair_tables)


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def feature_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def extract(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([features(t).tolist() for t in part])
    return extract(text)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most ``max_train`` labelled documents that aren't held out;
    only their features reach the driver."""
    ship_package(docs.sparkSession)
    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.avg("quality").alias("share"))
             .select("doc_id", (F.col("share") >= 0.5).cast("double").alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most max_train rows of 17 bytes
    # a document that repeats counts once
    rows = rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"))
    got = rows.select("doc_id", "y", feature_column(F.col("text")).alias("x")).toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy(dtype=np.float64))


def score_column(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            x = np.array([features(t) for t in part]).reshape(len(part), len(FEATURES))
            yield pd.Series(model.score(x))
    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold) for each
    row of ``docs``; one scan for the sample, one for the scores, no shuffle
    of texts."""
    model = train(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject; all, if there
    is no label to learn from."""
    model = train(docs, labels)
    if not model.learned():
        return docs
    return docs.where(score_column(F.col("text"), model) >= threshold)

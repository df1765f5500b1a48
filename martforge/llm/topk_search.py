"""Exact top-k inner products by a pivot-distance index.

Vectors get one more coordinate so that all have the same length; then the
largest inner product is the smallest distance. Every vector is keyed by its
nearest pivot and its distance to it; the keys of a pivot are cut into annuli
(blocks of bounded size). A query starts from a bound: its k-th best score in
a bounded sample. By the triangle inequality only annuli that come within the
distance of that bound can hold a better one; inside a block, slices are
visited outwards from the query's own distance until the bound stops them.

Equal vectors are one entry with their k + 1 smallest ids (no other id of them
can be among a query's k best), so copies cost one entry. A block and a slice
of queries meet in one task; both have a bounded size.

Defined results: rows with a null id, a null vector or a null or non-finite
component take no part; shorter vectors count as zero-padded; rows that repeat
id and vector count once; a query with fewer than k candidates returns all of
them; an empty table gives no rows; other columns are ignored. Scores beyond a
long are held at its ends.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Sample that pivots and first bounds come from, at most.
SAMPLE = 2048
PIVOTS = 16
RINGS = 64
#: Vectors of a block, and queries that meet it in one task, about.
BLOCK = 8192
QUERIES = 4096
SLICE = 512


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def _matrix(values: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        out[i, :len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products, held at the ends of a long."""
    if (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    big = np.array([[int(x) for x in r] for r in a], dtype=object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], dtype=object).reshape(b.shape).T
    return np.clip(big, -2 ** 63, 2 ** 63 - 1).astype(np.int64)


@dataclass
class Index:
    """What every task needs: a few hundred kilobytes, whatever the table."""

    width: int
    norm2: float
    pivots: np.ndarray  # augmented
    sample: np.ndarray
    sample_ids: np.ndarray  # ids per entry of the sample
    step: float
    annuli: list[tuple[int, int, int, int]]  # pivot, first ring, last ring, splits

    def augment(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0, self.norm2 - (x * x).sum(1)))[:, None]])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """To every pivot."""
        square = (x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None] - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(0, square))

    def ring(self, distance: np.ndarray) -> np.ndarray:
        return np.minimum(RINGS - 1, (distance / self.step).astype(np.int64))

    def slack(self) -> float:
        """More than the rounding of a distance can be."""
        return 1e-5 * (1 + np.sqrt(self.norm2))

    def radius(self, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """How far an entry of at least the score ``kth`` can be from q."""
        return np.sqrt(np.maximum(0, (q * q).sum(1) + self.norm2 - 2 * kth)) + self.slack()

    def first_bound(self, q: np.ndarray, k: int) -> np.ndarray:
        """The score of the (k+1)-th best id in the sample."""
        if self.sample_ids.sum() <= k:
            return np.full(len(q), -np.inf)
        scores = q @ self.sample.T
        order = np.argsort(-scores, axis=1, kind="stable")
        reached = np.cumsum(self.sample_ids[order], axis=1) > k
        return scores[np.arange(len(q)), order[np.arange(len(q)), reached.argmax(1)]]


def build_index(entries: DataFrame, width: int, norm2: float) -> Index:
    """Pivots by farthest-first traversal of a bounded sample (smallest hash
    of the id); annuli from the counts of ``PIVOTS`` * ``RINGS`` cells."""
    rows = entries.orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).select("v", F.size("ids").alias("n")).toPandas()
    sample = _matrix(rows["v"], width)
    index = Index(width, norm2, np.zeros((0, width + 1)), sample, rows["n"].to_numpy(dtype=np.int64), 1.0, [])
    x = index.augment(sample)
    chosen, far = [0], None
    while len(chosen) < min(PIVOTS, len(x)):
        d = ((x - x[chosen[-1]]) ** 2).sum(1)
        far = d if far is None else np.minimum(far, d)
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    index.pivots = x[chosen]
    # two vectors of one length are at most two lengths apart
    index.step = max(1e-9, 2 * float(np.sqrt(norm2)) / RINGS)
    return index


def _keys(index: Index):
    def keyed(batches):
        for pdf in batches:
            d = index.distances(index.augment(_matrix(pdf["v"], index.width)))
            pivot = d.argmin(1) if len(d) else np.zeros(0, int)
            own = d[np.arange(len(d)), pivot]
            yield pd.DataFrame({"entry": pdf["entry"], "ids": pdf["ids"], "v": pdf["v"], "pivot": pivot.astype(np.int32),
                                "ring": index.ring(own).astype(np.int32), "distance": own})
    return keyed


def _ask(index: Index, k: int):
    """The blocks that each query has to visit."""
    def asked(batches):
        for pdf in batches:
            q = _matrix(pdf["v"], index.width)
            padded = np.hstack([q, np.zeros((len(q), 1))])
            d = index.distances(padded)
            bound = index.first_bound(q, k)
            reach = index.radius(q, np.where(np.isfinite(bound), bound, -1e300)) if len(q) else np.zeros(0)
            for number, (pivot, lo, hi, splits) in enumerate(index.annuli):
                upper = np.inf if hi == RINGS - 1 else (hi + 1) * index.step
                near = np.flatnonzero((d[:, pivot] - reach <= upper) & (d[:, pivot] + reach >= lo * index.step))
                for split in range(splits):
                    for at in range(0, len(near), 1024):
                        part = near[at:at + 1024]
                        yield pd.DataFrame({"block": np.int32(number), "split": np.int32(split), "query": pdf["query"].to_numpy()[part],
                                            "v": pdf["v"].to_numpy()[part], "bound": bound[part], "q_split": pdf["q_split"].to_numpy()[part]})
    return asked


def _visit(index: Index, k: int):
    """One block and the queries that reach it: each query's best k + 1 ids."""
    columns = ["query", "vec_id", "score"]

    def visit(key, data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(queries):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
        pivot = index.annuli[int(key[0])][0]
        data = data.sort_values("distance", kind="stable")
        x, far, entry, ids = _matrix(data["v"], index.width), data["distance"].to_numpy(), data["entry"].to_numpy(), data["ids"].to_numpy()
        q = _matrix(queries["v"], index.width)
        own = index.distances(np.hstack([q, np.zeros((len(q), 1))]))[:, pivot]
        bound = queries["bound"].to_numpy(dtype=np.float64).copy()
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)  # scores, rows
        slices = [(lo, min(lo + SLICE, len(x))) for lo in range(0, len(x), SLICE)]
        gap = np.stack([np.maximum(0, np.maximum(far[lo] - own, own - far[hi - 1])) for lo, hi in slices])
        order = np.argsort(gap, axis=0, kind="stable")  # outwards, per query
        open_ = np.ones(len(q), dtype=bool)
        for turn in range(len(slices)):
            reach = index.radius(q, np.where(np.isfinite(bound), bound, -1e300))
            open_ &= gap[order[turn], np.arange(len(q))] <= reach  # farther slices are farther still
            for s in np.unique(order[turn][open_]):
                who = np.flatnonzero(open_ & (order[turn] == s))
                lo, hi = slices[s]
                scores = _products(q[who], x[lo:hi])
                for n, i in enumerate(who):
                    some = np.flatnonzero(scores[n] >= bound[i])
                    if not len(some):
                        continue
                    all_s = np.concatenate([best[i][0], scores[n][some]])
                    all_r = np.concatenate([best[i][1], some + lo])
                    top = np.lexsort((entry[all_r], -all_s))[:k + 1]
                    best[i] = all_s[top], all_r[top]
                    if len(top) > k:
                        bound[i] = max(bound[i], float(all_s[top[-1]]))
        names, out = queries["query"].to_numpy(), []
        for i, (scores, rows) in enumerate(best):
            out += [(names[i], one, score) for score, row in zip(scores.tolist(), rows.tolist()) for one in ids[row]]
        return pd.DataFrame(out, columns=columns).astype("int64")
    return visit


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by
    ``every`` its ``k`` best other rows, ties to the smaller vec_id."""
    vecs = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", quantised(F.col("embedding")).alias("v")).distinct()
    same = Window.partitionBy("v").orderBy("vec_id")
    entries = (vecs.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
               .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    entries = materialise(entries.select(F.get("ids", F.lit(0)).alias("entry"), "ids", "v"), "entries")
    head = entries.agg(F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("n2")).first()
    spark = embeddings.sparkSession
    if head.width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index = build_index(entries, max(1, head.width), float(head.n2))
    keyed = materialise(entries.mapInPandas(_keys(index), "entry long, ids array<long>, v array<long>, pivot int, ring int, distance double"), "keyed")
    cells = {(r.pivot, r.ring): r["count"] for r in keyed.groupBy("pivot", "ring").count().collect()}  # at most PIVOTS * RINGS
    block_of = {}
    for pivot in sorted({p for p, _ in cells}):
        size, first, rings = 0, None, sorted(r for p, r in cells if p == pivot)
        for i, ring in enumerate(rings):
            first = ring if first is None else first
            size += cells[pivot, ring]
            block_of[pivot, ring] = len(index.annuli)
            if size >= BLOCK // 2 or i + 1 == len(rings):
                index.annuli.append((pivot, first, ring, -(-size // BLOCK)))
                size, first = 0, None
    queries = vecs.where(F.col("vec_id") % every == 0)
    asking = queries.join(entries.select("v", F.col("entry").alias("query")), "v").select(F.col("vec_id").alias("query_id"), "query", "v")
    asking = materialise(asking, "asking")
    distinct = asking.select("query", "v").distinct()
    q_splits = max(1, -(-distinct.count() // QUERIES))
    distinct = distinct.withColumn("q_split", F.pmod(F.xxhash64("query"), F.lit(q_splits)).cast("int"))
    table = spark.createDataFrame([(p, r, b, index.annuli[b][3]) for (p, r), b in block_of.items()], "pivot int, ring int, block int, splits int")
    data = (keyed.join(F.broadcast(table), ["pivot", "ring"])  # at most PIVOTS * RINGS rows
            .withColumn("split", F.pmod(F.xxhash64("entry"), F.col("splits")).cast("int"))
            .withColumn("q_split", F.explode(F.sequence(F.lit(0), F.lit(q_splits - 1))))
            .select("block", "split", "q_split", "entry", "ids", "v", "distance"))
    visits = distinct.mapInPandas(_ask(index, k), "block int, split int, query long, v array<long>, bound double, q_split int")
    keys = ["block", "split", "q_split"]
    found = data.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(_visit(index, k), "query long, vec_id long, score long")
    better = [F.col("score").desc(), F.col("vec_id")]
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*better))).where(F.col("n") <= k + 1).drop("n")
    pairs = asking.select("query_id", "query").join(found, "query").where(F.col("vec_id") != F.col("query_id"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*better)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

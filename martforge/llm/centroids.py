"""Centroid clustering of integer vectors by Walsh-Hadamard progressive search.

Vectors and centroids are put through the integer Walsh-Hadamard transform
(rows ordered by their sign changes, coarse to fine). The transform keeps
squared distances up to a factor, the number of components, so distances are
sums over its coefficients: after the first few, each centroid has a lower
bound. The centroid that leads is finished on all coefficients; a centroid
whose partial sum is strictly above that is out, and the others go on to finer
coefficients until the last. All sums are integers, so no rounding decides a
tie: of equal distances the smaller number wins.

A round is one pass over the written transforms: each task returns a sum per
centroid and coefficient, so what is shuffled or sent to the driver is bounded
by centroids x components per task, whatever the vectors. Hot clusters cost
nothing extra.

Defined results: vectors of another length, null ones and those with null or
non-finite components take no part; rows that repeat a vec_id are separate
vectors; null ids can't start a centroid but are clustered; with fewer vectors
than centroids each vector starts one; an empty table gives no rows; columns
other than vec_id and embedding are ignored. A distance that 64 bits can't
hold is an error, not a wrong number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Components of a vector.
DIMS = 64
#: Coefficients after which centroids are compared.
LEVELS = (4, 16, 32, 64)
#: Vectors compared at once in a task.
BLOCK = 16_384


def walsh(dims: int) -> np.ndarray:
    """The Walsh-Hadamard matrix, rows by ascending number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < dims:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(1), kind="stable")]


def _exact(values: np.ndarray) -> np.ndarray:
    """64-bit integers where sums of squares of differences fit, else Python's."""
    small = not values.size or max(abs(int(values.max())), abs(int(values.min()))) < 1 << 27
    return values if small else values.astype(object)


def nearest(vectors: np.ndarray, centroids: np.ndarray, levels=LEVELS) -> tuple[np.ndarray, np.ndarray, int]:
    """Of transformed vectors: the nearest transformed centroid, the sum of
    squared differences, and how many coefficient differences were taken."""
    first = levels[0]
    partial = ((vectors[:, None, :first] - centroids[None, :, :first]) ** 2).sum(2)
    lead = partial.argmin(1)
    bound = ((vectors - centroids[lead]) ** 2).sum(1)
    row, number = np.nonzero(partial <= bound[:, None])
    total, taken = partial[row, number], partial.size * first + vectors.size
    for lo, hi in zip(levels[:-1], levels[1:]):
        total = total + ((vectors[row, lo:hi] - centroids[number, lo:hi]) ** 2).sum(1)
        taken += len(row) * (hi - lo)
        stays = (total <= bound[row]).astype(bool)
        row, number, total = row[stays], number[stays], total[stays]
    order = np.lexsort((number, total, row)) if total.dtype != object else np.array(
        sorted(range(len(row)), key=lambda k: (row[k], total[k], number[k])), np.int64)
    best = order[np.concatenate([[True], np.diff(row[order]) != 0])] if len(order) else order
    return number[best], total[best], taken


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            some = batch.slice(lo, BLOCK)
            yield some, _exact(some.column("t").flatten().to_numpy().reshape(-1, dims))


def _transform(dims: int, scale: int):
    matrix = walsh(dims)

    def run(batches):
        for batch in batches:
            x = np.floor(batch.column("embedding").flatten().to_numpy().astype(np.float64).reshape(-1, dims) * scale)
            if x.size and np.abs(x).max() >= 2.0 ** 53:
                raise OverflowError("a component is too large for exact distances")
            t = x.astype(np.int64) @ matrix.T  # at most dims * 2 ** 53
            yield pa.record_batch({"vec_id": batch.column("vec_id"),
                                   "t": pa.ListArray.from_arrays(pa.array(np.arange(0, t.size + 1, dims), pa.int32()), pa.array(t.ravel()))})
    return run


def transformed(vectors: DataFrame, dims: int = DIMS, scale: int = 1024) -> DataFrame:
    """vec_id and the transform ``t`` of floor(scale * component) of every
    vector of ``dims`` finite components."""
    if dims & (dims - 1):
        raise ValueError("the transform needs a power of two components")
    finite = "size(embedding) = {} AND forall(embedding, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('infinity'))"
    kept = vectors.where(F.col("embedding").isNotNull()).where(F.expr(finite.format(dims)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
        _transform(dims, scale), "vec_id long, t array<bigint>")


def _sums(centroids: np.ndarray):
    """Per task and centroid: the sum of each coefficient (at), and the count (at -1)."""
    k, dims = centroids.shape

    def run(batches):
        counts, sums = [0] * k, [[0] * dims for _ in range(k)]
        for _, t in _blocks(batches, dims):
            number, _, _ = nearest(t, _exact(centroids))
            for c in np.unique(number).tolist():
                mine = t[number == c]
                counts[c] += len(mine)
                sums[c] = [a + int(b) for a, b in zip(sums[c], mine.sum(0))]
        rows = [(c, at, v) for c in range(k) if counts[c] for at, v in enumerate([*sums[c], counts[c]])]
        c, at, v = zip(*rows) if rows else ((), (), ())
        yield pa.record_batch({"cluster": pa.array(c, pa.int32()), "at": pa.array(at, pa.int32()), "v": pa.array(map(str, v), pa.string())})
    return run


def _labels(centroids: np.ndarray):
    dims = centroids.shape[1]

    def run(batches):
        for batch, t in _blocks(batches, dims):
            number, total, _ = nearest(t, _exact(centroids))
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "cluster": pa.array(number, pa.int32()),
                                   "distance": pa.array([int(d) // dims for d in total], pa.int64())})
    return run


def _back(t: np.ndarray, matrix: np.ndarray) -> list[int]:
    """The integers whose transform is ``t``."""
    return [sum(int(m) * int(v) for m, v in zip(column, t)) // len(matrix) for column in matrix.T]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = DIMS, scale: int = 1024) -> DataFrame:
    """vec_id, cluster, distance (squared), and of the cluster: its inertia,
    the inertia of all and ``centroid`` (its components)."""
    spark = vectors.sparkSession
    table = materialise(transformed(vectors, dims, scale), "transformed")
    start = (table.where(F.col("vec_id").isNotNull()).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
             .orderBy("h", "t").limit(k).collect())  # k rows
    matrix = walsh(dims)
    centroids = np.array([row["t"] for row in start], np.int64).reshape(-1, dims)
    if not len(centroids):
        return table.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"),
                            F.lit(0).cast("long").alias("inertia"), F.array().cast("array<bigint>").alias("centroid")).limit(0)
    for _ in range(rounds):
        sums = (table.mapInArrow(_sums(centroids), "cluster int, at int, v string").groupBy("cluster", "at")
                .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())  # k x (dims + 1) rows
        found = {(r["cluster"], r["at"]): int(r["v"]) for r in sums}
        for c in sorted({c for c, _ in found}):
            mean = [s // found[c, dims] for s in _back([found[c, i] for i in range(dims)], matrix)]
            centroids[c] = np.array(mean, np.int64) @ matrix.T
    labels = materialise(table.mapInArrow(_labels(centroids), "vec_id long, cluster int, distance long"), "clustered")
    inertia = {r["cluster"]: r["s"] for r in labels.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    about = [(c, inertia[c], sum(inertia.values()), _back(centroids[c], matrix)) for c in sorted(inertia)]
    per_cluster = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<bigint>")
    return labels.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(clustered: DataFrame) -> DataFrame:
    """The clustering with the checksum of the centroid's components."""
    return clustered.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                            F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))

"""Whitening of embeddings by a contour-integral eigensolver (FEAST).

Entries become integers, ``x = floor(64 * c) + 1000000``; the covariance is
that of the distinct vectors and is summed exactly: one pass gives their
number and sums, a second the products of entries centred at the rounded
mean, as integers. What reaches the driver is one matrix of dims x dims,
whatever the rows.

The leading components come from that matrix V. Inertia counts (Sturm counts
of its tridiagonal form: how many eigenvalues lie above a number) place the
ends of intervals in gaps between eigenvalues. Over a circle around each
interval, a quadrature of the shifted solves ``(zI - V)^-1 Y`` keeps the
eigenvectors inside and damps the others; Rayleigh-Ritz on the filtered block
extracts the pairs, and the block is filtered again until the residuals are
at rounding. The number of pairs found is then held against the inertia count
of the interval: none can be missed unseen.

Defined results: vectors that are null or hold null or non-finite entries
take no part; of vectors of several lengths those of the most frequent take
part (of equal ones the longest); rows that repeat a vec_id or a vector each
get their rows, while the covariance counts a vector once; null ids stay null.
Components stop at the rank (eigenvalues below 1e-10 of the first are taken
as zero), so a table of one distinct vector, or none, gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Quadrature nodes on the upper half of a circle.
NODES = 12
#: Eigenvalues an interval holds at most, where the gaps allow it.
SLICE = 6
#: Filterings of an interval before it is given up.
TURNS = 40
#: Residuals, relative to the matrix, at which a pair is done.
RESIDUAL = 4e-15
#: Eigenvalues below this share of the first count as zero.
RANK = 1e-10


# -- the eigensolver (on a dims x dims matrix) ----------------------------------

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder)."""
    a = matrix.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1:, k]
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        v = x.copy()
        v[0] += norm if x[0] >= 0 else -norm
        v /= np.linalg.norm(v)
        part = a[k + 1:, :]
        part -= 2 * np.outer(v, v @ part)
        part = a[:, k + 1:]
        part -= 2 * np.outer(part @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy()


class Inertia:
    """How many eigenvalues of a symmetric matrix lie above a number."""

    def __init__(self, matrix: np.ndarray):
        d, e = tridiagonal(matrix)
        self.d, self.e2 = d.tolist(), (e * e).tolist()
        self.n, self.scale = len(d), max(float(np.abs(matrix).sum(1).max()), np.finfo(float).tiny) if len(d) else 1.0
        self.tiny = self.scale * 1e-18

    def above(self, x: float) -> int:
        count, q = 0, 1.0
        for i, d in enumerate(self.d):
            q = d - x - (self.e2[i - 1] / q if i else 0.0)
            if q == 0:
                q = -self.tiny
            count += q > 0
        return count

    def gap(self, k: int) -> float | None:
        """A number with exactly ``k`` eigenvalues above, in the middle of its
        gap; None where the k-th and the next are equal to rounding."""
        lo, hi = -1.001 * self.scale, 1.001 * self.scale  # more than k above, fewer than k above
        inside = None
        for _ in range(64):
            mid = (lo + hi) / 2
            n = self.above(mid)
            if n == k:
                inside = mid
                break
            lo, hi = (mid, hi) if n > k else (lo, mid)
        if inside is None:
            return None
        top, bottom = inside, inside
        for _ in range(20):
            mid = (top + hi) / 2
            top, hi = (mid, hi) if self.above(mid) == k else (top, mid)
            mid = (bottom + lo) / 2
            bottom, lo = (mid, lo) if self.above(mid) == k else (bottom, mid)
        return (top + bottom) / 2 if top - bottom > 1e-13 * self.scale else None


def interval_pairs(matrix: np.ndarray, lo: float, hi: float, count: int, scale: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs in (lo, hi), by contour integration."""
    n = len(matrix)
    at, weight = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi / 2 * (at + 1)
    centre, radius = (lo + hi) / 2, (hi - lo) / 2
    nodes = centre + radius * np.exp(1j * angle)
    block = rng.standard_normal((n, min(n, count + max(6, count // 2))))
    best = np.inf
    for _ in range(TURNS):
        filtered = np.zeros_like(block)
        for z, a, w in zip(nodes, angle, weight):
            solved = np.linalg.solve(z * np.eye(n) - matrix, block.astype(complex))
            filtered += w / 4 * radius * (np.exp(1j * a) * solved).real * 2
        basis, _ = np.linalg.qr(filtered)
        small = basis.T @ matrix @ basis
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        block = basis @ vectors
        inside = (values > lo) & (values < hi)
        residual = np.linalg.norm(matrix @ block - block * values, axis=0)[inside]
        if inside.sum() == count:
            worst = float(residual.max(initial=0.0))
            if worst <= RESIDUAL * scale or (worst <= 1e-12 * scale and worst > best / 2):  # done, or no longer falling
                return values[inside], block[:, inside]
            best = min(best, worst)
    raise ArithmeticError(f"{count} eigenvalues lie in ({lo}, {hi}); the contour found {int(inside.sum())}")


def leading_pairs(matrix: np.ndarray, k: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The up to ``k`` greatest eigenvalues above the rank limit, falling, and
    their unit eigenvectors as columns."""
    n = len(matrix)
    none = np.zeros(0), np.zeros((n, 0))
    if not n or not np.any(matrix):
        return none
    inertia, rng = Inertia(matrix), np.random.default_rng(seed)
    lo, hi = 0.0, 1.001 * inertia.scale  # the first eigenvalue, by bisection
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if inertia.above(mid) else (lo, mid)
    k = min(k, inertia.above(RANK * hi))
    pairs, done, ceiling = [], 0, 1.001 * inertia.scale
    while done < k:
        # the next gap after at most SLICE eigenvalues; further down where equal ones hide it
        steps = [*range(min(SLICE, k - done), 0, -1), *range(min(SLICE, k - done) + 1, n - done + 1)]
        take, floor = next((t, g) for t in steps if (g := inertia.gap(done + t) if done + t < n else -1.001 * inertia.scale) is not None)
        pairs.append(interval_pairs(matrix, floor, ceiling, take, inertia.scale, rng))
        done, ceiling = done + take, floor
    values, vectors = np.concatenate([v for v, _ in pairs]), np.hstack([w for _, w in pairs])
    basis, _ = np.linalg.qr(vectors)  # the intervals' vectors against each other
    small = basis.T @ matrix @ basis
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values, kind="stable")[:k]
    return values[order], (basis @ turn)[:, order]


# -- sums over the rows --------------------------------------------------------

def _vectors(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column("x").flatten().to_numpy().reshape(-1, dims)


def _long_rows(i, j, v) -> pa.RecordBatch:
    return pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array([str(x) for x in v], pa.string())})


def _count_and_sums(dims: int):
    def run(batches):
        total = [0] * (dims + 1)
        for _, x in _vectors(batches, dims):
            total = [a + b for a, b in zip(total, [*(int(s) for s in x.astype(object).sum(0)), len(x)])]
        if total[dims]:
            yield _long_rows(range(dims + 1), [0] * (dims + 1), total)
    return run


def _products(dims: int, middle: list[int]):
    """Per task: sums (j = -1) and products of the entries centred at ``middle``."""
    upper = np.triu_indices(dims)

    def run(batches):
        sums, products = [0] * dims, None
        for _, x in _vectors(batches, dims):
            x = x - np.array(middle, np.int64)
            largest = int(np.abs(x).max())
            exact = x.astype(float) if largest ** 2 * len(x) < 2 ** 53 else x.astype(object)  # sums of integers below 2**53 don't round
            mine = (exact.T @ exact)[upper]
            sums = [a + int(b) for a, b in zip(sums, x.astype(object).sum(0))]
            products = [int(b) for b in mine] if products is None else [a + int(b) for a, b in zip(products, mine)]
        if products is not None:
            yield _long_rows([*range(dims), *upper[0].tolist()], [-1] * dims + upper[1].tolist(), sums + products)
    return run


def _total(rows: DataFrame) -> dict[tuple[int, int], int]:
    """Sums over the tasks: at most dims x dims rows."""
    return {(r["i"], r["j"]): int(r["v"]) for r in rows.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}


@dataclass
class Whitening:
    """A fitted whitening: everything bounded by dims x dims."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray  # a component is a column

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Whitened rows (components as columns), and each row's exact deviation."""
        s = np.array(self.sums, dtype=object)
        bound = max(abs(int(x.max())), abs(int(x.min()))) * self.n + max(map(abs, self.sums)) if x.size else 0
        far = x * self.n - np.array(self.sums, np.int64) if bound < 2 ** 62 else x.astype(object) * self.n - s
        away = far.astype(float) / self.n
        largest = int(np.abs(far).max()) if far.size else 0
        whole = far if largest ** 2 * max(1, len(self.sums)) < 2 ** 62 else far.astype(object)
        return away @ self.vectors / np.sqrt(self.values), [int(d) for d in (whole * whole).sum(1)]


def rounded(vectors: DataFrame, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id and ``x``, the integers of each vector that takes part."""
    finite = "forall(embedding, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('infinity'))"
    kept = vectors.where(F.col("embedding").isNotNull()).where(F.expr(finite))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.transform("embedding", lambda e: F.floor(F.lit(float(scale)) * e.cast("double")) + F.lit(shift).cast("long")).alias("x"))


def fit(distinct: DataFrame, dims: int, components: int) -> Whitening:
    found = _total(distinct.mapInArrow(_count_and_sums(dims), "i int, j int, v string"))
    if not found:
        return Whitening(0, [], 0.0, np.zeros(0), np.zeros((dims, 0)))
    n, sums = found[dims, 0], [found[i, 0] for i in range(dims)]
    middle = [(2 * s + n) // (2 * n) for s in sums]
    got = _total(distinct.mapInArrow(_products(dims, middle), "i int, j int, v string"))
    off = [got[i, -1] for i in range(dims)]
    exact = [[n * got[min(i, j), max(i, j)] - off[i] * off[j] for j in range(dims)] for i in range(dims)]
    matrix = np.array([[v / (n * n) for v in row] for row in exact])  # quotients of integers, each rounded once
    values, unit = leading_pairs(matrix, components)
    return Whitening(n, sums, sum(exact[i][i] for i in range(dims)) / (n * n), values, unit)


def _identity_sums(w: Whitening):
    k = len(w.values)

    def run(batches):
        total = np.zeros((k + 1, k))
        for _, x in _vectors(batches, len(w.sums)):
            y, _ = w.apply(x)
            total[:k] += y.T @ y
            total[k] += y.sum(0)
        i, j = np.indices(total.shape)
        yield pa.record_batch({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "v": pa.array(total.ravel())})
    return run


def identity_error(distinct: DataFrame, w: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity."""
    k, total = len(w.values), np.zeros((len(w.values) + 1, len(w.values)))
    rows = distinct.mapInArrow(_identity_sums(w), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    for r in rows.collect():  # components x (components + 1) rows
        total[r["i"], r["j"]] = r["v"]
    mean = total[k] / w.n
    return float(np.abs(total[:k] / w.n - np.outer(mean, mean) - np.eye(k)).max())


def _whiten(w: Whitening, error: float):
    k = len(w.values)

    def run(batches):
        for batch, x in _vectors(batches, len(w.sums)):
            y, deviation = w.apply(x)
            rows = len(y)
            yield pa.record_batch({
                "vec_id": pa.array(batch.column("vec_id")).take(pa.array(np.repeat(np.arange(rows), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                "n": pa.array(np.full(rows * k, w.n)),
                "deviation": pa.array([Decimal(d) for d in deviation for _ in range(k)], pa.decimal128(38, 0)),
                "whitened": pa.array(y.ravel()),
                "explained": pa.array(np.tile(w.values / w.trace, rows)),
                "eigenvalue": pa.array(np.tile(w.values, rows)),
                "identity_error": pa.array(np.full(rows * k, error))})
    return run


COLUMNS = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, eigenvalue double, "
           "identity_error double")


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """One row per vector and component: the whitened coordinate, the share of
    the variance it explains, and the exact deviation of the vector."""
    spark = vectors.sparkSession
    rows = materialise(rounded(vectors, scale, shift), "rounded")
    lengths = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims = lengths[0]["dims"] if lengths else 0
    if not dims:
        return spark.createDataFrame([], COLUMNS)
    rows = rows.where(F.size("x") == dims)
    distinct = materialise(rows.select("x").distinct(), "distinct")
    w = fit(distinct, dims, components)
    if not len(w.values):
        return spark.createDataFrame([], COLUMNS)
    return rows.mapInArrow(_whiten(w, identity_error(distinct, w)), COLUMNS)

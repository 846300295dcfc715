"""Whitening of embeddings: pivoted Cholesky of the scatter, one-sided Jacobi on its factor.

1. Entries become integers x = floor(256 c). The fit list is each distinct x
   vector once: a grouping, so a vector that repeats a million times meets
   itself before the shuffle.
2. n and the sums S per dimension are exact integers. A second pass adds up the
   scatter of the centred vectors: numpy products of bounded blocks inside
   tasks, then a grouped sum by row of the matrix. The driver gets d x d
   numbers, whatever the number of vectors.
3. On the driver A = L L' by Cholesky with diagonal pivoting; it stops where the
   rest is rounding, so a singular scatter is no special case. One-sided Jacobi
   rotates pairs of columns of L itself until all are orthogonal: the columns'
   squared norms are A's eigenvalues, the normalised columns its eigenvectors.
   A round rotates d / 2 disjoint pairs at once.
4. Rows are projected in Arrow batches; a third and a fourth pass over the fit
   list measure the covariance of the result against the identity.

Defined results: rows whose vector is null, or holds a null, NaN or infinite
entry, are dropped, also those shorter than the longest vector (they lack
entries) and empty ones; rows with a null or repeated id are kept as they are;
entries beyond the long range take its bounds; ``deviation`` is null where it
exceeds a long; a component of eigenvalue zero (at most the rank's rounding) is
left out, so one distinct vector gives no rows; an empty table gives an empty
result; extra columns, whatever their names, play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.llm.common import read, ready, saved

COMPONENTS = 4
SCALE = 256
BLOCK_BYTES = 8 << 20       # of vectors in one product
SWEEPS = 60


# --------------------------------------------------------------------------
# Linear algebra on the driver


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order): ``a[order][:, order]`` is the factor times its
    transpose; the factor is lower triangular, of as many columns as the rank."""
    d = len(a)
    a, order = a.astype(np.float64).copy(), np.arange(d)
    factor = np.zeros((d, d))
    rest = np.diag(a).copy()
    least = d * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    for k in range(d):
        j = k + int(rest[k:].argmax())
        if rest[j] <= least:
            return factor[:, :k], order
        for x in (order, rest):
            x[[k, j]] = x[[j, k]]
        factor[[k, j]] = factor[[j, k]]
        factor[k, k] = np.sqrt(rest[k])
        below = order[k + 1:]
        factor[k + 1:, k] = (a[below, order[k]] - factor[k + 1:, :k] @ factor[k, :k]) / factor[k, k]
        rest[k + 1:] -= factor[k + 1:, k] ** 2
    return factor, order


def rounds(m: int):
    """Disjoint pairs of 0 .. m - 1, round by round, until every pair has met once."""
    ring = list(range(m + m % 2))
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[:len(ring) // 2], ring[::-1]) if max(a, b) < m]
        yield np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(factor: np.ndarray, tolerance: float = 1e-15) -> np.ndarray:
    """``factor`` times a rotation, with orthogonal columns."""
    g = factor.T.copy()         # columns of the factor as rows
    for _ in range(SWEEPS):
        worst = 0.0
        for i, j in rounds(len(g)):
            x, y = g[i], g[j]
            xx, yy, xy = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            size = np.sqrt(xx * yy)
            cosine = np.abs(np.divide(xy, size, out=np.zeros_like(xy), where=size > 0))
            worst = max(worst, cosine.max(initial=0.0))
            turn = cosine > tolerance
            zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta)), 0.0)
            c = (1 / np.hypot(1, t))[:, None]
            s = c * t[:, None]
            g[i], g[j] = c * x - s * y, s * x + c * y
        if worst <= tolerance * 8:
            break
    return g.T


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a scatter matrix, falling, and their unit vectors as columns; without the zero ones."""
    factor, order = pivoted_cholesky(a)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned * turned).sum(0))
    keep = np.argsort(-norms, kind="stable")
    keep = keep[norms[keep] ** 2 > len(a) * np.finfo(float).eps * (norms ** 2).max(initial=0.0)]
    vectors = np.zeros((len(a), len(keep)))
    vectors[order] = turned[:, keep] / norms[keep]
    return norms[keep] ** 2, vectors


# --------------------------------------------------------------------------
# Passes over the vectors


def as_integers(vec: Column, scale: int = SCALE) -> Column:
    """floor(scale c) of every entry as long."""
    return F.transform(vec, lambda c: F.floor(c.cast("double") * scale).cast("bigint") + 0)


def whole_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): rows whose vectors are whole, as integers."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    d = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    d = d.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))
    return d.select("id", as_integers(F.col("v")).alias("x"))


def _matrix(column, d: int) -> np.ndarray:
    """Rows of a list column of ``d`` longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _blocks(x: np.ndarray):
    step = max(1, BLOCK_BYTES // (8 * x.shape[1]))
    for k in range(0, len(x), step):
        yield x[k:k + step]


def _summed(fit: DataFrame, d: int, make, rows: int, cols: int) -> np.ndarray:
    """Sum over the fit list of ``make(block of x)``, a (rows, cols) matrix for each block."""
    def run(batches):
        total = np.zeros((rows, cols))
        for batch in batches:
            for x in _blocks(_matrix(batch.column(0), d)):
                total += make(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = fit.select("x").mapInArrow(run, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((rows, cols))
    for r in cells.collect():       # rows * cols numbers
        out[r["i"], r["j"]] = r["v"]
    return out


class Whitener:
    """n, exact sums per dimension, and the components of one fit."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.d = n, sums, len(sums)
        self.mean = np.array([s / n for s in sums]) if n else np.zeros(0)
        self.values, self.vectors, self.trace = values / max(n, 1), vectors, trace / max(n, 1)

    def whiten(self, x: np.ndarray, k: int) -> np.ndarray:
        return (x - self.mean) @ self.vectors[:, :k] / np.sqrt(self.values[:k])

    def deviations(self, x: np.ndarray) -> list:
        """Exact sum of (n x - S)^2 of each row; None beyond a long."""
        if not len(x):
            return []
        largest = self.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, self.sums), default=0)
        if largest * largest * max(self.d, 1) < 1 << 63:
            y = self.n * x - np.array(self.sums, np.int64)
            return (y * y).sum(1).tolist()
        exact = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def fit(rows: DataFrame) -> tuple[Whitener, DataFrame]:
    """A whitener of ``rows`` (x), and the fit list: their distinct vectors of the longest length."""
    ready(rows.sparkSession)
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    distinct = saved(rows.where(F.size("x") == d).groupBy("x").agg(F.lit(1).alias("one")).select("x"))
    # Exact sums: as decimals, so that no long overflows.
    sums = {r["j"]: int(r["s"]) for r in distinct.select(F.posexplode("x").alias("j", "v"))
            .groupBy("j").agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("s")).collect()}
    n = distinct.count()
    sums = [sums[j] for j in range(d)]
    mean = np.array([s / max(n, 1) for s in sums])
    scatter = _summed(distinct, d, lambda x: (y := x - mean).T @ y, d, d) if n else np.zeros((0, 0))
    scatter = (scatter + scatter.T) / 2
    values, vectors = eigen(scatter)
    return Whitener(n, sums, values, vectors, float(np.trace(scatter))), distinct


def identity_error(fitted: Whitener, distinct: DataFrame, k: int) -> float:
    """Largest entry of the fit list's whitened covariance minus the identity, by magnitude."""
    middle = _summed(distinct, fitted.d, lambda x: fitted.whiten(x, k).sum(0)[None], 1, k) / fitted.n
    cov = _summed(distinct, fitted.d, lambda x: (w := fitted.whiten(x, k) - middle).T @ w, k, k) / fitted.n
    return float(np.abs(cov - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row per whole vector and component."""
    spark = vectors.sparkSession
    rows = whole_rows(vectors, id_col, vec_col)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fitted, distinct = fit(rows)
    k = min(components, len(fitted.values))
    if not k:
        return spark.createDataFrame([], schema)
    error = identity_error(fitted, distinct, k)
    shared = spark.sparkContext.broadcast(fitted)       # d x d numbers at most
    share = fitted.values[:k] / fitted.trace

    def run(batches):
        f = shared.value
        for batch in batches:
            at = 0
            for x in _blocks(_matrix(batch.column(1), f.d)):
                m = len(x)
                ids = batch.column(0).slice(at, m).take(pa.array(np.repeat(np.arange(m), k)))
                at += m
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n)),
                    pa.array([v for v in f.deviations(x) for _ in range(k)], pa.int64()), pa.array(f.whiten(x, k).reshape(-1)),
                    pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == fitted.d).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")

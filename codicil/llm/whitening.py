"""Whitening of embeddings through a pivoted Cholesky factor and one-sided Jacobi rotations.

Vectors are scaled to integers, so that their number, sums and squared deviations are exact. Each distinct integer vector is fitted
once. Tasks centre these vectors before they multiply them and hand on one scatter matrix each; the sum of these is a matrix of
dimension by dimension, which the driver factors:

* Cholesky with complete pivoting, ``P S P' = L L'``, stops where the rest is rounding error, so L has as many columns as the rank;
* rotations from the right make the columns of L orthogonal (``L J = U diag(s)``) without ever forming ``S`` again. The squared norms of
  the rotated columns are the scatter's eigenvalues and the normalised columns, put back into the order before pivoting, its eigenvectors.

What the driver holds grows with the square of the dimension and not with the number of rows. A pass over the distinct vectors
measures the covariance of what was whitened, and a last one over all rows projects them.

Edge cases: a vector that is null or holds null or non-finite entries is dropped, as is one of another length than most vectors have
(of equally frequent lengths the longest counts). Equal vectors are fitted once, and each of their rows is returned. Components without
variance can't be whitened and are left out, so equal vectors or a single one give no rows, like an empty table. A deviation beyond 64
bits is null; entries beyond 2**62 / 256 are cut off there. Null ids and repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.llm.scratch import Scratch

SCALE = 256
COMPONENTS = 4
#: Rows that are multiplied at once.
BLOCK = 4096
#: Entries are kept below this, so that they are 64-bit integers.
MOST = 2**62
SWEEPS = 60


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def scaled(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The usable rows with their vector as integers, ``x``."""
    rows = vectors.withColumn("_v", F.col(f"`{vector}`").cast("array<double>")).where(usable(F.col("_v")))
    cut = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(MOST))), F.lit(-float(MOST))))
    rows = rows.withColumn("x", F.transform("_v", cut)).drop("_v")
    sizes = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("x") == (sizes["n"] if sizes else 0))


def _blocks(batches: Iterator[pa.RecordBatch], d: int, column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of batches with their vectors as a matrix of integers."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(at, BLOCK)
            yield piece, piece.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact_sums(points: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and their sum in each dimension, as whole numbers without overflow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for _, x in _blocks(batches, d):
            high, low = x >> 32, x & 0xFFFFFFFF  # sums of halves fit into 64 bits
            total = [t + (int(h) << 32) + int(w) for t, h, w in zip(total, high.sum(0), low.sum(0), strict=True)]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(map(str, total)), pa.array([n] * d, pa.int64())], names=["i", "total", "n"])

    parts = points.select("x").mapInArrow(run, "i int, total string, n long")
    rows = parts.groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).orderBy("i").collect()  # a row for each dimension
    return (rows[0]["n"], [int(r["total"]) for r in rows]) if rows else (0, [])


def centred_scatter(points: DataFrame, mean: np.ndarray, basis: np.ndarray | None = None) -> np.ndarray:
    """Sum over the vectors of (x - mean)(x - mean)', or of its projection on the basis' columns."""
    d = len(mean)
    k = d if basis is None else basis.shape[1]
    rows, cols = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for _, x in _blocks(batches, d):
            y = x - mean
            if basis is not None:
                y = y @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(total[rows, cols])], names=["i", "j", "v"])

    out = np.zeros((k, k))
    for r in points.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # k * (k + 1) / 2 rows
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def pivoted_cholesky(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with ``scatter[order][:, order] == L @ L.T``; L has a column for each dimension of the rank."""
    rest, d = scatter.astype(float).copy(), len(scatter)
    order, columns = np.arange(d), []
    least = d * np.finfo(float).eps * max(float(np.diag(rest).max(initial=0.0)), 0.0)
    for k in range(d):
        p = k + int(np.argmax(np.diag(rest)[k:]))
        if not rest[p, p] > least:
            break
        for m in (order, rest, *columns):
            m[[k, p]] = m[[p, k]]
        rest[:, [k, p]] = rest[:, [p, k]]
        column = np.zeros(d)
        column[k] = np.sqrt(rest[k, k])
        column[k + 1 :] = rest[k + 1 :, k] / column[k]
        rest[k + 1 :, k + 1 :] -= np.outer(column[k + 1 :], column[k + 1 :])
        columns.append(column)
    return np.array(columns).T.reshape(d, len(columns)), order


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor's columns rotated in pairs until all are orthogonal."""
    u, r = factor.copy(), factor.shape[1]
    for _ in range(SWEEPS):
        moved = False
        for i in range(r - 1):
            for j in range(i + 1, r):
                a, b, c = u[:, i] @ u[:, i], u[:, j] @ u[:, j], u[:, i] @ u[:, j]
                if abs(c) <= 4 * np.finfo(float).eps * np.sqrt(a * b):
                    continue
                moved = True
                t = (b - a) / (2 * c)
                tan = np.copysign(1.0, t) / (abs(t) + np.hypot(1.0, t))
                cos = 1 / np.hypot(1.0, tan)
                u[:, i], u[:, j] = cos * (u[:, i] - tan * u[:, j]), cos * (u[:, j] + tan * u[:, i])
        if not moved:
            break
    return u


@dataclass
class Whitening:
    """What was fitted: n vectors with sums S, eigenvalues of their covariance by size, and its eigenvectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def basis(self, k: int) -> np.ndarray:
        """Columns that project a centred vector on whitened components."""
        return self.vectors[:, :k] / np.sqrt(self.values[:k])


def eigen(scatter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues of scatter / n, falling, and unit eigenvectors as columns."""
    factor, order = pivoted_cholesky(scatter)
    u = one_sided_jacobi(factor)
    squares = (u * u).sum(0)
    by_size = np.argsort(-squares, kind="stable")
    back = np.zeros_like(u)
    back[order] = u / np.sqrt(squares)
    return squares[by_size] / n, back[:, by_size]


def fit(points: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct integer vectors ``x`` of points; none where no vector is."""
    first = points.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    n, sums = exact_sums(points, first["d"])
    found = Whitening(n, sums, np.empty(0), np.empty((first["d"], 0)), 0.0)
    scatter = centred_scatter(points, found.mean)
    found.values, found.vectors = eigen(scatter, n)
    found.trace = float(np.trace(scatter)) / n
    k = min(components, len(found.values))
    if k:
        covariance = centred_scatter(points, found.mean, found.basis(k)) / n
        found.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return found


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over the dimensions of (n * x - S) ** 2, None where 64 bits don't hold one."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if len(sums) * most * most < 2**63:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(1).tolist()
    exact = (sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x)
    return [v if v < 2**63 else None for v in exact]


def project(rows: DataFrame, fitted: Whitening, kept: tuple[str, ...] = ("vec_id",), components: int = COMPONENTS) -> DataFrame:
    """The kept columns, n, deviation and ``whitened`` (an array, a value for each component) of rows with ``x``."""
    k = min(components, len(fitted.values))
    basis, mean, n, sums = fitted.basis(k), fitted.mean, fitted.n, fitted.sums
    given = rows.select(*kept, "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _blocks(batches, len(mean), len(kept)):
            values = (x - mean) @ basis
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, k, dtype=np.int32)), pa.array(values.ravel()))
            cols = [*piece.columns[:-1], pa.array([n] * len(x), pa.int64()), pa.array(deviations(x, n, sums), pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "n", "deviation", "whitened"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{fields}, n long, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row of vectors (vec_id, embedding)."""
    with Scratch(vectors.sparkSession, "whitening") as scratch:
        rows = scaled(vectors.select("vec_id", "embedding"))
        points = scratch.save(rows.select("x").distinct(), "points")
        fitted = fit(points, components)
        k = min(components, len(fitted.values)) if fitted else 0
        if not k:
            empty = rows.select("vec_id").where("false")
            return empty.selectExpr("vec_id", "0 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
        share = F.array(*(F.lit(float(v / fitted.trace)) for v in fitted.values[:k]))
        each = project(rows, fitted, components=components).select("vec_id", "n", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
        return each.select("vec_id", (F.col("_k") + 1).alias("component"), "n", "deviation", "whitened", F.get(share, F.col("_k")).alias("explained"), F.lit(fitted.identity_error).alias("identity_error"))


def exact_deviations(vectors: DataFrame) -> DataFrame:
    """vec_id, n, deviation of each usable row, which SQL can check."""
    return whiten(vectors, 1).select("vec_id", "n", "deviation")

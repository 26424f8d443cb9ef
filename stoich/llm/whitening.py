"""Embedding whitening: refined eigenvectors of a distributed covariance.

Entries become integers, ``x = floor(64 c) + 1000000``; the fit list is each
distinct x vector once.

1. **Sums and covariance.** Tasks add the x vectors exactly (n and S), then the
   products of the vectors centred at S/n; only dim x dim arrays are added up
   (in two steps, a row per task and block) and only their sum leaves the tasks.
2. **Eigenvectors.** numpy's single precision solver gives a first guess.  Its
   columns are corrected by Ogita and Aishima's iteration in extended precision:
   products R = I - X'X and S = X'VX give the eigenvalue estimates and a first
   order correction E, X becomes X + XE, and the error squares in every step.
3. **Clusters.** The correction divides by differences of eigenvalues, so it
   fails where these are as small as its own error.  Such a group of columns is
   made orthonormal, V minus its mean eigenvalue is projected onto it, and the
   eigenvectors of this small matrix (scaled, so that the differences count)
   turn the group before the iteration goes on.
4. **Result.** Every row is projected; a last pass over the fit list measures
   how far the covariance of the whitened vectors is from the identity.

The driver holds dim x dim matrices; everything that grows with the rows stays
in tasks.

Defined cases: null vectors and vectors with a null or non-finite entry are
dropped, also those with an entry beyond 2^40 in size, whose sums would not be
exact.  One matrix needs one length: vectors of another length than the most
frequent one (the longer one of ties) are dropped, empty ones too.  Repeated
rows and equal vectors all get a result and count once in the fit list.  A
component without variance (an eigenvalue below dim * 2^-40 of the largest one)
has no defined scale: whitened is null there, and identity_error looks only at
the others (null if there are none; explained is null without any variance).  A
deviation beyond a long is null.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoich.llm.common import materialise

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 40)
STEPS = 8
NO_VARIANCE = 2.0 ** -40
HIGH = np.longdouble


# -- eigenvectors ---------------------------------------------------------------

def _norm(a: np.ndarray) -> float:
    return float(np.sqrt((a * a).sum()))


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Nearly orthonormal columns made orthonormal (two Newton steps)."""
    eye = np.eye(x.shape[1], dtype=HIGH)
    for _ in range(2):
        x = x + x @ ((eye - x.T @ x) / 2)
    return x


def _groups(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Indices of values in runs whose neighbours differ by at most ``gap``."""
    order = np.argsort(values)
    cut = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [g for g in np.split(order, cut) if len(g) > 1]


def _turned(v: np.ndarray, x: np.ndarray, value: np.ndarray, gap: float) -> np.ndarray:
    """Columns of near-equal eigenvalues turned to the eigenvectors of V
    within their span."""
    for g in _groups(value.astype(np.float64), gap):
        part = _orthonormal(x[:, g])
        small = part.T @ (v @ part - value[g].mean() * part)
        size = np.abs(small).max()
        if size > 0:
            small = (small + small.T) / 2 / size
            turn = np.linalg.eigh(small.astype(np.float64))[1]
            x = x.copy()
            x[:, g] = part @ _refined(small, turn.astype(HIGH), 3)
    return x


def _refined(v: np.ndarray, x: np.ndarray, steps: int) -> np.ndarray:
    """Ogita-Aishima steps; pairs of eigenvalues too close to tell are only
    made orthogonal."""
    eye = np.eye(len(v), dtype=HIGH)
    for _ in range(steps):
        r, s = eye - x.T @ x, x.T @ (v @ x)
        value = np.diag(s) / (1 - np.diag(r))
        error = 2 * (_norm(s - np.diag(value)) + _norm(v) * _norm(r))
        gap = value[None, :] - value[:, None]
        apart = np.abs(gap) > error
        e = np.where(apart, (s + value[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        if _norm(e) < 2.0 ** -58:
            break
    return x


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric
    matrix, to double precision."""
    scale = np.abs(v).max(initial=0)
    if not len(v) or scale == 0:
        return np.zeros(len(v)), np.eye(len(v))
    high = (v / scale).astype(HIGH)
    x = np.linalg.eigh(high.astype(np.float32))[1].astype(HIGH)
    eye = np.eye(len(v), dtype=HIGH)
    for _ in range(STEPS):
        r, s = eye - x.T @ x, x.T @ (high @ x)
        value = np.diag(s) / (1 - np.diag(r))
        error = 2 * (_norm(s - np.diag(value)) + _norm(high) * _norm(r))
        before = x
        x = _refined(high, _turned(high, x, value, error), 1)
        if _norm(x - before) < 2.0 ** -56:
            break
    x = _orthonormal(x)
    value = np.einsum("ij,ij->j", x, high @ x)
    order = np.argsort(-value, kind="stable")
    return (value[order] * scale).astype(np.float64), x[:, order].astype(np.float64)


# -- sums over rows ---------------------------------------------------------------

def _matrix(batch: pa.RecordBatch, column: int, dim: int) -> np.ndarray:
    col = batch.column(column)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def _added(rows: DataFrame, make, spark_type: str) -> list[np.ndarray]:
    """Arrays that ``make`` gives per batch, added up: per task, then by one
    element-wise aggregate, a row per array and position."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                new = make(batch)
                total = new if total is None else [a + b for a, b in zip(total, new)]
        for k, a in enumerate(total or []):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(a.size, k)), pa.array(np.arange(a.size)),
                                              pa.array(a.ravel())], names=["k", "i", "v"])

    found = rows.mapInArrow(scan, f"k long, i long, v {spark_type}") \
        .groupBy("k", "i").agg(F.sum("v").alias("v")).toPandas().sort_values(["k", "i"])
    return [part["v"].to_numpy() for _, part in found.groupby("k")]


def _integers(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, x) of the usable rows, and the length of x."""
    c = F.col("embedding").cast("array<double>")
    usable = F.col("embedding").isNotNull() & F.forall(
        c, lambda e: e.isNotNull() & (F.abs(e) <= LARGEST))     # NaN is larger than any number
    rows = vectors.where(usable).select(
        F.col("vec_id").cast("bigint"),
        F.transform(c, lambda e: F.floor(e * SCALE) + SHIFT).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("dim")).count().where("dim > 0") \
        .orderBy(F.desc("count"), F.desc("dim")).first()
    dim = lengths[0] if lengths else 0
    return rows.where(F.size("x") == dim), dim


class Whitening:
    """Fitted on the distinct x vectors of ``rows``: n, sums, components."""

    def __init__(self, rows: DataFrame, dim: int, components: int):
        fit = materialise(rows.select("x").distinct())
        sums = _added(fit, lambda b: [np.array([b.num_rows]), _matrix(b, 0, dim).sum(axis=0)], "long")
        self.n, self.sums = int(sums[0][0]), sums[1].astype(np.int64)
        # S/n as a whole part and a rest below one: x minus the whole part is exact
        self.whole, self.rest = self.sums // self.n, (self.sums % self.n) / self.n

        def products(batch: pa.RecordBatch) -> list[np.ndarray]:
            y = self.centred(_matrix(batch, 0, dim))
            return [y.T @ y]

        v = _added(fit, products, "double")[0].reshape(dim, dim) / self.n
        self.value, vectors = eigen((v + v.T) / 2)
        self.trace = float(np.trace(v))
        self.value, self.vectors = self.value[:components], vectors[:, :components]
        self.usable = self.value > self.value.max(initial=0) * dim * NO_VARIANCE
        self.factor = self.vectors / np.sqrt(np.where(self.usable, self.value, 1))

        def moments(batch: pa.RecordBatch) -> list[np.ndarray]:
            w = self.whitened(_matrix(batch, 0, dim))
            return [w.sum(axis=0), w.T @ w]

        k = len(self.value)
        total, square = _added(fit, moments, "double")
        cov = square.reshape(k, k) / self.n - np.outer(total, total) / self.n / self.n
        off = np.abs(cov - np.eye(k))[np.ix_(self.usable, self.usable)]
        self.identity_error = float(off.max()) if off.size else None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.factor

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2; null beyond a long."""
        y, r = x - self.whole, self.sums % self.n       # n x - S = n y - r
        if not y.size or (float(np.abs(y).max()) + 1) * self.n * np.sqrt(y.shape[1]) < 2.0 ** 31:
            return ((self.n * y - r) ** 2).sum(axis=1).tolist()
        exact = ((self.n * y.astype(object) - r.astype(object)) ** 2).sum(axis=1)
        return [d if d < 1 << 63 else None for d in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and
    identity_error of every usable row and component."""
    spark = vectors.sparkSession
    rows, dim = _integers(vectors)
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    if not dim:
        return spark.createDataFrame([], schema)
    fitted = Whitening(rows, dim, components)
    k = len(fitted.value)
    explained = [e / fitted.trace if fitted.trace else None for e in fitted.value.tolist()]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = _matrix(batch, 1, dim), batch.num_rows
            if not m:
                continue
            each = pa.array(np.repeat(np.arange(m), k))
            w = pa.array(fitted.whitened(x).ravel(), mask=np.tile(~fitted.usable, m))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, fitted.n)), pa.array(fitted.deviation(x), pa.int64()).take(each), w,
                 pa.array(explained * m, pa.float64()), pa.array([fitted.identity_error] * (m * k), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)

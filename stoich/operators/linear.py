"""Linear models from distributed sufficient statistics.

One pass over the rows computes, per group (e.g. seed x fold x feature
kind), the statistics n, sum y, sum y^2, sum x, X^T y and X^T X: a
``mapInArrow`` multiplies each Arrow batch locally (BLAS) and emits a few
rows per task, which a partial + final aggregate sums.  Nothing on the
driver grows with the number of rows: only groups x (d^2 + 2d + 3) numbers.
Folds then need no second pass: the training statistics of fold f are the
total minus fold f.  Solves are d x d in numpy on the driver (d is the
feature count, tens to a few hundreds).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Stats:
    n: float
    sy: float
    syy: float
    sx: np.ndarray
    xty: np.ndarray
    xtx: np.ndarray

    def __sub__(self, o: Stats) -> Stats:
        return Stats(self.n - o.n, self.sy - o.sy, self.syy - o.syy, self.sx - o.sx,
                     self.xty - o.xty, self.xtx - o.xtx)

    def __add__(self, o: Stats) -> Stats:
        return Stats(self.n + o.n, self.sy + o.sy, self.syy + o.syy, self.sx + o.sx,
                     self.xty + o.xty, self.xtx + o.xtx)

    def select(self, idx: Sequence[int]) -> Stats:
        ix = np.asarray(idx, dtype=int)
        return Stats(self.n, self.sy, self.syy, self.sx[ix], self.xty[ix], self.xtx[np.ix_(ix, ix)])


TREE_WIDTH = 64


def gram_stats(df: DataFrame, features: str, y: str, group: Sequence[str], d: int) -> DataFrame:
    """(group..., vec): per group one array [n, sy, syy, sx(d), xty(d),
    xtx(d*d)].  A task emits one array per group that it saw; arrays are added
    in two steps, so no task adds more than its share of them."""
    group = list(group)
    gschema = [df.schema[g] for g in group]
    vec_field = T.StructField("vec", T.BinaryType())
    out_schema = T.StructType([*gschema, T.StructField("_part", T.IntegerType()), vec_field])

    def part(batches):
        from pyspark import TaskContext

        from stoich.operators.crossval import dense
        number = TaskContext.get().partitionId() % TREE_WIDTH
        acc: dict = {}
        for batch in batches:
            types = [c.type for c in batch.columns[:len(group)]]
            if not batch.num_rows:
                continue
            rows, target = dense(batch.column(len(group)), d), batch.column(len(group) + 1).to_numpy(zero_copy_only=False)
            target = target.astype(np.float64)
            keys = pa.table(batch.columns[:len(group)], names=group).to_pandas() if group else None
            for key, at in (keys.groupby(group, sort=False).indices.items() if group else [((), slice(None))]):
                key = key if isinstance(key, tuple) else (key,)
                x, yy = rows[at], target[at]
                vec = np.concatenate([[len(x), yy.sum(), yy @ yy], x.sum(axis=0), x.T @ yy, (x.T @ x).ravel()])
                acc[key] = acc[key] + vec if key in acc else vec
        if not acc:
            return
        columns = [pa.Array.from_pandas(pd.Series([k[i] for k in acc])).cast(types[i]) for i in range(len(group))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([number] * len(acc), pa.int32()),
                                          pa.array([v.tobytes() for v in acc.values()], pa.binary())],
                                         names=[*group, "_part", "vec"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        # a fixed order of addition: results do not depend on arrival
        total = sum(np.frombuffer(v, np.float64) for v in sorted(pdf["vec"]))
        return pdf.iloc[:1].assign(vec=[total.tobytes()])

    partial = df.select(*group, features, y).mapInArrow(part, out_schema)
    partial = partial.groupBy(*group, "_part").applyInPandas(add, out_schema).withColumn("_part", F.lit(0))
    return partial.groupBy(*group, "_part").applyInPandas(add, out_schema).drop("_part")


def collect_stats(stats: DataFrame, group: Sequence[str], d: int) -> dict[tuple, Stats]:
    """Bring the (small) statistics table to the driver as Stats objects."""
    out = {}
    for r in stats.collect():
        v = np.frombuffer(r["vec"], np.float64)
        out[tuple(r[g] for g in group)] = Stats(v[0], v[1], v[2], v[3:3 + d], v[3 + d:3 + 2 * d],
                                                v[3 + 2 * d:].reshape(d, d))
    return out


def ridge_fit(train: Stats, alpha: float = 1.0, standardise: bool = False) -> tuple[np.ndarray, float]:
    """Ridge with intercept: minimises ||y - Xb - c||^2 + alpha ||b||^2 (the
    penalty on the sum of squares, as the common library does) on centred
    statistics; ``standardise`` scales features by their training std
    (population), zero std -> 1."""
    n = train.n
    mx = train.sx / n
    my = train.sy / n
    a = train.xtx - n * np.outer(mx, mx)
    c = train.xty - n * mx * my
    if standardise:
        s = np.sqrt(np.clip(np.diag(a) / n, 0, None))
        s[s == 0] = 1.0
        a = a / np.outer(s, s)
        c = c / s
    beta = np.linalg.solve(a + alpha * np.eye(len(c)), c) if len(c) else np.zeros(0)
    if standardise:
        beta = beta / s
    return beta, float(my - mx @ beta)


def elastic_net_fit(train: Stats, alpha: float = 1.0, l1_ratio: float = 0.5, tol: float = 1e-8,
                    max_iter: int = 10_000) -> tuple[np.ndarray, float]:
    """M6: minimises ||y - Xb - c||^2 / (2n) + alpha (l1_ratio |b|_1 +
    (1 - l1_ratio) |b|^2 / 2) by coordinate descent on the centred Gram
    matrix; ``l1_ratio=1`` is the lasso.  No pass over the rows."""
    n, mx, my = train.n, train.sx / train.n, train.sy / train.n
    a = train.xtx / n - np.outer(mx, mx)
    c = train.xty / n - mx * my
    scale = np.diag(a) + alpha * (1 - l1_ratio)
    beta = np.zeros(len(c))
    slope = np.zeros(len(c))            # a @ beta
    for _ in range(max_iter):
        moved = 0.0
        for j in np.flatnonzero(scale > 0):
            pull = c[j] - slope[j] + a[j, j] * beta[j]
            new = np.sign(pull) * max(abs(pull) - alpha * l1_ratio, 0.0) / scale[j]
            if new != beta[j]:
                slope += a[:, j] * (new - beta[j])
                moved = max(moved, abs(new - beta[j]))
                beta[j] = new
        if moved <= tol * max(1.0, np.abs(beta).max(initial=0.0)):
            break
    return beta, float(my - mx @ beta)


def sse(test: Stats, beta: np.ndarray, b0: float) -> float:
    """Sum of squared residuals of (beta, b0) on the rows behind ``test``."""
    return float(test.syy - 2 * (beta @ test.xty + b0 * test.sy) + beta @ test.xtx @ beta
                 + 2 * b0 * (beta @ test.sx) + test.n * b0 * b0)


def pooled_r2(total: Stats, folds: dict, alpha: float = 1.0, standardise: bool = False) -> float:
    """R^2 of the out-of-fold predictions pooled over all folds."""
    s = 0.0
    for f, st in folds.items():
        beta, b0 = ridge_fit(total - st, alpha, standardise)
        s += sse(st, beta, b0)
    sst = total.syy - total.sy ** 2 / total.n
    return 1.0 - s / sst if sst > 0 else (1.0 if s == 0 else 0.0)


def cv_coefficients(stats: dict[tuple, Stats], fold_pos: int, alpha: float = 1.0,
                    standardise: bool = False, fit=None) -> list[tuple]:
    """Per (group..., fold) coefficients fitted on all other folds of the
    same group, by ridge or by ``fit(stats)``.  ``fold_pos`` is the index of
    the fold in the key tuple."""
    totals: dict[tuple, Stats] = {}
    for key, st in stats.items():
        g = key[:fold_pos] + key[fold_pos + 1:]
        totals[g] = totals[g] + st if g in totals else st
    rows = []
    for key, st in stats.items():
        g = key[:fold_pos] + key[fold_pos + 1:]
        beta, b0 = fit(totals[g] - st) if fit else ridge_fit(totals[g] - st, alpha, standardise)
        rows.append((*key, [float(x) for x in beta], b0))
    return rows


def predict_with(df: DataFrame, coefs: DataFrame, keys: Sequence[str], features: str = "features",
                 out: str = "pred") -> DataFrame:
    """Row-level predictions: join the (small) coefficient table on the
    group/fold keys (broadcast) and take the dot product as an expression."""
    c = F.broadcast(coefs)
    j = df.join(c, list(keys))
    dot = F.aggregate(F.zip_with(F.col(features), F.col("coef"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return j.withColumn(out, dot + F.col("intercept")).drop("coef", "intercept")


def bayesian_ridge(st: Stats, n_iter: int = 300, tol: float = 1e-3, a1=1e-6, a2=1e-6, l1=1e-6, l2=1e-6):
    """M7: evidence-maximising ridge (MacKay fixed point) on centred
    statistics; returns (coef, intercept, alpha, lambda)."""
    n = st.n
    mx, my = st.sx / n, st.sy / n
    a = st.xtx - n * np.outer(mx, mx)
    c = st.xty - n * mx * my
    yy = st.syy - n * my * my
    eig, vec = np.linalg.eigh(a)
    eig = np.clip(eig, 0, None)
    alpha, lam = 1.0 / max(yy / n, 1e-12), 1.0
    coef = np.zeros(len(c))
    for _ in range(n_iter):
        coef_new = vec @ ((vec.T @ c) / (eig + lam / alpha))
        rss = yy - 2 * coef_new @ c + coef_new @ a @ coef_new
        gamma = float(np.sum(alpha * eig / (lam + alpha * eig)))
        lam = (gamma + 2 * l1) / (coef_new @ coef_new + 2 * l2)
        alpha = (n - gamma + 2 * a1) / (rss + 2 * a2)
        if np.sum(np.abs(coef_new - coef)) < tol:
            coef = coef_new
            break
        coef = coef_new
    return coef, float(my - mx @ coef), float(alpha), float(lam)


def pls_fit(st: Stats, n_components: int = 2):
    """M9: PLS regression (SIMPLS, de Jong 1993) from the covariance
    statistics; returns (coef, intercept) in original units."""
    n = st.n
    mx, my = st.sx / n, st.sy / n
    sxx = st.xtx - n * np.outer(mx, mx)
    sxy = st.xty - n * mx * my
    d = len(sxy)
    r_mat, p_mat, q = np.zeros((d, 0)), np.zeros((d, 0)), []
    v_mat = np.zeros((d, 0))
    s = sxy.copy()
    for _ in range(min(n_components, d)):
        r = s / (np.linalg.norm(s) or 1.0)
        t_var = r @ sxx @ r
        if t_var <= 0:
            break
        p = sxx @ r / t_var
        qk = (r @ sxy) / t_var
        v = p - v_mat @ (v_mat.T @ p)
        v /= np.linalg.norm(v) or 1.0
        s = s - v * (v @ s)
        r_mat = np.column_stack([r_mat, r])
        p_mat = np.column_stack([p_mat, p])
        v_mat = np.column_stack([v_mat, v])
        q.append(qk)
    coef = r_mat @ np.asarray(q) if q else np.zeros(d)
    return coef, float(my - mx @ coef)

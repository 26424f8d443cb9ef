"""The models that are compared, and their comparison on one split.

Every model of the registry is a function of a :class:`Split`: the rows in one
written table, the fold sums and the robust scaler of its training part.  It
returns one row (n, mae, r2) over the test part.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stoich.operators import crossval as CV
from stoich.operators import linear as L
from stoich.operators import metrics as M
from stoich.operators import models as ML
from stoich.operators import trees as TR
from stoich.operators.neighbors import knn_predict
from stoich.session import cut_lineage

TEST = 1                        # the fold that is held out
RFF = 256


@dataclass
class Split:
    """Rows (id, features, y, folds): fold 0 trains, fold 1 tests."""

    rows: DataFrame
    d: int

    @staticmethod
    def of(rows: DataFrame, features: str, y: str, key: str, d: int, is_test: Column) -> Split:
        table = rows.where(F.col(y).isNotNull()).select(
            F.col(key).cast("bigint").alias("id"), F.col(features).alias("features"), F.col(y).cast("double").alias("y"),
            F.array(F.coalesce(is_test, F.lit(False)).cast("int")).alias("folds"))
        return Split(cut_lineage(table), d)

    @property
    def train(self) -> DataFrame:
        return self.rows.where(F.col("folds")[0] != TEST)

    @property
    def test(self) -> DataFrame:
        return self.rows.where(F.col("folds")[0] == TEST)

    @cached_property
    def folded(self) -> CV.Folded:
        return CV.Folded(self.rows, self.d, 2, [0])

    @cached_property
    def moments(self) -> np.ndarray:
        return CV.fold_moments(self.folded)

    @cached_property
    def scales(self) -> np.ndarray:
        """Median and width of every feature over the training part."""
        return CV.robust_scales(self.folded)

    @cached_property
    def binned(self) -> TR.Binned:
        return TR.binned(self.train, "features", "y", "id", self.d)

    @cached_property
    def scaled(self) -> DataFrame:
        """The rows with robust-scaled features."""
        middle, width = self.scales[0, TEST]
        at = lambda v: F.array(*[F.lit(float(x)) for x in v])
        moved = F.zip_with(F.zip_with("features", at(middle), lambda x, m: x - m), at(width), lambda x, w: x / w)
        return cut_lineage(self.rows.withColumn("features", moved))


def _linear(fit: Callable | None = None) -> Callable[[Split], DataFrame]:
    def run(split: Split) -> DataFrame:
        coef = CV.coefficients(split.folded, split.moments, split.scales, fit=fit)
        return CV.cv_scores(CV.Folded(split.test, split.d, 2, [0]), coef).select("n", "mae", "r2")

    return run


def _forest(make: Callable) -> Callable[[Split], DataFrame]:
    def run(split: Split) -> DataFrame:
        out = make(split.binned).predict(split.test, "features")
        return M.regression_metrics(out.select("y", F.col("values")[0].alias("pred")))

    return run


def _boosted(kind: str) -> Callable[[Split], DataFrame]:
    def run(split: Split) -> DataFrame:
        model = ML.boosted_trees(split.binned, kind, **ML.EARLY_STOP)
        return M.regression_metrics(model.predict(split.test, "features", "pred"))

    return run


def _huber(split: Split) -> DataFrame:
    scaled = ML.as_ml(split.scaled.select("id", "features", "y", "folds"))
    test = F.col("folds")[0] == TEST
    out = ML.huber().fit(scaled.where(~test)).transform(scaled.where(test))
    return M.regression_metrics(out.select(F.col("label").alias("y"), F.col("prediction").alias("pred")))


def _knn(split: Split) -> DataFrame:
    test = F.col("folds")[0] == TEST
    out = knn_predict(split.scaled.where(test), split.scaled.where(~test), k=5, id_col="id")
    return M.regression_metrics(out.join(split.test.select("id", "y"), "id").select("y", "pred"))


def _kernel_ridge(split: Split) -> DataFrame:
    rows = random_fourier(split.scaled, "features", split.d, RFF)
    folded = CV.Folded(cut_lineage(rows), RFF, 2, [0])
    coef = CV.coefficients(folded, CV.fold_moments(folded))
    test = CV.Folded(folded.rows.where(F.col("folds")[0] == TEST), RFF, 2, [0])
    return CV.cv_scores(test, coef).select("n", "mae", "r2")


def random_fourier(rows: DataFrame, features: str, d: int, n: int, seed: int = ML.SEED) -> DataFrame:
    """``features`` mapped to ``n`` random Fourier features of the RBF
    kernel with gamma 1/d (Rahimi & Recht 2007)."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0.0, np.sqrt(2.0 / d), (n, d)), rng.uniform(0, 2 * np.pi, n)
    at = rows.columns.index(features)
    schema = T.StructType([T.StructField(features, T.ArrayType(T.DoubleType())) if f.name == features else f
                           for f in rows.schema])

    def run(batches):
        for batch in batches:
            z = np.sqrt(2.0 / n) * np.cos(CV.dense(batch.column(at), d) @ w.T + b)
            ends = pa.array(np.arange(len(z) + 1, dtype=np.int32) * n)
            cols = list(batch.columns)
            cols[at] = pa.ListArray.from_arrays(ends, pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.mapInArrow(run, schema)


def models() -> dict[str, Callable[[Split], DataFrame]]:
    """Name -> test figures of the model fitted on the training part."""
    out = {
        "random_forest": _forest(ML.random_forest),
        "decision_tree": _forest(ML.decision_tree),
        "bagging": _forest(ML.bagged_trees),
        "ridge": _linear(),
        "lasso": _linear(lambda st: L.elastic_net_fit(st, 0.001, 1.0)),
        "elastic_net": _linear(lambda st: L.elastic_net_fit(st, 0.001, 0.5)),
        "bayesian_ridge": _linear(lambda st: L.bayesian_ridge(st)[:2]),
        "pls": _linear(lambda st: L.pls_fit(st, 2)),
        "kernel_ridge_rff": _kernel_ridge,
        "huber": _huber,
        "knn": _knn,
    }
    return out | {kind: _boosted(kind) for kind in ML.BOOSTING_PARAMS}


def compare_models(split: Split, which: dict[str, Callable] | None = None) -> DataFrame:
    """One row per model.  A model that fails, or returns no figures, fails the
    comparison: a row without figures would look like a result.  Boosted models
    that one task fits each run side by side."""
    which = models() if which is None else which

    def figures(name: str) -> tuple:
        try:
            r = which[name](split).first()
        except Exception as e:
            raise RuntimeError(f"model {name} failed: {type(e).__name__}: {e}"[:500]) from e
        if r is None:
            raise RuntimeError(f"model {name} returned no figures")
        return name, r["n"], r["mae"], r["r2"]

    together = [name for name in which if name in ML.BOOSTING_PARAMS]
    found = {}
    if len(together) > 1 and split.binned.whole is not None:
        with ThreadPoolExecutor(len(together)) as pool:
            found = dict(zip(together, pool.map(figures, together)))
    rows = [found.get(name) or figures(name) for name in which]
    return split.rows.sparkSession.createDataFrame(rows, "model string, n long, mae double, r2 double")

"""Models with the parameter choices of the reference.

Trees come from :mod:`stoich.operators.trees`; the others are ``pyspark.ml``
estimators reading a vector column ``features`` and a ``label`` column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoich.functions.rng import uniform
from stoich.operators.trees import Binned, Boosted, Forest, fit_boosting, fit_forest

SEED = 43


def forest_estimator(n_trees: int = 100, max_depth: int = 5) -> RandomForestRegressor:
    """An MLlib forest for pipelines that are saved and loaded."""
    return RandomForestRegressor(numTrees=n_trees, maxDepth=max_depth, featureSubsetStrategy="all", seed=SEED,
                                 featuresCol="features", labelCol="label")


def random_forest(data: Binned, n_trees: int = 100, **how) -> Forest:
    """M1: 100 trees without a depth limit, every feature at each split, seed 43."""
    return fit_forest(data, n_trees, SEED, **how)


def random_forest_classifier(data: Binned, n_trees: int = 100, **how) -> Forest:
    """M2: the square root of the features at each split."""
    return fit_forest(data, n_trees, SEED, n_features=max(1, int(data.d ** 0.5)), **how)


def decision_tree(data: Binned, **how) -> Forest:
    """M3: one tree on all rows."""
    return fit_forest(data, 1, SEED, bootstrap=False, **how)


def bagged_trees(data: Binned, n_trees: int = 200, **how) -> Forest:
    """M4: bagging = a forest that considers every feature at each split."""
    return fit_forest(data, n_trees, SEED, **how)


# Parameter sets of the boosting wrappers, one entry per wrapper
# (a limit of 31 leaves is a depth of 5 here, where trees grow level by level).
BOOSTING_PARAMS = {
    "gradient_boosting": dict(rounds=100, rate=0.1, max_depth=3),
    "hist_gradient_boosting": dict(rounds=100, rate=0.1, max_depth=5, min_leaf=20),
    "xgb": dict(rounds=500, rate=0.05, max_depth=6, subsample=0.8, columns=0.8, l2=1.0),
    "xgb_tuned": dict(rounds=242, rate=0.15, max_depth=10, subsample=0.87, l2=1.0),
    "lgbm": dict(rounds=1000, rate=0.03, max_depth=5, subsample=0.8, columns=0.8, l2=1.0, min_leaf=20),
    "catboost": dict(rounds=2000, rate=0.03, max_depth=6, l2=3.0),
}
#: Share of the training rows that decides when boosting stops, and how many
#: rounds it goes on without a lower loss there.
EARLY_STOP = dict(validation=0.1, patience=40)


def boosted_trees(data: Binned, kind: str = "gradient_boosting", **changed) -> Boosted:
    """M5: one operator with the parameter sets of the wrappers."""
    return fit_boosting(data, **{**BOOSTING_PARAMS[kind], "seed": SEED, **changed})


def huber() -> LinearRegression:
    """M8: Huber loss, epsilon 1.35, up to 1000 iterations."""
    return LinearRegression(loss="huber", epsilon=1.35, maxIter=1000, featuresCol="features", labelCol="label")


def as_ml(df: DataFrame, features: str = "features", label: str | None = "y") -> DataFrame:
    """array<double> features -> ML vector column ``features`` (+ ``label``)."""
    cols = [array_to_vector(F.col(features)).alias("features")]
    if label:
        cols.append(F.col(label).cast("double").alias("label"))
    keep = [c for c in df.columns if c not in (features, label)]
    return df.select(*keep, *cols)


def feature_importance(forest: Forest) -> list[tuple[str, float]]:
    """(Feature_i, importance) of a fitted forest; sums to 1."""
    return [(f"Feature_{i}", float(v)) for i, v in enumerate(forest.importance())]


def scaled_pipeline(estimator) -> Pipeline:
    """Scaler + model as one pipeline (saved and loaded together, K7)."""
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="_scaled", withMean=True, withStd=True),
                            estimator.copy().setFeaturesCol("_scaled")])


def pca_2d(df: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """PCA to 2 components fitted on ``fit_on`` (centred), applied to
    ``df``; each component's sign is fixed so its largest loading is
    positive.  Returns df with ``pc1``, ``pc2``."""
    fit_on = df if fit_on is None else fit_on
    center = StandardScaler(inputCol="features", outputCol="_c", withMean=True, withStd=False).fit(fit_on)
    pca = PCA(k=2, inputCol="_c", outputCol="_pc").fit(center.transform(fit_on))
    pc = pca.pc.toArray()
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    out = pca.transform(center.transform(df)).withColumn("_pa", vector_to_array("_pc"))
    return out.withColumn("pc1", F.col("_pa")[0] * signs[0]).withColumn("pc2", F.col("_pa")[1] * signs[1]) \
        .drop("_c", "_pc", "_pa")


def save_load(model: PipelineModel, path: str) -> PipelineModel:
    """K7: persist a fitted pipeline and read it back."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def trial_table(ids: DataFrame, key: str, grid: dict[str, Sequence], seed="trial") -> DataFrame:
    """One random hyperparameter trial per row: every parameter takes a
    value of its list by a hash of (seed, key, name)."""
    return ids.select(key, *[
        F.element_at(F.array(*[F.lit(v) for v in values]),
                     (F.floor(uniform(seed, F.col(key), F.lit(name)) * len(values)) + 1).cast("int")).alias(name)
        for name, values in grid.items()])


def trial_grid(n_trials: int, seed: int = 0, grid: dict[str, Sequence] | None = None) -> list[dict]:
    """G12 for a search on the driver: ``n_trials`` parameter sets drawn by
    hash from lists (the evaluation of each trial is distributed)."""
    import hashlib
    grid = grid or {"numTrees": [50, 100, 200], "maxDepth": [3, 5, 8, 12], "minInstancesPerNode": [1, 2, 4]}

    def pick(t: int, name: str):
        h = int(hashlib.md5(f"{seed}|{t}|{name}".encode()).hexdigest()[:8], 16)
        return grid[name][h % len(grid[name])]

    return [{name: pick(t, name) for name in grid} for t in range(n_trials)]

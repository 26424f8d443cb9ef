"""MLlib model queries (M1-M5, M8, M15-M18, M23, K7) and grouped outer
evaluation (G5, M14).  These are checked by row counts and invariants
(models are not SQL)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stoich.functions.rng import uniform
from stoich.operators import linear as L
from stoich.operators import metrics as M
from stoich.operators import models as ML
from stoich.operators import registry as RG
from stoich.operators import trees as TR
from stoich.operators import tuning as TU
from stoich.operators.folds import group_kfold
from stoich.plans.catalog import query
from stoich.plans.q_composition import ALL_BRANDS, _shares, weighted_matrix
from stoich.plans.q_models import D, _model_rows, _model_samples, _n_classes
from stoich.session import cut_lineage, ensure_checkpoint_dir
from stoich.sources import fixtures as FX
from stoich.operators import composition as C


def _split(spark, sf_dir):
    """Training and test rows as ML vectors."""
    rows = ML.as_ml(_model_rows(spark, sf_dir))
    rows = rows.withColumn("is_test", uniform("holdout", F.col("sample_id")) < 0.2)
    return rows.where(~F.col("is_test")), rows.where("is_test")


def _test_metrics(model, test, name):
    p = model.transform(test).select(F.col("label").alias("y"), F.col("prediction").alias("pred"))
    return M.regression_metrics(p).select(F.lit(name).alias("model"), "n", "mae", "r2")


def _holdout(spark, sf_dir) -> RG.Split:
    """The weighted features with a fifth of the orders held out by hash."""
    return RG.Split.of(_model_rows(spark, sf_dir), "features", "y", "sample_id", D,
                       uniform("holdout", F.col("sample_id")) < 0.2)


def _figures(spark, sf_dir, name):
    return RG.models()[name](_holdout(spark, sf_dir)).select(F.lit(name).alias("model"), "n", "mae", "r2")


@query("m1_random_forest")
def m1_random_forest(spark, sf_dir):
    """M1: 100-tree forest without a depth limit on the 64 weighted features;
    test MAE, R^2."""
    return _figures(spark, sf_dir, "random_forest")


@query("m2_random_forest_classifier")
def m2_random_forest_classifier(spark, sf_dir):
    """M2: forest classifier of the embedding class; accuracy and weighted F1."""
    v = FX.vectors(spark, sf_dir).where("label IS NOT NULL").withColumn(
        "is_test", uniform("holdout", F.col("vec_id")) < 0.2)
    n = _n_classes(spark, sf_dir)
    data = TR.binned(v.where(~F.col("is_test")), "features", "label", "vec_id", D, classes=n)
    out = ML.random_forest_classifier(data).predict(v.where("is_test"), "features")
    told = F.array_position("values", F.array_max("values")) - 1
    return M.classification_metrics(out.select(F.col("label").alias("y"), told.alias("pred")))


@query("m3_decision_tree")
def m3_decision_tree(spark, sf_dir):
    """M3: one tree grown until its leaves are pure."""
    return _figures(spark, sf_dir, "decision_tree")


@query("m4_bagged_trees")
def m4_bagged_trees(spark, sf_dir):
    """M4: 200 bagged trees (every feature at every split)."""
    return _figures(spark, sf_dir, "bagging")


def _boosting(kind):
    """M5: the full rounds where they are 100; the longer presets stop early
    on a tenth of the training rows."""
    def run(spark, sf_dir):
        split = _holdout(spark, sf_dir)
        long = ML.BOOSTING_PARAMS[kind]["rounds"] > 100
        model = ML.boosted_trees(split.binned, kind, **(ML.EARLY_STOP if long else {}))
        out = M.regression_metrics(model.predict(split.test, "features", "pred"))
        return out.select(F.lit(kind).alias("model"), F.lit(len(model.trees)).alias("n_trees"), "n", "mae", "r2")

    run.__doc__ = f"M5: boosted trees with the parameters of {kind}; test figures and trees kept."
    return run


for _kind in ML.BOOSTING_PARAMS:
    query(f"m5_{_kind}")(_boosting(_kind))


@query("m5_boosted_trees")
def m5_boosted_trees(spark, sf_dir):
    """M5: every preset on the same split, all with early stopping."""
    return RG.compare_models(_holdout(spark, sf_dir), {k: RG.models()[k] for k in ML.BOOSTING_PARAMS})


@query("m8_huber")
def m8_huber(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return _test_metrics(ML.huber().fit(train), test, "huber")


@query("m15_compare_models")
def m15_compare_models(spark, sf_dir):
    """Every model of the registry on the same split, one row per model;
    a model that fails fails the query, so ``error`` is null in every row."""
    return RG.compare_models(_holdout(spark, sf_dir)).withColumn("error", F.lit(None).cast("string"))


@query("m16_feature_importance")
def m16_feature_importance(spark, sf_dir):
    """Forest importances named Feature_i (they sum to 1)."""
    imp = ML.feature_importance(ML.random_forest(_holdout(spark, sf_dir).binned))
    return spark.createDataFrame(imp, "feature string, importance double").orderBy(F.col("importance").desc())


@query("m17_predict_compositions")
def m17_predict_compositions(spark, sf_dir):
    """M17 + K7: scaler + forest pipeline fitted, saved to the shared
    checkpoint folder, loaded back, and applied to every composition's
    weighted features."""
    rows = ML.as_ml(_model_rows(spark, sf_dir))
    train = rows.where(~(uniform("holdout", F.col("sample_id")) < 0.2))
    model = ML.scaled_pipeline(ML.forest_estimator(100)).fit(train)
    path = os.path.join(ensure_checkpoint_dir(spark), "models", f"m17-{uuid.uuid4().hex}")
    loaded = ML.save_load(model, path)
    rows = rows.drop("label")
    return loaded.transform(rows).select("sample_id", F.col("prediction").alias("pred"))


@query("m18_pca_2d")
def m18_pca_2d(spark, sf_dir):
    """Two principal components of the weighted features (sign fixed)."""
    rows = ML.as_ml(_model_rows(spark, sf_dir), label=None)
    return ML.pca_2d(rows).select("sample_id", "pc1", "pc2")


# The lists that a trial's parameters are drawn from.
TRIAL_GRID = {"numTrees": [20, 40, 60], "maxDepth": [3, 5, 8], "minInstancesPerNode": [1, 2, 4]}


@query("m23_hyperparameter_search")
def m23_hyperparameter_search(spark, sf_dir):
    """M23 + G12: 50 random trials of forest parameters, 10 folds with
    successive halving; every distinct trial with its pooled out-of-fold R^2
    and MAE, and the test figures of the best one."""
    split = _holdout(spark, sf_dir)
    found = TU.search(split.binned, ML.trial_grid(50, seed=1, grid=TRIAL_GRID))
    best = found[0]
    forest = TR.fit_forest(split.binned, best["numTrees"], max_depth=best["maxDepth"], min_leaf=best["minInstancesPerNode"])
    test = M.regression_metrics(forest.predict(split.test, "features").select("y", F.col("values")[0].alias("pred"))).first()
    rows = [(i, r["numTrees"], r["maxDepth"], r["minInstancesPerNode"], r["folds"], r["r2"], r["mae"],
             test["r2"] if not i else None, test["mae"] if not i else None) for i, r in enumerate(found)]
    return spark.createDataFrame(rows, "place int, num_trees int, max_depth int, min_leaf int, n_folds int, cv_r2 double, "
                                       "cv_mae double, test_r2 double, test_mae double")


def _group_folds(spark, sf_dir, rows):
    """(sample_id, signature, fold) of the rows; the signatures come from their
    packed shares, if they have them, and are written once."""
    if "_parts" in rows.columns:
        sig = C.signature_of_parts(rows, ALL_BRANDS)
    else:
        sig = rows.select("sample_id").join(C.signature(_shares(spark, sf_dir), ALL_BRANDS), "sample_id")
    return group_kfold(cut_lineage(sig), "signature", 10, "sample_id").select("sample_id", "signature", "fold")


@query("g5_group_kfold")
def g5_group_kfold(spark, sf_dir):
    """10 folds over orders grouped by composition signature (A2): a
    signature never spans folds; largest groups first into the lightest
    fold.  Invariants are tested against a direct greedy loop."""
    weighted = weighted_matrix(spark, sf_dir)
    if weighted is None:
        return _group_folds(spark, sf_dir, _model_rows(spark, sf_dir))
    samples = _model_samples(weighted, FX.targets(spark, sf_dir).select("sample_id", "y"))
    return _group_folds(spark, sf_dir, samples.packed)


@query("m14_grouped_cv")
def m14_grouped_cv(spark, sf_dir):
    """Outer CV with composition groups (G5), ridge with train-only
    standard scaling from fold statistics, per-fold R^2/MAE summarised
    (A16)."""
    g = _model_rows(spark, sf_dir, tag=lambda rows: rows.join(_group_folds(
        spark, sf_dir, rows).select("sample_id", "fold").dropDuplicates(["sample_id"]), "sample_id"))
    st = L.collect_stats(L.gram_stats(g, "features", "y", ["fold"], D), ["fold"], D)
    tot = None
    for s in st.values():
        tot = s if tot is None else tot + s
    rows = []
    for (fold,), s in st.items():
        beta, b0 = L.ridge_fit(tot - s, 1.0, standardise=True)
        sse = L.sse(s, beta, b0)
        sst = s.syy - s.sy ** 2 / s.n
        rows.append((int(fold), 1.0 - sse / sst if sst > 0 else 0.0, [float(b) for b in beta], float(b0)))
    cdf = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], T.StructType([
        T.StructField("fold", T.LongType()), T.StructField("coef", T.ArrayType(T.DoubleType())),
        T.StructField("intercept", T.DoubleType())]))
    pred = L.predict_with(g, cdf, ["fold"])
    fm = M.regression_metrics(pred, ["fold"]).withColumn("_m", F.lit("ridge"))
    return M.cv_summary(fm, ["_m"]).select(F.col("_m").alias("model"), "r2_mean", "r2_std", "mae_mean", "mae_std",
                                            F.size("per_fold_r2").alias("n_folds"))

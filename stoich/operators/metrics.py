"""Prediction metrics as one-pass aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(pairs: DataFrame, keys: Sequence[str] = (), y: str = "y",
                       pred: str = "pred") -> DataFrame:
    """MAE and R^2 on pooled pairs from sufficient sums (n, sum y,
    sum y^2, sum residual^2): one aggregate, partial sums map-side.
    R^2 with zero total variance is 1.0 if residuals are zero, else 0.0
    (the common library convention)."""
    keys = list(keys)
    r = F.col(y) - F.col(pred)
    agg = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(r)).alias("mae"),
        F.sum(r * r).alias("_ssr"), F.var_pop(y).alias("_vary"))
    sst = F.col("_vary") * F.col("n")
    r2 = F.when(sst > 0, F.lit(1.0) - F.col("_ssr") / sst).otherwise(
        F.when(F.col("_ssr") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return agg.select(*keys, "n", "mae", r2.alias("r2"))


def classification_metrics(pairs: DataFrame, keys: Sequence[str] = (), y: str = "y",
                           pred: str = "pred") -> DataFrame:
    """Accuracy and support-weighted F1 from the confusion counts
    (groupBy (y, pred).count - bounded by classes^2 per key).  A class with no
    prediction or no support has F1 = 0."""
    keys = list(keys)
    conf = pairs.groupBy(*keys, y, pred).agg(F.count(F.lit(1)).alias("c"))
    tp = conf.where(F.col(y) == F.col(pred)).select(*keys, F.col(y).alias("cls"), F.col("c").alias("tp"))
    support = conf.groupBy(*keys, F.col(y).alias("cls")).agg(F.sum("c").alias("support"))
    predicted = conf.groupBy(*keys, F.col(pred).alias("cls")).agg(F.sum("c").alias("npred"))
    per = (support.join(predicted, [*keys, "cls"], "full").join(tp, [*keys, "cls"], "left")
           .fillna(0, subset=["support", "npred", "tp"]))
    f1 = F.when(F.col("support") + F.col("npred") > 0,
                2.0 * F.col("tp") / (F.col("support") + F.col("npred"))).otherwise(F.lit(0.0))
    return per.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1_weighted"))


def cv_summary(fold_metrics: DataFrame, keys: Sequence[str], fold: str = "fold",
               metrics: Sequence[str] = ("r2", "mae")) -> DataFrame:
    """Mean and population std of each fold metric, plus the per-fold
    values in fold order (one entry per fold: bounded by k)."""
    keys = list(keys)
    def field(name):
        return lambda s: s[name]

    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"),
                 F.transform(F.array_sort(F.collect_list(F.struct(F.col(fold), F.col(m)))),
                             field(m)).alias(f"per_fold_{m}")]
    return fold_metrics.groupBy(*keys).agg(*aggs)

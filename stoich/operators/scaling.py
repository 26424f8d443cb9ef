"""Feature scaling fitted by distributed aggregates.

Both scalers work on the long form ``(row key..., feature_id, value)``: the
fit is one row per feature (bounded by the number of features) and is
broadcast back after a size check.  ``fit_on`` selects the rows the scaler
is fitted on (train rows only by default in the callers; pass the whole
table to reproduce fitting before the folds)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoich.operators import crossval as CV
from stoich.operators.quantiles import exact_quantiles
from stoich.session import bounded_broadcast


def robust_fit(fit_on: DataFrame, feature: str = "feature_id", value: str = "value") -> DataFrame:
    """N1 fit: exact q25, median, q75 per feature (linear interpolation);
    a zero inter-quartile range scales by 1."""
    q = exact_quantiles(fit_on, [feature], value, [0.25, 0.5, 0.75])
    p = q.groupBy(feature).agg(*[F.max(F.when(F.col("q") == v, F.col("quantile"))).alias(n)
                                 for v, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))])
    iqr = F.col("q75") - F.col("q25")
    return p.select(feature, "median", F.when(iqr == 0, F.lit(1.0)).otherwise(iqr).alias("scale"))


def robust_fit_arrays(rows: DataFrame, id_col: str, features: str, d: int,
                      known: tuple[int, DataFrame] | None = None) -> tuple[list[float | None], list[float]]:
    """N1 fit on rows that hold their features as one array: median (null
    without a value) and scale per position.  Ranks come from counts between
    proposed cuts, so only the values around the quartiles are sorted.
    ``known``: the number of rows and a sample of them, if at hand."""
    data = CV.Folded(rows.select(F.col(id_col).alias("id"), F.col(features).alias("features"),
                                 F.array(F.lit(0)).alias("folds")), d, 1, [0], known)
    low, middle, high = CV.fold_quantiles(data, [0.25, 0.5, 0.75])[0, 1]
    width = high - low
    return ([None if np.isnan(m) else float(m) for m in middle],
            [1.0 if w == 0 or np.isnan(w) else float(w) for w in width])


def robust_scale(df: DataFrame, fit_on: DataFrame | None = None, feature: str = "feature_id",
                 value: str = "value", out: str = "scaled", fit: DataFrame | None = None) -> DataFrame:
    """(x - median) / (q75 - q25) per feature; ``fit`` is a fit that was
    made before (feature, median, scale)."""
    fit = bounded_broadcast(robust_fit(df if fit_on is None else fit_on, feature, value) if fit is None else fit)
    return df.join(fit, feature).withColumn(out, (F.col(value) - F.col("median")) / F.col("scale")) \
        .drop("median", "scale")


def standard_fit(fit_on: DataFrame, feature: str = "feature_id", value: str = "value") -> DataFrame:
    """N2 fit: mean and population std per feature; zero std -> 1."""
    s = fit_on.groupBy(feature).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return s.select(feature, "mean", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")).alias("std"))


def standard_scale(df: DataFrame, fit_on: DataFrame | None = None, feature: str = "feature_id",
                   value: str = "value", out: str = "scaled") -> DataFrame:
    """(x - mean) / std per feature."""
    fit = bounded_broadcast(standard_fit(df if fit_on is None else fit_on, feature, value))
    return df.join(fit, feature).withColumn(out, (F.col(value) - F.col("mean")) / F.col("std")) \
        .drop("mean", "std")


def standard_inverse(df: DataFrame, fit: DataFrame, feature: str, value: str, out: str) -> DataFrame:
    """N2 inverse: x * std + mean (predictions back to the target scale)."""
    return df.join(bounded_broadcast(fit), feature).withColumn(
        out, F.col(value) * F.col("std") + F.col("mean")).drop("mean", "std")

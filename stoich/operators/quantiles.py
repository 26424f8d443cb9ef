"""Exact quantiles per group without collecting a group into one task.

``percentile`` keeps a value->count map per group; one group holding a third
of the rows would sit in one task.  Here the rows are first reduced to
(group, value, count) - a partial aggregate, so repeated values cost nothing -
and these pairs are range-sorted, which spreads a hot group over many
partitions.  Each (partition, group) slice gets its offset from a small table
of slice totals, and the pairs that cover a wanted rank are kept.  There is no
bound on group sizes, distinct values or ties.  Interpolation is linear between
the two closest ranks (``quantile_cont`` / ``percentile`` semantics).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stoich.operators.ordering import _MID, _PID, _tag_sorted
from stoich.session import bounded_broadcast


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Rows (group..., q, quantile); nulls ignored."""
    group = list(group)
    g = group or ["_q_all"]
    data = df.select(*[F.col(c) for c in group], F.col(value).cast("double").alias("_q_v")) \
        .where(F.col("_q_v").isNotNull())
    if not group:
        data = data.withColumn("_q_all", F.lit(0))
    pairs = data.groupBy(*g, "_q_v").agg(F.count(F.lit(1)).alias("_q_c"))
    tagged = _tag_sorted(pairs, [*(F.col(c) for c in g), F.col("_q_v")])
    # slices: one row per (partition, group)
    slices = tagged.groupBy(_PID, *g).agg(F.sum("_q_c").alias("_s"))
    w = Window.partitionBy(*g).orderBy(_PID)
    slices = slices.select(
        F.col(_PID).alias("_p"), *[F.col(c).alias(f"_g_{i}") for i, c in enumerate(g)],
        F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_s").over(Window.partitionBy(*g)).alias("_n"))
    inside = Window.partitionBy(_PID, *g).orderBy(_MID).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col(_PID) == F.col("_p")
    for i, c in enumerate(g):
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{i}"))
    placed = (tagged.withColumn("_in", F.coalesce(F.sum("_q_c").over(inside), F.lit(0)))
              .join(bounded_broadcast(slices), same)
              .withColumn("_from", F.col("_off") + F.col("_in")))
    ranks = F.array(*[F.struct(F.lit(float(q)).alias("q"), ((F.col("_n") - 1) * F.lit(float(q))).alias("h")) for q in qs])
    covers = lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_q_c"))
    hits = (placed.select(*g, "_q_v", "_from", "_q_c", F.explode(ranks).alias("_r"))
            .select(*g, "_q_v", F.col("_r.q").alias("q"), F.col("_r.h").alias("_h"),
                    covers(F.floor("_r.h")).alias("_lo"), covers(F.ceil("_r.h")).alias("_hi"))
            .where("_lo OR _hi"))
    res = hits.groupBy(*g, "q").agg(F.first("_h").alias("_h"), F.max(F.when(F.col("_lo"), F.col("_q_v"))).alias("_a"),
                                    F.max(F.when(F.col("_hi"), F.col("_q_v"))).alias("_z"))
    d = F.col("_h") - F.floor("_h")
    return res.select(*group, "q", F.when(d == 0, F.col("_a")).otherwise(
        F.col("_a") + d * (F.col("_z") - F.col("_a"))).alias("quantile"))


def exact_median(df: DataFrame, group: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return exact_quantiles(df, group, value, [0.5]).select(*group, F.col("quantile").alias(out))

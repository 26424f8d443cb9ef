"""Result analytics over experiment scores (D12 long form) and
feature-selection records (D13): summaries, best records, frequencies,
populations.  All are aggregates with partial (map-side) aggregation, so a
hot key is pre-aggregated before any shuffle; ranks use the distributed
ordinal helpers rather than whole-group windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoich.operators.ordering import rank_within
from stoich.operators.quantiles import exact_median
from stoich.session import bounded_broadcast


def result_summary(scores: DataFrame, keys: Sequence[str] = ("f_n", "kind", "model"),
                   score: str = "score") -> DataFrame:
    """Exact median and population std of the scores per key."""
    keys = list(keys)
    stats = scores.groupBy(*keys).agg(F.count(score).alias("n"), F.stddev_pop(score).alias("std"))
    med = exact_median(scores, keys, score)
    return stats.join(med, keys, "left")


def tsv_lines(summary: DataFrame, key: str = "f_n", extra: Sequence[str] = ()) -> DataFrame:
    """K4: 'Features<TAB>Median<TAB>Std' lines with four decimals (rounded
    half-even first, so the formatting itself never rounds)."""
    return summary.select(*extra, key, F.format_string(
        "%d\t%.4f\t%.4f", F.col(key).cast("bigint"),
        F.bround("median", 4) + F.lit(0.0), F.bround("std", 4) + F.lit(0.0)).alias("line"))


def file_means(scores: DataFrame, file_keys: Sequence[str] = ("prop_id", "f_n", "traj_id"),
               by: Sequence[str] = ("kind",), score: str = "score") -> DataFrame:
    """Mean score of each kind per result file."""
    return scores.groupBy(*file_keys, *by).agg(F.avg(score).alias("mean_score"))


def trajectory_summary(scores: DataFrame, level: Sequence[str] = ("f_n", "kind"),
                       file_keys: Sequence[str] = ("prop_id", "f_n", "traj_id"),
                       score: str = "score") -> DataFrame:
    """Mean per file, then mean and population std of those means."""
    by = [k for k in level if k not in file_keys]
    fm = file_means(scores, file_keys, by, score)
    return fm.groupBy(*level).agg(F.count(F.lit(1)).alias("n_files"),
                                  F.avg("mean_score").alias("mean"),
                                  F.stddev_pop("mean_score").alias("std"))


def subset_key(indices: Column) -> Column:
    """Sorted indices joined by '*'."""
    return F.array_join(F.array_sort(indices), "*")


def best_overall(records: DataFrame, keys: Sequence[str] = ("prop_id", "f_n"),
                 fitness: str = "fitness", order: str = "rec_id") -> DataFrame:
    """Per key, the record with the highest fitness; on a tie the first
    (lowest ``order``) wins; null fitness is skipped."""
    keys = list(keys)
    cols = [c for c in records.columns if c not in keys]
    rec = F.struct(*[F.col(c) for c in cols])
    best = (records.where(F.col(fitness).isNotNull()).groupBy(*keys)
            .agg(F.max_by(rec, F.struct(F.col(fitness), -F.col(order))).alias("_b")))
    return best.select(*keys, "_b.*")


def best_per_trajectory(records: DataFrame, keys: Sequence[str] = ("prop_id", "f_n", "traj_id"),
                        order: str = "rec_id") -> DataFrame:
    """One record per trajectory - the last written (highest ``order``)
    overwrites earlier ones."""
    keys = list(keys)
    cols = [c for c in records.columns if c not in keys]
    best = records.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(order)).alias("_b"))
    return best.select(*keys, "_b.*")


def feature_frequency(records: DataFrame, keys: Sequence[str] = ("prop_id", "f_n"),
                      indices: str = "indices") -> DataFrame:
    """How often each index is selected, with its rank (count desc, idx)
    inside the key.  A key holds at most one row per feature index."""
    keys = list(keys)
    counts = (records.select(*keys, F.explode(indices).alias("idx"))
              .groupBy(*keys, "idx").agg(F.count(F.lit(1)).alias("count")))
    return rank_within(counts, keys, [F.col("count").desc(), F.col("idx")], out="rank").drop("rank_n")


def selected_set(records: DataFrame, keys: Sequence[str] = ("prop_id", "f_n"),
                 indices: str = "indices") -> DataFrame:
    """A10: sorted distinct union of the selected indices per key (distinct
    first, so the collected list is bounded by the number of features)."""
    keys = list(keys)
    d = records.select(*keys, F.explode(indices).alias("idx")).distinct()
    return d.groupBy(*keys).agg(F.array_sort(F.collect_list("idx")).alias("selected"))


def dominants(records: DataFrame, generation: str = "generation", fitness: str = "fitness",
              key: str = "key", keys: Sequence[str] = ()) -> DataFrame:
    """The best record of each generation: highest fitness, ties to the
    smallest subset key (an aggregate, not a window)."""
    keys = list(keys)
    cols = [c for c in records.columns if c not in [*keys, generation]]
    best = records.groupBy(*keys, generation).agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(-F.col(fitness), F.col(key))).alias("_b"))
    return best.select(*keys, generation, "_b.*")


def fittest(dom: DataFrame, generation: str = "generation", keys: Sequence[str] = ()) -> DataFrame:
    """The dominant of the last recorded generation."""
    keys = list(keys)
    cols = [c for c in dom.columns if c not in keys]
    if keys:
        b = dom.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(generation)).alias("_b"))
        return b.select(*keys, "_b.*")
    b = dom.agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(generation)).alias("_b"))
    return b.select("_b.*")


def elitism(pop: DataFrame, keys: Sequence[str], is_offspring: str = "is_offspring",
            fitness: str = "fitness", order: str = "rec_id", bounded: bool = False) -> DataFrame:
    """L3: parents and offspring together; keep the best (number of parents)
    per population, parents first on equal fitness (stable).  ``bounded``:
    a population is bounded by a parameter, so a plain window suffices."""
    keys = list(keys)
    n_par = pop.groupBy(*keys).agg(F.count_if(~F.col(is_offspring)).alias("_n_par"))
    order_by = [F.col(fitness).desc(), F.col(is_offspring), F.col(order)]
    if bounded:
        from pyspark.sql import Window
        ranked = pop.withColumn("_e_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by)) - 1)
    else:
        ranked = rank_within(pop, keys, order_by, out="_e_rank")
    return (ranked.join(bounded_broadcast(n_par), keys).where(F.col("_e_rank") < F.col("_n_par"))
            .drop("_e_rank", "_e_rank_n", "_n_par"))


def population_review(pop: DataFrame, keys: Sequence[str], fitness: str = "fitness") -> DataFrame:
    """Min, max, mean, population std of fitness."""
    return pop.groupBy(*keys).agg(F.min(fitness).alias("min"), F.max(fitness).alias("max"),
                                  F.avg(fitness).alias("mean"), F.stddev_pop(fitness).alias("std"))


def softmax_probs(pop: DataFrame, keys: Sequence[str], fitness: str = "fitness",
                  negative_sum: str = "fitness", out: str = "prob", bounded: bool = False) -> DataFrame:
    """Selection probability = softmax of fitness / sum(fitness), shifted
    by the max.  When the sum is negative the ratio flips the order, so by
    default the softmax of the fitness itself is used; ``negative_sum=
    'reproduce'`` keeps the ratio.  Two small aggregates joined back."""
    keys = list(keys)
    use_ratio = F.col("_s") > 0 if negative_sum != "reproduce" else F.lit(True)
    if bounded:
        # a population bounded by a parameter: windows instead of joins
        from pyspark.sql import Window
        w = Window.partitionBy(*keys)
        d = pop.withColumn("_s", F.sum(fitness).over(w)).withColumn("_fmax", F.max(fitness).over(w)) \
            .withColumn("_fmin", F.min(fitness).over(w))
        p = F.when(use_ratio, F.col(fitness) / F.col("_s")).otherwise(F.col(fitness))
        pmax = F.when(use_ratio, F.when(F.col("_s") > 0, F.col("_fmax") / F.col("_s"))
                      .otherwise(F.col("_fmin") / F.col("_s"))).otherwise(F.col("_fmax"))
        d = d.withColumn("_e", F.exp(p - pmax))
        return d.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_s", "_fmax", "_fmin", "_e")
    s = pop.groupBy(*keys).agg(F.sum(fitness).alias("_s"), F.max(fitness).alias("_fmax"),
                               F.min(fitness).alias("_fmin"))
    p = F.when(use_ratio, F.col(fitness) / F.col("_s")).otherwise(F.col(fitness))
    pmax = F.when(use_ratio, F.when(F.col("_s") > 0, F.col("_fmax") / F.col("_s"))
                  .otherwise(F.col("_fmin") / F.col("_s"))).otherwise(F.col("_fmax"))
    j = pop.join(bounded_broadcast(s), keys) if keys else pop.join(F.broadcast(s), how="inner")
    j = j.withColumn("_e", F.exp(p - pmax))
    z = j.groupBy(*keys).agg(F.sum("_e").alias("_z"))
    return (j.join(bounded_broadcast(z), keys) if keys else j.join(F.broadcast(z), how="inner")) \
        .withColumn(out, F.col("_e") / F.col("_z")).drop("_s", "_fmax", "_fmin", "_e", "_z")


def pair_sets(pop: DataFrame, pair: str, order: str, indices: str = "indices") -> DataFrame:
    """For each pair of individuals, the common indices and each one's
    own part (a group holds exactly two rows)."""
    two = pop.groupBy(pair).agg(F.min_by(indices, order).alias("a"), F.max_by(indices, order).alias("b"))
    return two.select(pair, F.array_sort(F.array_intersect("a", "b")).alias("common"),
                      F.array_sort(F.array_except("a", "b")).alias("only_a"),
                      F.array_sort(F.array_except("b", "a")).alias("only_b"))


def comparison_table(fold_scores: DataFrame, keys: Sequence[str], fold: str, value: str,
                     n_folds: int) -> DataFrame:
    """U4: folds pivoted to columns fold_1..fold_k (explicit values: no extra
    pass to discover them); a missing fold is null."""
    keys = list(keys)
    return fold_scores.groupBy(*keys).agg(*[
        F.max(F.when(F.col(fold) == k, F.col(value))).alias(f"fold_{k}") for k in range(1, n_folds + 1)])

"""Exact ordinals without a global single-partition window.

``row_number() over (order by k)`` with no ``partitionBy`` moves every row
into one task.  Instead the rows are range-partitioned by ``orderBy`` (which
also splits a hot group across many tasks), each row is tagged with its
partition id and its position inside the partition, the tagged rows are
written to the shared checkpoint folder (so the tags are fixed even if a task
is re-run), and per-partition counts - a table with one row per
(partition, group) - give every partition its starting offset.  This is the
``zipWithIndex`` scheme expressed with DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stoich.session import cut_lineage

_PID = "_o_pid"
_MID = "_o_mid"


def _by_slice(group: list[str]) -> WindowSpec:
    """Slices of a group in order; without a group the table of slices (one
    row per partition) is one group."""
    return Window.partitionBy(*group or [F.col(_PID) * 0]).orderBy(_PID)


def _tag_sorted(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    tagged = (df.orderBy(*order)
              .withColumn(_PID, F.spark_partition_id())
              .withColumn(_MID, F.monotonically_increasing_id()))
    return cut_lineage(tagged)


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
                out: str = "rank") -> DataFrame:
    """0-based position of each row within its group under ``order``
    (``row_number() - 1`` semantics; ties get distinct ranks).  Also adds
    ``<out>_n``: the group size.  ``group`` may be empty (global ordinal)."""
    group = list(group)
    tagged = _tag_sorted(df, [*(F.col(g) for g in group), *order])
    counts = tagged.groupBy(_PID, *group).agg(F.count(F.lit(1)).alias("_o_cnt"),
                                              F.min(_MID).alias("_o_min"))
    w = _by_slice(group)
    counts = counts.select(
        _PID, *group, "_o_min",
        (F.sum("_o_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1))).alias("_o_off"),
        F.sum("_o_cnt").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"{out}_n"))
    counts = counts.fillna(0, subset=["_o_off"])
    if not group:
        # one row per partition: bounded by the partition count
        counts = F.broadcast(counts)
    res = tagged.join(counts, [_PID, *group])
    return res.withColumn(out, (F.col("_o_off") + F.col(_MID) - F.col("_o_min")).cast("bigint")) \
        .drop(_PID, _MID, "_o_min", "_o_off")


def global_rank(df: DataFrame, order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    """0-based global ordinal under ``order``, plus ``<out>_n`` = row count."""
    return rank_within(df, [], order, out)


def running_max(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
                value: str, out: str = "running_max") -> DataFrame:
    """``max(value) over (partition by group order by order rows unbounded
    preceding)`` without putting a whole group in one task.

    Rows are range-sorted (a hot group spans many partitions), each
    (partition, group) slice takes its running max with a window bounded by
    the partition, and the max of all earlier slices of the same group (a
    small table: one row per slice) is folded in with ``greatest``.
    """
    group = list(group)
    tagged = _tag_sorted(df, [*(F.col(g) for g in group), *order])
    slices = tagged.groupBy(_PID, *group).agg(F.max(value).alias("_o_smax"))
    w = _by_slice(group)
    prior = slices.select(_PID, *group, F.max("_o_smax").over(
        w.rowsBetween(Window.unboundedPreceding, -1)).alias("_o_prior"))
    local = Window.partitionBy(_PID, *group).orderBy(_MID).rowsBetween(Window.unboundedPreceding, 0)
    res = tagged.withColumn("_o_local", F.max(value).over(local)).join(prior, [_PID, *group])
    return res.withColumn(out, F.greatest(F.col("_o_local"), F.col("_o_prior"))) \
        .drop(_PID, _MID, "_o_local", "_o_prior")

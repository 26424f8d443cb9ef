"""Group k-fold (G5): a group never spans folds; groups are taken largest
first and each goes to the currently lightest fold (ties: lowest fold
number), as the common library does.

Only the *size histogram* of the groups comes to the driver (one row per
distinct group size - at most sqrt(2n) rows).  Groups of one size s form a
class; placing m equal items greedily on folds with loads L_i follows a
closed pattern: writing L_i = q_i * s + r_i, the picks run level by level,
and at level l the folds with q_i <= l come in (r_i, i) order.  So a class
is described by at most k+1 segments (start rank, first level, active
folds), and the fold of the j-th group of the class (groups ordered by
descending id inside a class) is an expression of j.  The rank j comes from
the distributed rank, the segments are a small broadcast table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stoich.operators.ordering import rank_within
from stoich.operators.sampling import kfold
from stoich.session import bounded_broadcast, cut_lineage


def class_segments(loads: list[int], s: int, m: int) -> tuple[list[tuple], list[int]]:
    """Segments (start_j, level0, active folds) covering the first m greedy
    picks of items of size s, and the loads afterwards."""
    k = len(loads)
    q = [x // s for x in loads]
    r = [x % s for x in loads]
    order = sorted(range(k), key=lambda i: (r[i], i))
    levels = sorted(set(q))
    segs, start, counts = [], 0, [0] * k
    for idx, lv in enumerate(levels):
        active = [i for i in order if q[i] <= lv]
        nxt = levels[idx + 1] if idx + 1 < len(levels) else None
        span = (nxt - lv) * len(active) if nxt is not None else None
        take = m - start if span is None else min(span, m - start)
        if take <= 0:
            break
        segs.append((start, lv, active))
        full, part = divmod(take, len(active))
        for pos, i in enumerate(active):
            counts[i] += full + (1 if pos < part else 0)
        start += take
        if start >= m:
            break
    return segs, [loads[i] + counts[i] * s for i in range(k)]


def group_kfold(df: DataFrame, group: str, k: int, id_col: str, seed="gkf", out: str = "fold") -> DataFrame:
    """folds = max(2, min(k, #groups)); when no group repeats the plain
    shuffled k-fold (G3) is used instead."""
    sizes = cut_lineage(df.groupBy(group).agg(F.count(F.lit(1)).alias("_gs")))
    hist = sizes.groupBy("_gs").agg(F.count(F.lit(1)).alias("_m")).collect()
    n_groups = sum(r["_m"] for r in hist)
    if not hist or max(r["_gs"] for r in hist) <= 1:
        return kfold(df, k, seed, id_col, out=out)
    kk = max(2, min(k, n_groups))
    loads = [0] * kk
    seg_rows = []
    for r in sorted(hist, key=lambda x: -x["_gs"]):
        segs, loads = class_segments(loads, int(r["_gs"]), int(r["_m"]))
        for si, (start, lv, active) in enumerate(segs):
            end = segs[si + 1][0] if si + 1 < len(segs) else int(r["_m"])
            seg_rows.append((int(r["_gs"]), start, end, active))
    seg = df.sparkSession.createDataFrame(seg_rows, T.StructType([
        T.StructField("_gs", T.LongType()), T.StructField("_start", T.LongType()),
        T.StructField("_end", T.LongType()), T.StructField("_active", T.ArrayType(T.IntegerType()))]))
    ranked = rank_within(sizes, ["_gs"], [F.col(group).desc()], out="_j")
    j = ranked.join(bounded_broadcast(seg), "_gs").where(
        (F.col("_j") >= F.col("_start")) & (F.col("_j") < F.col("_end")))
    off = F.col("_j") - F.col("_start")
    folds = j.select(group, F.element_at("_active", (F.pmod(off, F.size("_active")) + 1).cast("int")).cast("bigint").alias(out))
    return df.join(folds, group)

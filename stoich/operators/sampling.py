"""Exact, repeatable sampling, splits and folds driven by hash randomness.

The shuffle order of a row is its hash uniform ``u(seed, id)`` (ties broken by
id).  A split or fold needs no ranks, only the rows at a few ranks: the cut
points.  :func:`hash_cuts` finds them from the ids alone - a histogram of u (a
partial aggregate), then the order inside the few histogram steps that hold a
wanted rank - and :func:`tag_by_cuts` compares every row with them.  The rows
themselves, however wide, are neither shuffled nor sorted, no task sees all
rows, and the result does not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoich.functions.rng import uniform
from stoich.operators.ordering import rank_within
from stoich.session import bounded_broadcast

STEPS = 1 << 13


def hash_cuts(df: DataFrame, u: Column, id_col: str | Sequence[str], ranks: Callable[[Column], list[Column]],
              group: Sequence[str] = ()) -> DataFrame:
    """One row per group: its size ``_n`` and ``_cuts``, for each rank r of
    ``ranks(_n)`` the key (u, ids) of the row at the 0-based rank r in hash
    order; null where the group has no such row.

    ``id_col`` (one or several columns) must be unique within a group.  Per
    group at most STEPS histogram rows are windowed; a step holds a
    STEPS-th of the group, and only steps with a wanted rank are sorted."""
    group, ids = list(group), _ids(id_col)
    keys = df.select(*group, F.lit(0).alias("_all"), u.alias("_u"), *[c for c in ids if c not in group])
    keys = keys.withColumn("_step", F.least(F.floor(F.col("_u") * STEPS), F.lit(STEPS - 1)))
    g = group or ["_all"]
    hist = keys.groupBy(*g, "_step").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*g)
    hist = hist.select(*g, "_step", "_c", F.sum("_c").over(w).alias("_n"), (
        F.sum("_c").over(w.orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_from"))
    r = F.array(*[x.cast("bigint") for x in ranks(F.col("_n"))])
    inside = F.filter(F.transform(r, lambda x, j: F.struct(j.alias("j"), (x - F.col("_from")).alias("at"))),
                      lambda x: (x["at"] >= 0) & (x["at"] < F.col("_c")))
    hist = hist.select(*g, "_step", "_n", inside.alias("_want"))
    wanted = bounded_broadcast(hist.where((F.size("_want") > 0) | (F.col("_step") >= 0)).groupBy(*g).agg(
        F.first("_n").alias("_n"), F.collect_list(F.when(F.size("_want") > 0, F.struct("_step", "_want"))).alias("_w")))
    steps = wanted.select(*g, F.explode("_w").alias("_x")).select(*g, F.col("_x._step").alias("_step"),
                                                                 F.col("_x._want").alias("_want"))
    inner = Window.partitionBy(*g, "_step").orderBy("_u", *ids)
    found = (keys.join(F.broadcast(steps), [*g, "_step"])
             .withColumn("_at", F.row_number().over(inner) - 1)
             .select(*g, "_u", *[c for c in ids if c not in g], F.explode("_want").alias("_x"), "_at")
             .where(F.col("_at") == F.col("_x.at"))
             .groupBy(*g).agg(F.collect_list(F.struct(F.col("_x.j").alias("j"), F.struct("_u", *ids).alias("key")))
                              .alias("_found")))
    n_cuts = len(ranks(F.lit(1)))
    cuts = F.transform(F.sequence(F.lit(0), F.lit(n_cuts - 1)), lambda j: F.get(
        F.filter("_found", lambda x: x["j"] == j), F.lit(0))["key"])
    return wanted.join(found, g, "left").select(*group, "_n", cuts.alias("_cuts"))


def tag_by_cuts(df: DataFrame, u: Column, id_col: str | Sequence[str], cuts: DataFrame, value: Callable,
                out: str, group: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``out = value(passed)``, where ``passed(j)`` says whether a
    row's rank reaches the j-th wanted rank (false where no row has it)."""
    group = list(group)
    key = F.struct(u.alias("_u"), *[F.col(c) for c in _ids(id_col)])
    if group:
        cuts = bounded_broadcast(cuts.drop("_n"))
        joined = df.join(cuts, group)
    else:                               # one row: its few keys become literals
        joined = df.join(F.broadcast(cuts.select("_cuts")))
    passed = lambda j: F.coalesce(key >= F.get("_cuts", F.lit(j)), F.lit(False))
    return joined.withColumn(out, value(passed)).drop("_cuts")


def _ids(id_col):
    return [id_col] if isinstance(id_col, str) else list(id_col)


def _u_of(seed, id_col):
    return uniform(seed, *[F.col(c) for c in _ids(id_col)])


def exact_sample(df: DataFrame, n: int, seed, id_col: str | Sequence[str]) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement: the first n in
    hash order (a top-n per task, merged)."""
    return df.withColumn("_u", _u_of(seed, id_col)).orderBy("_u", *_ids(id_col)).limit(n).drop("_u")


def train_eval_split(df: DataFrame, seed, id_col: str | Sequence[str], eval_ratio: float = 0.10,
                     out: str = "split") -> DataFrame:
    """G1: exactly round_half_even(n * eval_ratio) rows tagged 'eval', the
    rest 'train'; row order (the id) is kept."""
    u = _u_of(seed, id_col)
    cuts = hash_cuts(df, u, id_col, lambda n: [F.bround(n * F.lit(eval_ratio), 0)])
    return tag_by_cuts(df, u, id_col, cuts, lambda passed: F.when(passed(0), F.lit("train")).otherwise(F.lit("eval")),
                       out)


def three_way_split(df: DataFrame, seed, id_col: str, ratios=(0.8, 0.1, 0.1),
                    out: str = "split") -> DataFrame:
    """Train / val_1 / val_2 with the two-stage exact counts: first
    ceil(n * (r2 + r3) / sum) held out, of which ceil(held * r3 / (r2 + r3))
    are val_2 (the library's test-size rounding), from one hash order."""
    tot = float(sum(ratios))
    f1 = (ratios[1] + ratios[2]) / tot
    f2 = ratios[2] / (ratios[1] + ratios[2])
    u = _u_of(seed, id_col)
    held = lambda n: F.ceil(n * F.lit(f1))
    cuts = hash_cuts(df, u, id_col, lambda n: [F.ceil(held(n) * F.lit(f2)), held(n)])
    return tag_by_cuts(df, u, id_col, cuts, lambda passed: F.when(passed(1), F.lit("train"))
                       .when(passed(0), F.lit("val_1")).otherwise(F.lit("val_2")), out)


def fold_starts(n: Column, k: int) -> list[Column]:
    """First rank of folds 1..k-1 in a shuffled order of n rows: the first
    n % k folds are one row larger."""
    q = F.floor(n / F.lit(k))
    return [F.lit(f) * q + F.least(F.lit(f), n - q * F.lit(k)) for f in range(1, k)]


def kfold(df: DataFrame, k: int, seed, id_col: str, group: Sequence[str] = (),
          out: str = "fold") -> DataFrame:
    """Shuffled k folds of sizes n//k (+1 for the first n % k)."""
    u = uniform(seed, *[F.col(g) for g in group], F.col(id_col))
    cuts = hash_cuts(df, u, id_col, lambda n: fold_starts(n, k), group)

    def fold(passed):
        value = F.lit(0).cast("bigint")
        for f in range(1, k):
            value = value + passed(f - 1).cast("bigint")
        return value

    return tag_by_cuts(df, u, id_col, cuts, fold, out, group)


def repeated_kfold(df: DataFrame, k: int, seeds: Sequence[int], id_col: str,
                   out: str = "fold") -> DataFrame:
    """Every row once per seed (explode of a literal seed array - a
    per-row expansion, not a join), folds drawn independently per seed."""
    d = df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    return kfold(d, k, "cv", id_col, group=["seed"], out=out)


# -- populations (index subsets) --------------------------------------------

def hash_shuffle(arr: Column, seed, *key) -> Column:
    """Array ordered by md5(seed|key|element): a repeatable shuffle."""
    return F.transform(
        F.array_sort(F.transform(arr, lambda x: F.struct(
            F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key], x.cast("string"))).alias("h"),
            x.alias("x")))),
        lambda s: s["x"])


def random_subset(key: Column, total: int, f_n: Column, seed="7") -> Column:
    """f_n distinct indices of 0..total-1 in draw order: a partial
    Fisher-Yates draw.  Step j draws r = floor(u(seed, key, j) * (total - j))
    and takes the r-th index not drawn yet (in ascending order):
    v = r + #{m : p_(m) - m <= r} over the drawn indices sorted ascending
    (0-based m) - f_n hashes and arrays of at most f_n per row."""
    def step(acc, j):
        r = F.floor(uniform(seed, key, j) * (F.lit(total) - j)).cast("bigint")
        skips = F.size(F.filter(F.transform(F.array_sort(acc), lambda p, m: p - m), lambda x: x <= r))
        return F.concat(acc, F.array(r + skips))

    steps = F.sequence(F.lit(0), F.greatest(f_n.cast("int") - 1, F.lit(-1)), F.lit(1))
    return F.aggregate(F.when(f_n > 0, steps).otherwise(F.array().cast("array<int>")),
                       F.array().cast("array<bigint>"), step)


def sql_random_subset(key: str, total: int, f_n: str, seed="7") -> str:
    """DuckDB spelling of :func:`random_subset`."""
    from stoich.functions.rng import sql_uniform
    u = sql_uniform(seed, key, "acc.j")
    r = f"CAST(floor({u} * ({total} - acc.j)) AS BIGINT)"
    skips = f"len(list_filter(list_transform(list_sort(acc.picked), lambda p, m: p - (m - 1)), lambda x: x <= {r}))"
    return (f"(list_reduce(list_transform(range(({f_n}) + 1), lambda k: {{"
            f"'picked': CAST([] AS BIGINT[]), 'j': CAST(0 AS BIGINT)}}), lambda acc, z: {{"
            f"'picked': list_append(acc.picked, {r} + {skips}), 'j': acc.j + 1}})).picked")


def init_population(ids: DataFrame, id_col: str, total: int, f_n: Column | int, seed="7",
                    out: str = "indices") -> DataFrame:
    """A random distinct index subset of size f_n per row."""
    f = f_n if isinstance(f_n, Column) else F.lit(f_n)
    return ids.withColumn(out, random_subset(F.col(id_col), total, f, seed))


def mutate(indices: Column, key: Column, prob: float, total: int, seed="mut") -> Column:
    """Each position with probability ``prob`` gets an index not in the
    individual, no repeats: the replacements are the first m of a shuffled
    array of unused indices."""
    n = F.size(indices)
    mpos = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                    lambda i: (uniform(seed, key, i) < F.lit(prob)) & (i <= n))
    unused = F.array_except(F.sequence(F.lit(0), F.lit(total - 1)).cast("array<bigint>"), indices)
    pool = hash_shuffle(unused, f"{seed}-pool", key)
    return F.transform(indices, lambda v, i: F.when(
        F.array_contains(mpos, i + 1), F.element_at(pool, F.array_position(mpos, i + 1).cast("int"))).otherwise(v))


def cross_over(a: Column, b: Column, key: Column, prob: float, seed="cx",
               reproduce_index_quirk: bool = False) -> tuple[Column, Column]:
    """The common indices are kept; each individual's own indices are
    shuffled and swapped position by position with probability ``prob``.
    ``reproduce_index_quirk`` limits swaps to positions t with
    len(common) + t < len(own) (the swap loop indexes the combined list)."""
    common = F.array_sort(F.array_intersect(a, b))
    oa = hash_shuffle(F.array_except(a, b), f"{seed}-a", key)
    ob = hash_shuffle(F.array_except(b, a), f"{seed}-b", key)
    def swap(t):
        s = uniform(seed, key, t) < F.lit(prob)
        return (s & (F.size(common) + t < F.size(oa))) if reproduce_index_quirk else s

    na = F.transform(oa, lambda x, t: F.when(swap(t) & (t < F.size(ob)), F.element_at(ob, t + 1)).otherwise(x))
    nb = F.transform(ob, lambda x, t: F.when(swap(t) & (t < F.size(oa)), F.element_at(oa, t + 1)).otherwise(x))
    return F.concat(common, na), F.concat(common, nb)


def roulette_select(pop: DataFrame, prob: str, k: int, keys: Sequence[str], id_col: str,
                    seed="sel", bounded: bool = False) -> DataFrame:
    """K individuals per population without replacement with
    probability proportional to ``prob`` (weighted sampling keys
    -ln(u) / p, smallest k; Efraimidis & Spirakis 2006).  ``_sel_rank`` is
    the selection order.  ``bounded=True`` states that a population is
    bounded by a parameter (e.g. the search's n_pop), so a plain window per
    population is used instead of the distributed rank."""
    kcol = -F.log(uniform(seed, *[F.col(c) for c in keys], F.col(id_col)) + F.lit(1e-300)) / F.col(prob)
    d = pop.withColumn("_sel_key", kcol)
    if bounded:
        w = Window.partitionBy(*keys).orderBy("_sel_key", id_col)
        return d.withColumn("_sel_rank", (F.row_number().over(w) - 1).cast("bigint")) \
            .where(F.col("_sel_rank") < k).drop("_sel_key")
    return rank_within(d, keys, [F.col("_sel_key"), F.col(id_col)], out="_sel_rank") \
        .where(F.col("_sel_rank") < k).drop("_sel_key", "_sel_rank_n")

"""Sampling, splits, folds, populations, scaling and known-set queries:
W3, G1-G4, G10, G11, X23, X24, N1, N2, J4-J6."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoich.functions.rng import sql_uniform, uniform
from stoich.operators import composition as C
from stoich.operators import results as R
from stoich.operators import sampling as S
from stoich.operators import scaling as N
from stoich.plans.catalog import query, with_ctes
from stoich.plans.q_composition import LABELS_11, SHARES_SQL, nine, nine_of, weighted_matrix
from stoich.plans.q_results import REC_SQL, WF_SQL, _records, _wf_rounded
from stoich.sources import fixtures as FX
from stoich.sources.tables import table

SEEDS = [0, 1, 2, 3, 4, 5, 6, 7]


def _r6(c):
    return F.round(c, 6) + F.lit(0.0)


@query("w3_exact_sample", f"""
SELECT o_orderkey FROM orders ORDER BY {sql_uniform('w3', 'o_orderkey')}, o_orderkey LIMIT 1000""")
def w3_exact_sample(spark, sf_dir):
    """Exactly 1000 orders without replacement (sampling is the feature)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return S.exact_sample(o, 1000, "w3", "o_orderkey")


@query("g1_train_eval_split", with_ctes(FX.C5_SQL) + f""",
r AS (SELECT doc_id, line_no,
        row_number() OVER (ORDER BY {sql_uniform('split', 'doc_id', 'line_no')}, doc_id, line_no) - 1 AS rk,
        count(*) OVER () AS n FROM lines)
SELECT doc_id, line_no, CASE WHEN rk < round_even(n * 0.1, 0) THEN 'eval' ELSE 'train' END AS split FROM r""")
def g1_train_eval_split(spark, sf_dir):
    """G1 on corpus lines: exactly round_half_even(n / 10) eval lines."""
    lines = FX.corpus_lines(spark, sf_dir).select("doc_id", "line_no")
    return S.train_eval_split(lines, "split", ["doc_id", "line_no"])


@query("g2_three_way_split", with_ctes(FX.C4_SQL) + f""",
r AS (SELECT sample_id, row_number() OVER (ORDER BY {sql_uniform('g2', 'sample_id')}, sample_id) - 1 AS rk,
        count(*) OVER () AS n FROM targets)
SELECT sample_id, CASE WHEN rk < ceil(ceil(n * 0.2) * 0.5) THEN 'val_2'
                       WHEN rk < ceil(n * 0.2) THEN 'val_1' ELSE 'train' END AS split FROM r""")
def g2_three_way_split(spark, sf_dir):
    t = FX.targets(spark, sf_dir).select("sample_id")
    return S.three_way_split(t, "g2", "sample_id")


def _fold_sql(rk, n, k):
    q = f"floor({n} / {k})"
    rem = f"({n} - {q} * {k})"
    big = f"({rem} * ({q} + 1))"
    return (f"CAST(CASE WHEN {rk} < {big} THEN floor({rk} / ({q} + 1)) "
            f"ELSE {rem} + floor(({rk} - {big}) / greatest({q}, 1)) END AS BIGINT)")


@query("g3_kfold", with_ctes(FX.C4_SQL) + f""",
r AS (SELECT sample_id, row_number() OVER (ORDER BY {sql_uniform('kf', 'sample_id')}, sample_id) - 1 AS rk,
        count(*) OVER () AS n FROM targets)
SELECT sample_id, {_fold_sql('rk', 'n', 10)} AS fold FROM r""")
def g3_kfold(spark, sf_dir):
    """10 shuffled folds, the first n % 10 one row larger."""
    t = FX.targets(spark, sf_dir).select("sample_id")
    return S.kfold(t, 10, "kf", "sample_id")


@query("g4_repeated_kfold", with_ctes(FX.C4_SQL) + f""",
x AS (SELECT unnest({SEEDS}) AS seed, sample_id FROM targets),
r AS (SELECT seed, sample_id,
        row_number() OVER (PARTITION BY seed ORDER BY {sql_uniform('cv', 'seed', 'sample_id')}, sample_id) - 1 AS rk,
        count(*) OVER (PARTITION BY seed) AS n FROM x)
SELECT CAST(seed AS INTEGER) AS seed, sample_id, {_fold_sql('rk', 'n', 10)} AS fold FROM r""")
def g4_repeated_kfold(spark, sf_dir):
    """Rows x 8 seeds, 10 folds per seed."""
    t = FX.targets(spark, sf_dir).select("sample_id")
    return S.repeated_kfold(t, 10, SEEDS, "sample_id").select("seed", "sample_id", "fold")


@query("g10_init_population", with_ctes(FX.c8_sql(True)) + """
SELECT rec_id, array_to_string(indices, ',') AS indices FROM records""")
def g10_init_population(spark, sf_dir):
    """A random distinct subset of f_n of the 64 indices per record."""
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("rec_id"))
    p = S.init_population(ev, "rec_id", FX.N_FEATURES, F.lit(1) + F.col("rec_id") % 8)
    return p.select("rec_id", F.array_join("indices", ",").alias("indices"))


def _mutate_sql(prob=0.1, total=64):
    u_pos = sql_uniform("mut", "rec_id", "i")
    pool = (f"list_transform(list_sort(list_transform(list_filter(range({total}), lambda x: NOT list_contains(indices, x)), "
            f"lambda x: {{'h': md5(concat_ws('|', 'mut-pool', CAST(rec_id AS VARCHAR), CAST(x AS VARCHAR))), 'x': x}})), "
            f"lambda s: s.x)")
    return with_ctes(REC_SQL) + f""",
m AS (SELECT rec_id, indices, list_filter(range(1, len(indices) + 1), lambda i: {u_pos} < {prob}) AS mpos,
        {pool} AS pool FROM recs)
SELECT rec_id, array_to_string(list_transform(indices, lambda v, i:
         CASE WHEN list_contains(mpos, i) THEN pool[list_position(mpos, i)] ELSE v END), ',') AS mutated
FROM m"""


@query("x23_mutate", _mutate_sql())
def x23_mutate(spark, sf_dir):
    """Per-position mutation with probability 0.1 into unused indices."""
    r = _records(spark, sf_dir)
    return r.select("rec_id", F.array_join(S.mutate(F.col("indices"), F.col("rec_id"), 0.1, FX.N_FEATURES),
                                           ",").alias("mutated"))


def _cx_sql(prob=0.8):
    def shuf(arr, tag):
        return (f"list_transform(list_sort(list_transform({arr}, lambda x: {{'h': md5(concat_ws('|', '{tag}', "
                f"CAST(pair AS VARCHAR), CAST(x AS VARCHAR))), 'x': x}})), lambda s: s.x)")
    swap = f"{sql_uniform('cx', 'pair', 'i - 1')} < {prob}"
    return with_ctes(REC_SQL) + f""",
p AS (SELECT (rec_id // 16) * 8 + rec_id % 8 AS pair, arg_min(indices, rec_id) AS a, arg_max(indices, rec_id) AS b
      FROM recs GROUP BY 1),
q AS (SELECT pair, list_intersect(a, b) AS common,
        {shuf('list_filter(a, lambda x: NOT list_contains(b, x))', 'cx-a')} AS oa,
        {shuf('list_filter(b, lambda x: NOT list_contains(a, x))', 'cx-b')} AS ob FROM p)
SELECT pair,
  array_to_string(list_sort(list_concat(common, list_transform(oa, lambda x, i: CASE WHEN {swap} THEN ob[i] ELSE x END))), '*') AS child_a,
  array_to_string(list_sort(list_concat(common, list_transform(ob, lambda x, i: CASE WHEN {swap} THEN oa[i] ELSE x END))), '*') AS child_b
FROM q"""


@query("x24_cross_over", _cx_sql())
def x24_cross_over(spark, sf_dir):
    """Records e and e + 8 (same subset size) paired; children as
    subset keys."""
    r = _records(spark, sf_dir).withColumn(
        "pair", (F.floor(F.col("rec_id") / 16) * 8 + F.col("rec_id") % 8).cast("bigint"))
    two = r.groupBy("pair").agg(F.min_by("indices", "rec_id").alias("a"), F.max_by("indices", "rec_id").alias("b"))
    ca, cb = S.cross_over(F.col("a"), F.col("b"), F.col("pair"), 0.8)
    return two.select("pair", R.subset_key(ca).alias("child_a"), R.subset_key(cb).alias("child_b"))


@query("g11_roulette_select", with_ctes(REC_SQL) + f""",
p AS (SELECT prop_id, f_n, rec_id, fitness - 0.5 AS fit FROM recs),
s AS (SELECT prop_id, f_n, sum(fit) AS s, max(fit) AS fmax, min(fit) AS fmin FROM p GROUP BY 1, 2),
e AS (SELECT p.prop_id, p.f_n, rec_id,
        exp(CASE WHEN s > 0 THEN fit / s ELSE fit END - CASE WHEN s > 0 THEN fmax / s ELSE fmax END) AS e
      FROM p JOIN s ON p.prop_id = s.prop_id AND p.f_n = s.f_n),
pr AS (SELECT prop_id, f_n, rec_id, e / sum(e) OVER (PARTITION BY prop_id, f_n) AS prob FROM e),
k AS (SELECT *, -ln({sql_uniform('sel', 'prop_id', 'f_n', 'rec_id')} + 1e-300) / prob AS key FROM pr),
r AS (SELECT *, row_number() OVER (PARTITION BY prop_id, f_n ORDER BY key, rec_id) AS rn FROM k)
SELECT prop_id, f_n, rec_id FROM r WHERE rn <= 8""")
def g11_roulette_select(spark, sf_dir):
    """8 individuals per population, probability = X12 softmax."""
    p = _records(spark, sf_dir).select("prop_id", "f_n", "rec_id", (F.col("fitness") - 0.5).alias("fitness"))
    pr = R.softmax_probs(p, ["prop_id", "f_n"])
    return S.roulette_select(pr, "prob", 8, ["prop_id", "f_n"], "rec_id").select("prop_id", "f_n", "rec_id")


@query("n1_robust_scale", WF_SQL + """,
q AS (SELECT feature_id, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS med,
        quantile_cont(value, 0.75) AS q75 FROM wf GROUP BY 1)
SELECT wf.sample_id, wf.feature_id,
       round((wf.value - q.med) / CASE WHEN q.q75 - q.q25 = 0 THEN 1.0 ELSE q.q75 - q.q25 END, 6) + 0.0 AS scaled
FROM wf JOIN q ON wf.feature_id = q.feature_id""")
def n1_robust_scale(spark, sf_dir):
    """Exact-quantile robust scaling of the weighted features."""
    weighted = weighted_matrix(spark, sf_dir)
    if weighted is None or not weighted.dense:
        return _scaled(N.robust_scale(_wf_rounded(spark, sf_dir)))
    weighted = weighted.written()
    ids = weighted.columns["feature_id"].tolist()
    middle, width = N.robust_fit_arrays(weighted.arrays(finish=nine_of), "sample_id", "features", len(ids))
    fit = spark.createDataFrame([(int(i), m, w) for i, m, w in zip(ids, middle, width)],
                                "feature_id long, median double, scale double")
    wf = weighted.long().select("sample_id", "feature_id", nine(F.col("value")).alias("value"))
    return _scaled(N.robust_scale(wf, fit=fit))


def _scaled(rows):
    return rows.select("sample_id", "feature_id", _r6(F.col("scaled")).alias("scaled"))


@query("n2_standard_scale", WF_SQL + """,
q AS (SELECT feature_id, avg(value) AS m, stddev_pop(value) AS s FROM wf GROUP BY 1)
SELECT wf.sample_id, wf.feature_id,
       round((wf.value - q.m) / CASE WHEN q.s = 0 THEN 1.0 ELSE q.s END, 6) + 0.0 AS scaled
FROM wf JOIN q ON wf.feature_id = q.feature_id""")
def n2_standard_scale(spark, sf_dir):
    wf = _wf_rounded(spark, sf_dir)
    return N.standard_scale(wf).select("sample_id", "feature_id", _r6(F.col("scaled")).alias("scaled"))


def _keys_sql():
    vals = ", ".join(f"printf('%.4f', round_even(coalesce(sum(CASE WHEN element = '{lab}' THEN share END), 0.0), 4) + 0.0)"
                     for lab in LABELS_11)
    return with_ctes(FX.C1_SQL, SHARES_SQL) + f""",
k AS (SELECT sample_id, concat_ws('*', {vals}) AS comp_key FROM shares GROUP BY sample_id),
st AS (SELECT k.*, o.o_orderstatus AS status FROM k JOIN orders o ON k.sample_id = o.o_orderkey)
"""


def _keys(spark, sf_dir):
    wide = C.select_labels(C.normalise_rows(FX.composition(spark, sf_dir)), LABELS_11, value="share")
    arr = F.array(*[F.col(C.safe_name(lab)) for lab in LABELS_11])
    k = wide.select("sample_id", C.composition_key(arr).alias("comp_key"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("status"))
    return k.join(o, "sample_id")


def exclude_known(cands, known, key="comp_key"):
    """Candidates whose rounded key was not tried yet (anti join)."""
    return cands.join(known.select(key).distinct(), key, "left_anti")


def register_known(history, new, key="comp_key"):
    """Append new rows; a key already in the history is an error
    (checked with a semi join, nothing collected but one count)."""
    dup = new.join(history.select(key), key, "left_semi").limit(1).count()
    if dup:
        raise ValueError("register_known: key already registered")
    return history.unionByName(new)


@query("j4_exclude_known", _keys_sql() + """
SELECT DISTINCT comp_key FROM st WHERE status <> 'F'
  AND comp_key NOT IN (SELECT comp_key FROM st WHERE status = 'F')""")
def j4_exclude_known(spark, sf_dir):
    """Candidate keys (open orders) not among the tried ones (filled)."""
    k = _keys(spark, sf_dir)
    cands = k.where(F.col("status") != "F").select("comp_key").distinct()
    return exclude_known(cands, k.where(F.col("status") == "F"))


@query("j5_register_known", _keys_sql() + """,
h AS (SELECT DISTINCT comp_key FROM st WHERE status = 'F'),
n AS (SELECT DISTINCT comp_key FROM st WHERE status <> 'F' AND comp_key NOT IN (SELECT comp_key FROM h))
SELECT comp_key, 'history' AS source FROM h UNION ALL SELECT comp_key, 'new' FROM n""")
def j5_register_known(spark, sf_dir):
    k = _keys(spark, sf_dir)
    hist = k.where(F.col("status") == "F").select("comp_key").distinct().withColumn("source", F.lit("history"))
    new = exclude_known(k.where(F.col("status") != "F").select("comp_key").distinct(), hist) \
        .withColumn("source", F.lit("new"))
    return register_known(hist, new)


def fitness_memo(pop, memo, evaluate, key="key"):
    """Evaluate each distinct key not in the memo once; look the rest up.
    ``evaluate`` maps a DataFrame of keys to (key, fitness)."""
    keys = pop.select(key).distinct()
    todo = keys.join(memo.select(key), key, "left_anti")
    fresh = evaluate(todo).withColumn("memo_hit", F.lit(False))
    table_ = memo.select(key, "fitness").withColumn("memo_hit", F.lit(True)).unionByName(fresh)
    return pop.join(table_, key)


@query("j6_fitness_memo", with_ctes(REC_SQL) + f""",
memo AS (SELECT key, arg_min(fitness, rec_id) AS fitness FROM recs WHERE traj_id < 24 GROUP BY key),
pop AS (SELECT rec_id, key FROM recs WHERE traj_id >= 24)
SELECT pop.rec_id, pop.key, coalesce(memo.fitness, {sql_uniform('eval', 'pop.key')}) AS fitness,
       memo.key IS NOT NULL AS memo_hit
FROM pop LEFT JOIN memo ON pop.key = memo.key""")
def j6_fitness_memo(spark, sf_dir):
    """A population (trajectories >= 24) scored against the memo of the
    earlier trajectories; new keys evaluated once each."""
    r = _records(spark, sf_dir)
    memo = r.where(F.col("traj_id") < 24).groupBy("key").agg(F.min_by("fitness", "rec_id").alias("fitness"))
    pop = r.where(F.col("traj_id") >= 24).select("rec_id", "key")

    def evaluate(keys):
        return keys.withColumn("fitness", uniform("eval", F.col("key")))
    return fitness_memo(pop, memo, evaluate).select("rec_id", "key", "fitness", "memo_hit")




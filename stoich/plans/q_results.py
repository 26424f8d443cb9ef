"""Result analytics queries: A6-A18, A20, W1, W2, L1, L3, L5, U3, U4, J3,
F9, X8, X9, X12, X15, X16, X22, K4."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoich.operators import composition as C
from stoich.operators import metrics as M
from stoich.operators import results as R
from stoich.operators.ordering import global_rank, running_max
from stoich.plans.catalog import query, with_ctes
from stoich.plans.q_composition import NINE, SHARES_SQL
from stoich.session import bounded_broadcast
from stoich.sources import fixtures as FX
from stoich.sources.tables import table

# The order-priority classes in sorted order (label encoding
# target of A14's stand-in predictions).
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _r6(c):
    return F.round(c, 6) + F.lit(0.0)


def _scores(spark, sf_dir):
    return FX.experiment_scores(spark, sf_dir)


@query("a6_result_summary", with_ctes(FX.C6_SQL) + """
SELECT f_n, kind, model, count(score) AS n, round(stddev_pop(score), 6) + 0.0 AS std,
       round(quantile_cont(score, 0.5), 6) + 0.0 AS median
FROM scores GROUP BY f_n, kind, model""")
def a6_result_summary(spark, sf_dir):
    s = R.result_summary(_scores(spark, sf_dir))
    return s.select("f_n", "kind", "model", "n", _r6(F.col("std")).alias("std"),
                    _r6(F.col("median")).alias("median"))


@query("k4_tsv_report", with_ctes(FX.C6_SQL) + """,
s AS (SELECT f_n, kind, model, stddev_pop(score) AS std, quantile_cont(score, 0.5) AS median
      FROM scores GROUP BY f_n, kind, model)
SELECT kind, model, f_n,
       printf('%d\t%.4f\t%.4f', f_n, round_even(median, 4) + 0.0, round_even(std, 4) + 0.0) AS line
FROM s""")
def k4_tsv_report(spark, sf_dir):
    s = R.result_summary(_scores(spark, sf_dir))
    return R.tsv_lines(s, extra=["kind", "model"])


@query("a8_file_means", with_ctes(FX.C6_SQL) + """
SELECT prop_id, f_n, traj_id, kind, round(avg(score), 6) + 0.0 AS mean_score
FROM scores GROUP BY prop_id, f_n, traj_id, kind""")
def a8_file_means(spark, sf_dir):
    fm = R.file_means(_scores(spark, sf_dir))
    return fm.select("prop_id", "f_n", "traj_id", "kind", _r6(F.col("mean_score")).alias("mean_score"))


@query("a7_trajectory_summary", with_ctes(FX.C6_SQL) + """,
fm AS (SELECT prop_id, f_n, traj_id, kind, avg(score) AS m FROM scores GROUP BY 1, 2, 3, 4)
SELECT f_n, kind, count(*) AS n_files, round(avg(m), 6) + 0.0 AS mean, round(stddev_pop(m), 6) + 0.0 AS std
FROM fm GROUP BY f_n, kind""")
def a7_trajectory_summary(spark, sf_dir):
    t = R.trajectory_summary(_scores(spark, sf_dir))
    return t.select("f_n", "kind", "n_files", _r6(F.col("mean")).alias("mean"), _r6(F.col("std")).alias("std"))


@query("l5_numeric_sort", with_ctes(FX.C6_SQL) + """,
d AS (SELECT DISTINCT CAST(traj_id AS VARCHAR) AS traj FROM scores)
SELECT traj, row_number() OVER (ORDER BY CAST(traj AS BIGINT)) - 1 AS pos FROM d""")
def l5_numeric_sort(spark, sf_dir):
    """Numeric (not lexicographic) order of number-valued keys."""
    d = _scores(spark, sf_dir).select(F.col("traj_id").cast("string").alias("traj")).distinct()
    return global_rank(d, [F.col("traj").cast("bigint")], out="pos").select("traj", "pos")


@query("u4_comparison_table", with_ctes(FX.C6_SQL) + """,
fs AS (SELECT model, kind, seed % 5 + 1 AS fold, avg(score) AS v FROM scores
       WHERE NOT (model = 'ridge' AND seed % 5 = 4) GROUP BY 1, 2, 3)
SELECT model, kind,
  round(max(CASE WHEN fold = 1 THEN v END), 6) + 0.0 AS fold_1,
  round(max(CASE WHEN fold = 2 THEN v END), 6) + 0.0 AS fold_2,
  round(max(CASE WHEN fold = 3 THEN v END), 6) + 0.0 AS fold_3,
  round(max(CASE WHEN fold = 4 THEN v END), 6) + 0.0 AS fold_4,
  round(max(CASE WHEN fold = 5 THEN v END), 6) + 0.0 AS fold_5
FROM fs GROUP BY model, kind""")
def u4_comparison_table(spark, sf_dir):
    """U4: per-model fold means pivoted to fold_1..fold_5; the 'ridge' model
    has no fifth fold, which stays null (the padding case)."""
    s = _scores(spark, sf_dir)
    s = s.where(~((F.col("model") == "ridge") & (F.col("seed") % 5 == 4)))
    fs = s.groupBy("model", "kind", (F.col("seed") % 5 + 1).alias("fold")).agg(F.avg("score").alias("v"))
    t = R.comparison_table(fs, ["model", "kind"], "fold", "v", 5)
    return t.select("model", "kind", *[_r6(F.col(f"fold_{k}")).alias(f"fold_{k}") for k in range(1, 6)])


@query("x9_file_keys", with_ctes(FX.C6_SQL) + """,
p AS (SELECT exp_id,
        'results/' || prop_id || '-' || f_n || '-' || traj_id || '-' || exp_id || '.pkl' AS res_path,
        'feature_selection/fs-' || prop_id || '-' || f_n || '-' || traj_id || '-' || exp_id || '.pkl' AS fs_path
      FROM scores)
SELECT exp_id, res_path, CAST(split_part(res_path, '-', 2) AS BIGINT) AS f_n,
       CAST(split_part(fs_path, '-', 4) AS BIGINT) AS traj_id FROM p""")
def x9_file_keys(spark, sf_dir):
    """Keys parsed from result file names (token 1 and token 3 of '-')."""
    s = _scores(spark, sf_dir)
    parts = [F.col(c).cast("string") for c in ("prop_id", "f_n", "traj_id", "exp_id")]
    res = F.concat(F.lit("results/"), F.concat_ws("-", *parts), F.lit(".pkl"))
    fs = F.concat(F.lit("feature_selection/fs-"), F.concat_ws("-", *parts), F.lit(".pkl"))
    p = s.select("exp_id", res.alias("res_path"), fs.alias("fs_path"))
    return p.select("exp_id", "res_path",
                    F.split_part("res_path", F.lit("-"), F.lit(2)).cast("bigint").alias("f_n"),
                    F.split_part("fs_path", F.lit("-"), F.lit(4)).cast("bigint").alias("traj_id"))


def _records(spark, sf_dir):
    r = FX.selection_records(spark, sf_dir)
    return r.withColumn("key", R.subset_key(F.col("indices")))


REC_SQL = FX.c8_sql(True) + """,
recs AS (SELECT *, array_to_string(list_sort(indices), '*') AS key FROM records)"""


@query("x8_subset_key", with_ctes(REC_SQL) + "SELECT rec_id, key FROM recs")
def x8_subset_key(spark, sf_dir):
    return _records(spark, sf_dir).select("rec_id", "key")


@query("a11_best_overall", with_ctes(REC_SQL) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY prop_id, f_n ORDER BY fitness DESC, rec_id) AS rn
      FROM recs WHERE fitness IS NOT NULL)
SELECT prop_id, f_n, rec_id, traj_id, fitness, key FROM r WHERE rn = 1""")
def a11_best_overall(spark, sf_dir):
    r = _records(spark, sf_dir).select("prop_id", "f_n", "rec_id", "traj_id", "fitness", "key")
    return R.best_overall(r)


def _best_traj(spark, sf_dir):
    r = _records(spark, sf_dir).select("prop_id", "f_n", "traj_id", "rec_id", "fitness", "key", "indices")
    return R.best_per_trajectory(r)


BEST_TRAJ_SQL = """bt AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY prop_id, f_n, traj_id ORDER BY rec_id DESC) AS rn FROM recs)
  WHERE rn = 1)"""


@query("a12_best_per_trajectory", with_ctes(REC_SQL, BEST_TRAJ_SQL) + """
SELECT prop_id, f_n, traj_id, rec_id, fitness, key FROM bt""")
def a12_best_per_trajectory(spark, sf_dir):
    return _best_traj(spark, sf_dir).drop("indices")


@query("a9_feature_frequency", with_ctes(REC_SQL, BEST_TRAJ_SQL) + """,
c AS (SELECT prop_id, f_n, idx, count(*) AS count FROM (SELECT prop_id, f_n, unnest(indices) AS idx FROM bt)
      GROUP BY 1, 2, 3)
SELECT prop_id, f_n, idx, count,
       row_number() OVER (PARTITION BY prop_id, f_n ORDER BY count DESC, idx) - 1 AS rank FROM c""")
def a9_feature_frequency(spark, sf_dir):
    return R.feature_frequency(_best_traj(spark, sf_dir))


@query("a10_selected_set", with_ctes(REC_SQL, BEST_TRAJ_SQL) + """
SELECT prop_id, f_n, array_to_string(list_sort(list(DISTINCT idx)), ',') AS selected
FROM (SELECT prop_id, f_n, unnest(indices) AS idx FROM bt) GROUP BY prop_id, f_n""")
def a10_selected_set(spark, sf_dir):
    s = R.selected_set(_best_traj(spark, sf_dir))
    return s.select("prop_id", "f_n", F.array_join("selected", ",").alias("selected"))


TOPN_SQL = """topn AS (SELECT idx, count(*) AS count FROM (SELECT unnest(indices) AS idx FROM recs)
  GROUP BY idx ORDER BY count DESC, idx LIMIT 30)"""


def _topn(spark, sf_dir, n=30):
    r = _records(spark, sf_dir)
    c = r.select(F.explode("indices").alias("idx")).groupBy("idx").agg(F.count(F.lit(1)).alias("count"))
    return c.orderBy(F.col("count").desc(), F.col("idx")).limit(n)


@query("l1_top_n", with_ctes(REC_SQL, TOPN_SQL) + "SELECT idx, count FROM topn")
def l1_top_n(spark, sf_dir):
    """L1: the 30 most selected indices (top-k is the feature here)."""
    return _topn(spark, sf_dir)


@query("w2_dominants", with_ctes(REC_SQL) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY prop_id, generation ORDER BY fitness DESC, key) AS rn FROM recs)
SELECT prop_id, generation, rec_id, fitness, key FROM r WHERE rn = 1""")
def w2_dominants(spark, sf_dir):
    r = _records(spark, sf_dir).select("prop_id", "generation", "rec_id", "fitness", "key")
    return R.dominants(r, keys=["prop_id"])


@query("w2_fittest", with_ctes(REC_SQL) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY prop_id, generation ORDER BY fitness DESC, key) AS rn FROM recs),
d AS (SELECT * FROM r WHERE rn = 1),
l AS (SELECT *, row_number() OVER (PARTITION BY prop_id ORDER BY generation DESC) AS rl FROM d)
SELECT prop_id, generation, rec_id, fitness, key FROM l WHERE rl = 1""")
def w2_fittest(spark, sf_dir):
    r = _records(spark, sf_dir).select("prop_id", "generation", "rec_id", "fitness", "key")
    return R.fittest(R.dominants(r, keys=["prop_id"]), keys=["prop_id"])


@query("l3_elitism", with_ctes(REC_SQL) + """,
p AS (SELECT prop_id, f_n, rec_id, fitness, rec_id % 2 = 1 AS is_offspring FROM recs),
n AS (SELECT prop_id, f_n, count_if(NOT is_offspring) AS np FROM p GROUP BY 1, 2),
r AS (SELECT p.*, row_number() OVER (PARTITION BY p.prop_id, p.f_n ORDER BY fitness DESC, is_offspring, rec_id) - 1 AS rk
      FROM p)
SELECT r.prop_id, r.f_n, rec_id, fitness, is_offspring FROM r JOIN n ON r.prop_id = n.prop_id AND r.f_n = n.f_n
WHERE rk < np""")
def l3_elitism(spark, sf_dir):
    p = _records(spark, sf_dir).select("prop_id", "f_n", "rec_id", "fitness",
                                       (F.col("rec_id") % 2 == 1).alias("is_offspring"))
    return R.elitism(p, ["prop_id", "f_n"])


@query("a15_population_review", with_ctes(REC_SQL) + """
SELECT prop_id, generation, min(fitness) AS min, max(fitness) AS max,
       round(avg(fitness), 6) + 0.0 AS mean, round(stddev_pop(fitness), 6) + 0.0 AS std
FROM recs GROUP BY prop_id, generation""")
def a15_population_review(spark, sf_dir):
    r = R.population_review(_records(spark, sf_dir), ["prop_id", "generation"])
    return r.select("prop_id", "generation", "min", "max", _r6(F.col("mean")).alias("mean"),
                    _r6(F.col("std")).alias("std"))


@query("x12_softmax", with_ctes(REC_SQL) + """,
p AS (SELECT prop_id, f_n, rec_id, fitness - 0.5 AS fit FROM recs),
s AS (SELECT prop_id, f_n, sum(fit) AS s, max(fit) AS fmax, min(fit) AS fmin FROM p GROUP BY 1, 2),
e AS (SELECT p.prop_id, p.f_n, rec_id,
        exp(CASE WHEN s > 0 THEN fit / s ELSE fit END - CASE WHEN s > 0 THEN fmax / s ELSE fmax END) AS e
      FROM p JOIN s ON p.prop_id = s.prop_id AND p.f_n = s.f_n)
SELECT prop_id, f_n, rec_id, round(e / sum(e) OVER (PARTITION BY prop_id, f_n), 6) + 0.0 AS prob FROM e""")
def x12_softmax(spark, sf_dir):
    """X12 on fitness centred at 0 so some populations have a negative sum
    (Q2: the softmax of the fitness itself is used there)."""
    p = _records(spark, sf_dir).select("prop_id", "f_n", "rec_id", (F.col("fitness") - 0.5).alias("fitness"))
    s = R.softmax_probs(p, ["prop_id", "f_n"])
    return s.select("prop_id", "f_n", "rec_id", _r6(F.col("prob")).alias("prob"))


@query("u3_pair_sets", with_ctes(REC_SQL) + """,
p AS (SELECT rec_id // 2 AS pair, arg_min(indices, rec_id) AS a, arg_max(indices, rec_id) AS b FROM recs GROUP BY 1)
SELECT pair, array_to_string(list_sort(list_intersect(a, b)), ',') AS common,
       array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_a,
       array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS only_b FROM p""")
def u3_pair_sets(spark, sf_dir):
    r = _records(spark, sf_dir).withColumn("pair", F.floor(F.col("rec_id") / 2).cast("bigint"))
    s = R.pair_sets(r, "pair", "rec_id")
    return s.select("pair", *[F.array_join(c, ",").alias(c) for c in ("common", "only_a", "only_b")])


@query("w1_best_so_far", with_ctes(FX.C4_SQL) + """
SELECT sample_id, proc_2 AS run,
       max(y) OVER (PARTITION BY proc_2 ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far
FROM targets""")
def w1_best_so_far(spark, sf_dir):
    """Running best target per run in round order - exact, and a hot run
    is split over many tasks (see ordering.running_max)."""
    t = FX.targets(spark, sf_dir).select("sample_id", F.col("proc_2").alias("run"), "y")
    return running_max(t, ["run"], [F.col("sample_id")], "y", out="best_so_far").select(
        "sample_id", "run", "best_so_far")


@query("a18_best_observed", with_ctes(FX.C4_SQL) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY proc_2 ORDER BY y DESC, sample_id) AS rn FROM targets)
SELECT proc_2 AS run, y AS y_max, sample_id FROM r WHERE rn = 1""")
def a18_best_observed(spark, sf_dir):
    """y_max and the sample holding it per run (ties -> first id)."""
    t = FX.targets(spark, sf_dir)
    b = t.groupBy(F.col("proc_2").alias("run")).agg(
        F.max_by(F.struct("y", "sample_id"), F.struct(F.col("y"), -F.col("sample_id"))).alias("b"))
    return b.select("run", F.col("b.y").alias("y_max"), F.col("b.sample_id").alias("sample_id"))


PAIRS_SQL = """pairs AS (SELECT l_returnflag, l_orderkey % 10 + 1 AS fold, l_extendedprice AS y,
    l_quantity * p_retailprice * (1 + l_tax - l_discount) AS pred
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _pairs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        "l_returnflag", (F.col("l_orderkey") % 10 + 1).alias("fold"), F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * F.col("p_retailprice") * (F.lit(1) + F.col("l_tax") - F.col("l_discount"))).alias("pred"))


@query("a13_regression_metrics", with_ctes(PAIRS_SQL) + """
SELECT l_returnflag, count(*) AS n, round(avg(abs(y - pred)), 6) + 0.0 AS mae,
       round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) + 0.0 AS r2
FROM pairs GROUP BY l_returnflag""")
def a13_regression_metrics(spark, sf_dir):
    m = M.regression_metrics(_pairs(spark, sf_dir), ["l_returnflag"])
    return m.select("l_returnflag", "n", _r6(F.col("mae")).alias("mae"), _r6(F.col("r2")).alias("r2"))


@query("a16_cv_summary", with_ctes(PAIRS_SQL) + """,
fm AS (SELECT l_returnflag, fold, avg(abs(y - pred)) AS mae,
              1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS r2 FROM pairs GROUP BY 1, 2)
SELECT l_returnflag, round(avg(r2), 6) + 0.0 AS r2_mean, round(stddev_pop(r2), 6) + 0.0 AS r2_std,
       round(avg(mae), 6) + 0.0 AS mae_mean, round(stddev_pop(mae), 6) + 0.0 AS mae_std,
       string_agg(printf('%.4f', round_even(r2, 4) + 0.0), ',' ORDER BY fold) AS per_fold_r2,
       string_agg(printf('%.4f', round_even(mae, 4) + 0.0), ',' ORDER BY fold) AS per_fold_mae
FROM fm GROUP BY l_returnflag""")
def a16_cv_summary(spark, sf_dir):
    fm = M.regression_metrics(_pairs(spark, sf_dir), ["l_returnflag", "fold"])
    s = M.cv_summary(fm, ["l_returnflag"])

    def fmt(c):
        return F.array_join(F.transform(c, lambda v: F.format_string("%.4f", F.bround(v, 4) + F.lit(0.0))), ",")
    return s.select("l_returnflag", *[_r6(F.col(c)).alias(c) for c in ("r2_mean", "r2_std", "mae_mean", "mae_std")],
                    fmt(F.col("per_fold_r2")).alias("per_fold_r2"), fmt(F.col("per_fold_mae")).alias("per_fold_mae"))


def _class_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    classes = F.array(*[F.lit(c) for c in PRIORITIES])
    return o.select(F.col("o_orderstatus").alias("proc_1"), F.col("o_orderpriority").alias("y"),
                    F.element_at(classes, (F.floor("o_totalprice") % 5 + 1).cast("int")).alias("pred"))


@query("a14_classification_metrics", """
WITH pairs AS (SELECT o_orderstatus AS proc_1, o_orderpriority AS y,
    (['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])[CAST(floor(o_totalprice) % 5 AS BIGINT) + 1] AS pred
  FROM orders),
conf AS (SELECT proc_1, y, pred, count(*) AS c FROM pairs GROUP BY 1, 2, 3),
sup AS (SELECT proc_1, y AS cls, sum(c) AS support FROM conf GROUP BY 1, 2),
prd AS (SELECT proc_1, pred AS cls, sum(c) AS npred FROM conf GROUP BY 1, 2),
tp AS (SELECT proc_1, y AS cls, c AS tp FROM conf WHERE y = pred),
per AS (SELECT coalesce(s.proc_1, p.proc_1) AS proc_1, coalesce(s.cls, p.cls) AS cls,
          coalesce(support, 0) AS support, coalesce(npred, 0) AS npred
        FROM sup s FULL JOIN prd p ON s.proc_1 = p.proc_1 AND s.cls = p.cls),
per2 AS (SELECT per.*, coalesce(tp.tp, 0) AS tp FROM per LEFT JOIN tp ON per.proc_1 = tp.proc_1 AND per.cls = tp.cls)
SELECT proc_1, round(sum(tp) / sum(support), 6) + 0.0 AS accuracy,
       round(sum(CASE WHEN support + npred > 0 THEN 2.0 * tp / (support + npred) ELSE 0.0 END * support)
             / sum(support), 6) + 0.0 AS f1_weighted
FROM per2 GROUP BY proc_1""")
def a14_classification_metrics(spark, sf_dir):
    m = M.classification_metrics(_class_pairs(spark, sf_dir), ["proc_1"])
    return m.select("proc_1", _r6(F.col("accuracy")).alias("accuracy"), _r6(F.col("f1_weighted")).alias("f1_weighted"))


def _wf_rounded(spark, sf_dir):
    from stoich.plans.q_composition import j1_weighted_features
    return j1_weighted_features(spark, sf_dir)


WF_SQL = with_ctes(FX.C1_SQL, FX.C2_SQL, SHARES_SQL) + f""",
wf AS (SELECT s.sample_id, f.feature_id, {NINE} AS value
       FROM shares s JOIN efeat f ON s.element = f.element GROUP BY 1, 2),
fb AS (SELECT feature_id, min(value) AS lo, CASE WHEN min(value) = max(value) THEN max(value) + 1 ELSE max(value) END AS hi
       FROM wf GROUP BY feature_id)
"""


def feature_bounds(wf):
    """Per-feature min/max; a zero range gets max + 1."""
    b = wf.groupBy("feature_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return b.select("feature_id", "lo", F.when(F.col("lo") == F.col("hi"), F.col("hi") + 1)
                    .otherwise(F.col("hi")).alias("hi"))


@query("a17_feature_bounds", WF_SQL + "SELECT feature_id, lo, hi FROM fb")
def a17_feature_bounds(spark, sf_dir):
    return feature_bounds(_wf_rounded(spark, sf_dir))


@query("x15_minmax_standardise", WF_SQL + """
SELECT wf.sample_id, wf.feature_id, round((wf.value - fb.lo) / (fb.hi - fb.lo), 6) + 0.0 AS scaled
FROM wf JOIN fb ON wf.feature_id = fb.feature_id""")
def x15_minmax_standardise(spark, sf_dir):
    """Min-max scaling with stored bounds (A17, one row per feature:
    broadcast after a size check)."""
    wf = _wf_rounded(spark, sf_dir)
    b = bounded_broadcast(feature_bounds(wf))
    return wf.join(b, "feature_id").select(
        "sample_id", "feature_id", _r6((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("scaled"))


CORR_SQL = with_ctes(FX.C2_SQL, FX.C3_SQL) + """,
cc AS (SELECT p.feature_id AS emp_feature, e.feature_id AS emb_feature, corr(p.value, e.value) AS c
       FROM pfeat p JOIN efeat e ON p.element = e.element GROUP BY 1, 2)
"""


def cross_correlation(emp, emb):
    """Pearson r between each empirical and each embedding feature over
    the elements; NaN where one of them is the same for all elements, null
    without an element that has both.  Both sides are element x feature tables
    (bounded); the join is on element."""
    e = bounded_broadcast(emp.select("element", F.col("feature_id").alias("emp_feature"), F.col("value").alias("a")))
    j = emb.select("element", F.col("feature_id").alias("emb_feature"), F.col("value").alias("b")).join(e, "element")
    # corr() divides by the spread, which is an error where that is zero
    a, b = F.when(F.col("b").isNotNull(), F.col("a")), F.when(F.col("a").isNotNull(), F.col("b"))
    s = j.groupBy("emp_feature", "emb_feature").agg(
        F.covar_pop(a, b).alias("ab"), F.var_pop(a).alias("aa"), F.var_pop(b).alias("bb"))
    spread = F.sqrt(F.col("aa") * F.col("bb"))
    return s.select("emp_feature", "emb_feature", F.when(spread == 0, F.lit(float("nan"))).otherwise(
        F.try_divide("ab", spread)).alias("c"))


def _corr(spark, sf_dir):
    return cross_correlation(FX.empirical_features(spark, sf_dir), FX.embedding_features(spark, sf_dir))


@query("a20_cross_correlation", CORR_SQL + "SELECT emp_feature, emb_feature, round(c, 6) + 0.0 AS corr FROM cc")
def a20_cross_correlation(spark, sf_dir):
    return _corr(spark, sf_dir).select("emp_feature", "emb_feature", _r6(F.col("c")).alias("corr"))


@query("f9_corr_mask", CORR_SQL + """
SELECT emp_feature, emb_feature, CASE WHEN abs(c) >= 0.3 THEN round(c, 6) + 0.0 END AS corr FROM cc""")
def f9_corr_mask(spark, sf_dir):
    c = _corr(spark, sf_dir)
    return c.select("emp_feature", "emb_feature",
                    F.when(F.abs("c") >= 0.3, _r6(F.col("c"))).alias("corr"))


@query("j3_top_feature_columns", CORR_SQL.replace("WITH ", "WITH " + REC_SQL + ",\n" + TOPN_SQL + ",\n", 1) + """,
tr AS (SELECT idx, row_number() OVER (ORDER BY count DESC, idx) - 1 AS rank FROM topn)
SELECT cc.emp_feature, tr.rank, cc.emb_feature, round(cc.c, 6) + 0.0 AS corr
FROM cc JOIN tr ON cc.emb_feature = tr.idx""")
def j3_top_feature_columns(spark, sf_dir):
    """Correlation columns of the top-30 frequent indices, in frequency
    order (rank), those that exist only (inner join)."""
    top = global_rank(_topn(spark, sf_dir), [F.col("count").desc(), F.col("idx")], out="rank")
    c = _corr(spark, sf_dir)
    return c.join(F.broadcast(top.select(F.col("idx").alias("emb_feature"), "rank")), "emb_feature").select(
        "emp_feature", "rank", "emb_feature", _r6(F.col("c")).alias("corr"))


@query("x16_scale_to_percent", with_ctes(FX.C1_SQL, SHARES_SQL) + """
SELECT sample_id, element, round_even(share * 100, 3) + 0.0 AS pct FROM shares""")
def x16_scale_to_percent(spark, sf_dir):
    s = C.normalise_rows(FX.composition(spark, sf_dir))
    return s.select("sample_id", "element", (F.bround(F.col("share") * 100, 3) + F.lit(0.0)).alias("pct"))


@query("x22_label_encode", with_ctes(FX.C4_SQL) + """,
d AS (SELECT class_label, row_number() OVER (ORDER BY class_label) - 1 AS label FROM (SELECT DISTINCT class_label FROM targets))
SELECT t.sample_id, t.class_label, d.label FROM targets t JOIN d ON t.class_label = d.class_label""")
def x22_label_encode(spark, sf_dir):
    """Sorted distinct labels -> 0..k-1 (exact distributed rank of the
    distinct table), joined back (broadcast after a size check)."""
    t = FX.targets(spark, sf_dir)
    d = global_rank(t.select("class_label").distinct(), [F.col("class_label")], out="label")
    return t.join(bounded_broadcast(d.select("class_label", "label")), "class_label").select(
        "sample_id", "class_label", "label")


@query("a5_split_counts", with_ctes(FX.C4_SQL) + """
SELECT count(*) AS n_total, count_if(proc_1 <> 'P') AS n_after_status,
       count_if(proc_1 <> 'P' AND proc_2 <> 0) AS n_after_proc,
       count_if(NOT (proc_1 <> 'P' AND proc_2 <> 0)) AS n_deleted FROM targets""")
def a5_split_counts(spark, sf_dir):
    """A5: the loader's filter funnel counted in one pass with count_if."""
    t = FX.targets(spark, sf_dir)
    a = F.col("proc_1") != "P"
    b = a & (F.col("proc_2") != 0)
    return t.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(a).alias("n_after_status"),
                 F.count_if(b).alias("n_after_proc"), F.count_if(~b).alias("n_deleted"))



def _written_scores(spark, sf_dir):
    """K3 then S9: scores written as prop_id=/f_n= folders in the shared
    checkpoint folder, then read back with partition discovery."""
    import uuid

    from stoich.session import ensure_checkpoint_dir
    from stoich.sources import io as IO
    path = f"{ensure_checkpoint_dir(spark)}/results-{uuid.uuid4().hex}"
    IO.partition_results(_scores(spark, sf_dir), path)
    return IO.read_results(spark, path)


@query("s9_read_results", with_ctes(FX.C6_SQL) + """
SELECT exp_id, prop_id, f_n, traj_id, kind, model, seed, score FROM scores""")
def s9_read_results(spark, sf_dir):
    """K3 + S9: experiment scores round-tripped through key=value folders."""
    r = _written_scores(spark, sf_dir)
    return r.select("exp_id", F.col("prop_id").cast("bigint").alias("prop_id"), F.col("f_n").cast("bigint").alias("f_n"),
                    "traj_id", "kind", "model", "seed", "score")


@query("s10_lookup", with_ctes(FX.C6_SQL) + """
SELECT exp_id, traj_id, kind, score FROM scores WHERE prop_id = 1 AND f_n = 3""")
def s10_lookup(spark, sf_dir):
    """The records of one (prop_id, f_n) - partition pruning on the
    written folders (error if none)."""
    from stoich.sources import io as IO
    r = IO.lookup(_written_scores(spark, sf_dir), 1, 3)
    return r.select("exp_id", "traj_id", "kind", "score")

"""Model queries: ridge CV from Gram statistics (M6, M11), subset fitness
and search (M12, M13), feature-set comparison (M24), Bayesian ridge (M7),
PLS (M9), kernel ridge by random Fourier features (M10), kNN (J8)."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stoich.functions.rng import sql_uniform, uniform
from stoich.operators import composition as C
from stoich.operators import crossval as CV
from stoich.operators import linear as L
from stoich.operators import metrics as M
from stoich.operators import sampling as S
from stoich.operators import scaling as N
from stoich.operators import subset as SS
from stoich.operators.islands import search_islands
from stoich.operators.neighbors import KnnSearch, knn_predict
from stoich.operators.registry import RFF, random_fourier
from stoich.plans.catalog import query
from stoich.plans.q_composition import nine_of, weighted_matrix
from stoich.plans.q_results import WF_SQL, _records, _wf_rounded
from stoich.plans.q_sampling import _fold_sql
from stoich.session import cut_lineage
from stoich.sources import fixtures as FX

D = FX.N_FEATURES
FIT_SEEDS = [0, 1, 2, 3]          # 4 repeats of 10-fold CV inside the fitness
EVAL_SEEDS = list(range(48))      # outer evaluation seeds
SEL2 = [17, 3]                    # two chosen features for the closed-form ridge check


def _model_rows(spark, sf_dir, robust: bool = False, tag=None):
    """(sample_id, features array<double>[64], y): weighted features of each
    order's composition and its total price; ``tag`` adds further columns to
    the table of rows (folds, say).

    Only the shares, targets and tags are written: the features are computed
    from them in every pass that reads the rows."""
    t = FX.targets(spark, sf_dir).select("sample_id", "y")
    weighted = weighted_matrix(spark, sf_dir)
    if weighted is not None and (weighted.dense or not robust):
        if robust:
            weighted = weighted.written()
            middle, width = N.robust_fit_arrays(weighted.arrays(finish=nine_of), "sample_id", "features",
                                               len(weighted.columns), _known(weighted))
        weighted = _model_samples(weighted, t, tag)
        if not robust:
            return weighted.arrays(finish=nine_of)
        middle = np.array([np.nan if m is None else m for m in middle])
        return weighted.arrays(finish=lambda v: (nine_of(v) - middle) / np.array(width))
    wf = _wf_rounded(spark, sf_dir)
    if robust:
        wf = N.robust_scale(wf).select("sample_id", "feature_id", F.col("scaled").alias("value"))
    rows = cut_lineage(C.feature_array(wf).join(t, "sample_id"))
    return rows if tag is None else tag(rows)


def _model_samples(weighted, t, tag=None):
    """The samples of ``t`` that have features, their shares written."""
    weighted = weighted.joined(t).known().written()
    return weighted if tag is None else weighted.tagged(tag).written()


def _known(weighted):
    """The number of samples, and the features of some, without computing those
    of all."""
    return weighted.packed.count(), weighted.some(CV.SAMPLE_ROWS).arrays(finish=nine_of)


def _r(c, p):
    return F.round(c, p) + F.lit(0.0)


RIDGE2_SQL = WF_SQL + f""",
x AS (SELECT sample_id, max(CASE WHEN feature_id = {SEL2[0]} THEN value END) AS x1,
             max(CASE WHEN feature_id = {SEL2[1]} THEN value END) AS x2 FROM wf GROUP BY 1),
dd AS (SELECT x.sample_id, x1, x2, o_totalprice AS y FROM x JOIN orders ON x.sample_id = o_orderkey),
rr AS (SELECT *, row_number() OVER (ORDER BY {sql_uniform('kf', 'sample_id')}, sample_id) - 1 AS rk,
       count(*) OVER () AS n FROM dd),
f AS (SELECT sample_id, x1, x2, y, {_fold_sql('rk', 'n', 10)} AS fold FROM rr),
fs AS (SELECT fold, count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(y) AS sy, sum(x1 * x1) AS s11,
       sum(x1 * x2) AS s12, sum(x2 * x2) AS s22, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y FROM f GROUP BY fold),
tot AS (SELECT sum(n) AS n, sum(s1) AS s1, sum(s2) AS s2, sum(sy) AS sy, sum(s11) AS s11, sum(s12) AS s12,
        sum(s22) AS s22, sum(s1y) AS s1y, sum(s2y) AS s2y FROM fs),
tr AS (SELECT fs.fold, tot.n - fs.n AS n, tot.s1 - fs.s1 AS s1, tot.s2 - fs.s2 AS s2, tot.sy - fs.sy AS sy,
       tot.s11 - fs.s11 AS s11, tot.s12 - fs.s12 AS s12, tot.s22 - fs.s22 AS s22,
       tot.s1y - fs.s1y AS s1y, tot.s2y - fs.s2y AS s2y FROM fs CROSS JOIN tot),
c AS (SELECT fold, s1 / n AS m1, s2 / n AS m2, sy / n AS my,
       s11 - n * (s1 / n) * (s1 / n) + 1.0 AS a11, s12 - n * (s1 / n) * (s2 / n) AS a12,
       s22 - n * (s2 / n) * (s2 / n) + 1.0 AS a22,
       s1y - n * (s1 / n) * (sy / n) AS c1, s2y - n * (s2 / n) * (sy / n) AS c2 FROM tr),
b AS (SELECT fold, (a22 * c1 - a12 * c2) / (a11 * a22 - a12 * a12) AS b1,
       (a11 * c2 - a12 * c1) / (a11 * a22 - a12 * a12) AS b2, m1, m2, my FROM c),
b2 AS (SELECT fold, b1, b2, my - m1 * b1 - m2 * b2 AS b0 FROM b),
p AS (SELECT f.fold, f.y, b2.b0 + b2.b1 * f.x1 + b2.b2 * f.x2 AS pred FROM f JOIN b2 ON f.fold = b2.fold)
"""


def _ridge2(spark, sf_dir):
    rows = _model_rows(spark, sf_dir, tag=lambda rows: S.kfold(rows, 10, "kf", "sample_id"))
    folds = C.select_features(rows, SEL2, out="x").select("sample_id", "x", "y", "fold")
    st = L.collect_stats(L.gram_stats(folds, "x", "y", ["fold"], 2), ["fold"], 2)
    coefs = L.cv_coefficients(st, 0, alpha=1.0)
    cdf = spark.createDataFrame(coefs, T.StructType([
        T.StructField("fold", T.LongType()), T.StructField("coef", T.ArrayType(T.DoubleType())),
        T.StructField("intercept", T.DoubleType())]))
    return folds, cdf


@query("m6_ridge_cv", RIDGE2_SQL + """
SELECT b2.fold, count(*) AS n, round(b1, 2) + 0.0 AS b1, round(b2.b2, 2) + 0.0 AS b2, round(b0, 2) + 0.0 AS b0,
       round(avg(abs(p.y - p.pred)), 2) + 0.0 AS mae
FROM b2 JOIN p ON b2.fold = p.fold GROUP BY b2.fold, b1, b2.b2, b0""")
def m6_ridge_cv(spark, sf_dir):
    """M6 + M11: ridge (alpha 1, intercept) on two weighted features, fitted
    per fold from Gram statistics (train = total - fold); per-fold
    coefficients and out-of-fold MAE."""
    folds, cdf = _ridge2(spark, sf_dir)
    pred = L.predict_with(folds, cdf, ["fold"], features="x")
    met = pred.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae"))
    c = cdf.select("fold", F.col("coef")[0].alias("b1"), F.col("coef")[1].alias("b2"), F.col("intercept").alias("b0"))
    return met.join(c, "fold").select("fold", "n", _r(F.col("b1"), 2).alias("b1"), _r(F.col("b2"), 2).alias("b2"),
                                      _r(F.col("b0"), 2).alias("b0"), _r(F.col("mae"), 2).alias("mae"))


@query("m6_elastic_net_cv")
def m6_elastic_net_cv(spark, sf_dir):
    """M6: lasso and elastic net per fold from Gram statistics, out-of-fold
    metrics per model (optimality conditions are tested)."""
    data = _one_kfold(_model_rows(spark, sf_dir, robust=True, tag=lambda rows: S.kfold(rows, 10, 43, "sample_id")), D)
    moments = CV.fold_moments(data)
    ratios = {"lasso": 1.0, "elastic_net": 0.5}
    coefs = np.concatenate([CV.coefficients(data, moments, fit=lambda t, q=q: L.elastic_net_fit(t, 0.1, q))
                            for q in ratios.values()])
    # a model per repeat, the same folds in all of them
    each = CV.Folded(data.rows.withColumn("folds", F.array_repeat(F.col("folds")[0], len(ratios))), D, 10,
                     list(range(len(ratios))))
    names = F.array(*[F.lit(n) for n in ratios])
    return CV.cv_scores(each, coefs).select(F.get(names, F.col("seed").cast("int")).alias("model"), "n", "mae", "r2")


def _one_kfold(rows, d):
    """Rows with a ``fold`` as one repeat of 10 folds."""
    return CV.Folded(rows.select("sample_id", "features", "y", F.array(F.col("fold").cast("int")).alias("folds")),
                     d, 10, [0])


@query("m11_pooled_metrics", RIDGE2_SQL + """
SELECT count(*) AS n, round(avg(abs(y - pred)), 2) + 0.0 AS mae,
       round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) + 0.0 AS r2 FROM p""")
def m11_pooled_metrics(spark, sf_dir):
    """M11 + A13: pooled out-of-fold MAE and R^2."""
    folds, cdf = _ridge2(spark, sf_dir)
    pred = L.predict_with(folds, cdf, ["fold"], features="x")
    m = M.regression_metrics(pred)
    return m.select("n", _r(F.col("mae"), 2).alias("mae"), _r(F.col("r2"), 6).alias("r2"))


def _folded(spark, sf_dir, seeds):
    """Weighted features and targets with their folds in every repeat."""
    tag = lambda rows: CV.fold_arrays(rows.where(F.col("y").isNotNull()), 10, seeds, "sample_id")
    own = [F.col("sample_id").cast("bigint").alias("id"), "features", "y", "folds"]
    weighted = weighted_matrix(spark, sf_dir)
    if weighted is None:
        rows, known = cut_lineage(_model_rows(spark, sf_dir, tag=tag).select(own)), None
    else:
        weighted = _model_samples(weighted, FX.targets(spark, sf_dir).select("sample_id", "y"), tag)
        rows, known = weighted.arrays(finish=nine_of).select(own), _known(weighted)
    return CV.Folded(rows, D, 10, [int(s) for s in seeds], known)


@query("m11_cross_validate")
def m11_cross_validate(spark, sf_dir):
    """M11 (G4, N1): 64 weighted features, 48 seeds x 10 folds, the robust
    scaler fitted on each training part; pooled out-of-fold R^2 and MAE per
    seed.  Coefficients from fold sums, one product per Arrow batch."""
    data = _folded(spark, sf_dir, EVAL_SEEDS)
    return CV.cv_scores(data, CV.coefficients(data, CV.fold_moments(data), CV.robust_scales(data)))


def _train_folds_sql(ids: str, seeds, cv_id: str) -> str:
    """CTE ``f(seed, id, fold)`` over the ids of a table."""
    return f"""
sd AS (SELECT id, seed FROM {ids} CROSS JOIN (SELECT unnest({list(seeds)}) AS seed)),
rr AS (SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY {sql_uniform('cv', 'seed', 'id')}, id) - 1 AS rk,
       count(*) OVER (PARTITION BY seed) AS n FROM sd),
f AS (SELECT seed, id, {_fold_sql('rk', 'n', 10)} AS fold FROM rr),
g AS (SELECT unnest(range(10)) AS fold)"""


N1_SEEDS = [0, 1]


@query("n1_train_only_scale", WF_SQL + f""",
ids AS (SELECT DISTINCT sample_id AS id FROM wf JOIN orders ON sample_id = o_orderkey),
{_train_folds_sql('ids', N1_SEEDS, 'cv')},
q AS (SELECT f.seed, g.fold, wf.feature_id, quantile_cont(wf.value, [0.25, 0.5, 0.75]) AS q
      FROM f JOIN g ON g.fold <> f.fold JOIN wf ON wf.sample_id = f.id GROUP BY 1, 2, 3)
SELECT CAST(seed AS BIGINT) AS seed, CAST(fold AS BIGINT) AS fold, feature_id, round(q[2], 6) + 0.0 AS median,
       round(CASE WHEN q[3] = q[1] THEN 1.0 ELSE q[3] - q[1] END, 6) + 0.0 AS scale FROM q""")
def n1_train_only_scale(spark, sf_dir):
    """N1 inside M11: exact median and inter-quartile range of every feature
    over the training part of every fold."""
    data = _folded(spark, sf_dir, N1_SEEDS)
    fit = CV.robust_scales(data)
    rows = [(seed, f, i, float(fit[j, f, 0, i]), float(fit[j, f, 1, i])) for j, seed in enumerate(N1_SEEDS)
            for f in range(10) for i in range(D)]
    df = spark.createDataFrame(rows, "seed long, fold long, feature_id long, median double, scale double")
    return df.select("seed", "fold", "feature_id", _r(F.col("median"), 6).alias("median"), _r(F.col("scale"), 6).alias("scale"))


def _ridge_two_sql(value: str) -> str:
    """CTEs from ``x(id, x1, x2, y, pair)`` and ``f`` to ``p(pair, seed, fold,
    y, pred)``: ridge (alpha 1) of y on two features that are robust-scaled on
    each training part; ``value`` names the target."""
    return f"""
tx AS (SELECT x.pair, f.seed, g.fold, x1, x2, {value} AS y FROM x JOIN f ON x.id = f.id JOIN g ON g.fold <> f.fold),
w AS (SELECT pair, seed, fold, quantile_cont(x1, [0.25, 0.75]) AS q1, quantile_cont(x2, [0.25, 0.75]) AS q2 FROM tx GROUP BY ALL),
ws AS (SELECT pair, seed, fold, CASE WHEN q1[2] = q1[1] THEN 1.0 ELSE q1[2] - q1[1] END AS w1,
       CASE WHEN q2[2] = q2[1] THEN 1.0 ELSE q2[2] - q2[1] END AS w2 FROM w),
m AS (SELECT pair, seed, fold, count(*) AS n, avg(x1 / w1) AS m1, avg(x2 / w2) AS m2, avg(y) AS my,
      count(*) * var_pop(x1 / w1) + 1.0 AS a11, count(*) * covar_pop(x1 / w1, x2 / w2) AS a12,
      count(*) * var_pop(x2 / w2) + 1.0 AS a22, count(*) * covar_pop(x1 / w1, y) AS c1, count(*) * covar_pop(x2 / w2, y) AS c2
      FROM tx JOIN ws USING (pair, seed, fold) GROUP BY ALL),
b AS (SELECT *, (a22 * c1 - a12 * c2) / (a11 * a22 - a12 * a12) AS b1, (a11 * c2 - a12 * c1) / (a11 * a22 - a12 * a12) AS b2 FROM m),
p AS (SELECT x.pair, f.seed, f.fold, x.id, x.y, my + b1 * (x1 / w1 - m1) + b2 * (x2 / w2 - m2) AS pred
      FROM x JOIN f ON x.id = f.id JOIN b ON b.pair = x.pair AND b.seed = f.seed AND b.fold = f.fold
      JOIN ws ON ws.pair = x.pair AND ws.seed = f.seed AND ws.fold = f.fold)"""


PAIRS = [(3, 17), (5, 40), (0, 63)]
PAIRS_SQL = "pairs AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}*{b}', {a}, {b})" for a, b in PAIRS) + ") v(pair, i1, i2))"


@query("m12_two_feature_fitness", WF_SQL + f""",
{PAIRS_SQL},
x AS (SELECT pair, sample_id AS id, max(CASE WHEN feature_id = i1 THEN value END) AS x1,
             max(CASE WHEN feature_id = i2 THEN value END) AS x2, any_value(o_totalprice) AS y
      FROM wf JOIN orders ON sample_id = o_orderkey CROSS JOIN pairs GROUP BY 1, 2),
ids AS (SELECT DISTINCT id FROM x),
{_train_folds_sql('ids', FIT_SEEDS, 'cv')},
{_ridge_two_sql('x.y')},
r AS (SELECT pair, seed, 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS r2 FROM p GROUP BY 1, 2)
SELECT pair AS key, round(avg(r2), 6) + 0.0 AS fitness FROM r GROUP BY 1""")
def m12_two_feature_fitness(spark, sf_dir):
    """M12 with the scaler fitted on the training parts, for pairs of features."""
    totals, folds, scales = _fit_stats(spark, sf_dir)
    pairs = spark.createDataFrame([(f"{a}*{b}", [a, b]) for a, b in PAIRS], "key string, indices array<long>")
    out = SS.subset_fitness(pairs, totals, folds, scales=scales)
    return out.select("key", _r(F.col("fitness"), 6).alias("fitness"))


def _class_rows(spark, sf_dir, label, seeds):
    v = FX.vectors(spark, sf_dir).where("label IS NOT NULL")
    return CV.Folded.of(v.withColumn("c", label), "features", "c", "vec_id", D, 10, seeds)


def _n_classes(spark, sf_dir):
    """Class labels are numbers from 0 on; their count is checked."""
    most = FX.vectors(spark, sf_dir).agg(F.max("label")).first()[0]
    if most is not None and most >= 1_000:
        raise ValueError("more than 1000 classes")
    return 0 if most is None else int(most) + 1


@query("m11_class_two_features", f"""
WITH x AS (SELECT '3*17' AS pair, vec_id AS id, CAST(embedding[4] AS DOUBLE) AS x1, CAST(embedding[18] AS DOUBLE) AS x2,
                  CAST(label % 2 AS DOUBLE) AS y FROM embeddings WHERE label IS NOT NULL),
ids AS (SELECT id FROM x),
{_train_folds_sql('ids', FIT_SEEDS, 'cv')},
{_ridge_two_sql('x.y')},
t AS (SELECT seed, y = 1 AS is1, pred > 0.5 AS told1 FROM p),
c AS (SELECT seed, count(*) AS n, count_if(is1) AS n1, count_if(told1) AS t1, count_if(is1 AND told1) AS h1,
      count_if(NOT is1 AND NOT told1) AS h0 FROM t GROUP BY 1)
SELECT CAST(seed AS BIGINT) AS seed, round((h1 + h0) / n, 6) + 0.0 AS accuracy,
       round((n1 * (CASE WHEN n1 + t1 > 0 THEN 2.0 * h1 / (n1 + t1) ELSE 0 END)
              + (n - n1) * (CASE WHEN 2 * n - n1 - t1 > 0 THEN 2.0 * h0 / (2 * n - n1 - t1) ELSE 0 END)) / n, 6) + 0.0 AS f1_weighted
FROM c""")
def m11_class_two_features(spark, sf_dir):
    """M11 for two classes and two features: out-of-fold accuracy and
    weighted F1 per repeat, scaler fitted on the training parts."""
    data = _class_rows(spark, sf_dir, F.col("label") % 2, FIT_SEEDS)
    models = CV.coefficients(data, CV.fold_moments(data, 2), CV.robust_scales(data), columns=[3, 17])
    out = CV.class_scores(CV.class_counts(data, models[None]))
    return out.select("seed", _r(F.col("accuracy"), 6).alias("accuracy"), _r(F.col("f1_weighted"), 6).alias("f1_weighted"))


@query("m11_class_cross_validate")
def m11_class_cross_validate(spark, sf_dir):
    """M11 with class labels: one-against-rest ridge on all features, 48 seeds
    x 10 folds, accuracy and weighted F1 per seed."""
    n = _n_classes(spark, sf_dir)
    data = _class_rows(spark, sf_dir, F.col("label"), EVAL_SEEDS)
    models = CV.coefficients(data, CV.fold_moments(data, n), CV.robust_scales(data))
    return CV.class_scores(CV.class_counts(data, models[None])).drop("model")


@query("m12_class_fitness")
def m12_class_fitness(spark, sf_dir):
    """M12 with class labels: mean out-of-fold accuracy (and weighted F1) of
    every distinct selection record's features, 4 repeats of 10 folds."""
    data = _class_rows(spark, sf_dir, F.col("label"), FIT_SEEDS)
    return SS.class_fitness(_records(spark, sf_dir).select("key", "indices"), data, _n_classes(spark, sf_dir))


def _fit_stats(spark, sf_dir, fit_scope="train"):
    return SS.folded_stats(_folded(spark, sf_dir, FIT_SEEDS), fit_scope)


@query("m12_subset_fitness")
def m12_subset_fitness(spark, sf_dir):
    """Every selection record's index subset scored (mean over 4
    repeats of pooled 10-fold ridge R^2, the scaler fitted on each training
    part), from broadcast fold sums."""
    totals, folds, scales = _fit_stats(spark, sf_dir)
    recs = _records(spark, sf_dir).select("rec_id", "indices")
    return SS.subset_fitness(recs, totals, folds, scales=scales).select("rec_id", "fitness")


@query("m13_subset_search")
def m13_subset_search(spark, sf_dir):
    """The subset search (population 192, crossover 0.8, mutation 0.1)
    for 4 features as DataFrame steps; the dominant of every generation, 10 of
    them (m13_island_search runs 100 for every trajectory)."""
    totals, folds, scales = _fit_stats(spark, sf_dir)
    pop, dom = SS.subset_search(spark, totals, folds, D, 4, n_pop=192, cxpb=0.8, mutpb=0.1, ngen=10, scales=scales)
    return dom.select("generation", "key", "fitness")


@query("m13_island_search")
def m13_island_search(spark, sf_dir):
    """M13 at full size: the subset search for every (subset size, trajectory)
    that the experiment scores hold with 4 features, 100 generations each; the
    dominant of every generation."""
    totals, folds, scales = _fit_stats(spark, sf_dir)
    names = FX.selection_records(spark, sf_dir).where("f_n = 4").select(
        F.concat_ws("-", F.col("f_n").cast("string"), F.col("traj_id").cast("string")).alias("island"), "f_n").distinct()
    return search_islands(names, totals, folds, D, scales)


@query("m24_feature_set_comparison")
def m24_feature_set_comparison(spark, sf_dir):
    """The same rows, folds and seeds scored with each feature set
    (empirical, embedding, composition); pooled R^2 per (kind, seed) and the
    paired difference to the composition baseline."""
    shares = C.normalise_rows(FX.composition(spark, sf_dir))
    t = FX.targets(spark, sf_dir).select("sample_id", "y")
    samples = cut_lineage(C.pack_shares(shares).join(t, "sample_id"))
    tables = {"empirical": (4, FX.empirical_features), "embedding": (D, FX.embedding_features), "composition": (26, None)}
    fold = lambda rows: CV.fold_arrays(rows, 10, FIT_SEEDS, "sample_id")
    out = []
    for kind, (d, features) in tables.items():
        weighted = None if features is None else C.WeightedMatrix.of(shares, features(spark, sf_dir))
        if weighted is not None:
            rows = replace(weighted, packed=samples).known().tagged(fold).written().arrays()
        elif features is not None:
            rows = fold(C.feature_array(C.weighted_features(shares, features(spark, sf_dir))).join(t, "sample_id"))
        else:
            # absent elements are 0: dense array over brand numbers 0..25
            number = lambda e: F.regexp_extract(e, "(\\d+)", 1).cast("bigint")
            m = F.map_from_entries(F.transform("_parts", lambda p: F.struct(number(p["element"]), p["_share"])))
            rows = cut_lineage(fold(samples)).withColumn("m", m).withColumn("features", F.transform(
                F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))))
        data = CV.Folded(rows, d, 10, FIT_SEEDS)
        moments = CV.fold_moments(data)
        totals, folds = SS.split_stats({(seed, f): CV.as_stats(moments[j, f], d) for j, seed in enumerate(FIT_SEEDS)
                                        for f in range(10) if moments[j, f, 0, 0]})
        for seed in totals:
            out.append((kind, int(seed), float(L.pooled_r2(totals[seed], folds[seed], 1.0, standardise=True))))
    df = spark.createDataFrame(out, "kind string, seed int, r2 double")
    base = df.where(F.col("kind") == "composition").select("seed", F.col("r2").alias("r2_base"))
    return df.join(base, "seed").select("kind", "seed", "r2", (F.col("r2") - F.col("r2_base")).alias("r2_gain"))


def _all_stats(spark, sf_dir):
    rows = _model_rows(spark, sf_dir)
    return L.collect_stats(L.gram_stats(rows.withColumn("g", F.lit(0)), "features", "y", ["g"], D), ["g"], D)[(0,)]


def _coef_frame(spark, name, coef, b0, extra=None):
    rows = [(name, int(i), float(c)) for i, c in enumerate(coef)] + [(name, -1, float(b0))]
    return spark.createDataFrame(rows, "model string, feature_id int, coef double")


@query("m7_bayesian_ridge")
def m7_bayesian_ridge(spark, sf_dir):
    """M7: evidence-maximising ridge from one pass of statistics; the
    coefficients (feature_id -1 = intercept)."""
    coef, b0, _, _ = L.bayesian_ridge(_all_stats(spark, sf_dir))
    return _coef_frame(spark, "bayesian_ridge", coef, b0)


@query("m9_pls")
def m9_pls(spark, sf_dir):
    """M9: two-component PLS from the covariance statistics."""
    coef, b0 = L.pls_fit(_all_stats(spark, sf_dir), 2)
    return _coef_frame(spark, "pls", coef, b0)


@query("m10_kernel_ridge_rff")
def m10_kernel_ridge_rff(spark, sf_dir):
    """RBF kernel ridge (gamma = 1/d, alpha = 1) approximated by 256
    random Fourier features (Rahimi & Recht 2007) + ridge from Gram
    statistics; pooled 10-fold R^2 and MAE.  Approximate by construction."""
    rows = _model_rows(spark, sf_dir, robust=True, tag=lambda rows: S.kfold(rows, 10, "kf", "sample_id"))
    data = _one_kfold(random_fourier(rows, "features", D, RFF, 43), RFF)
    return CV.cv_scores(data, CV.coefficients(data, CV.fold_moments(data), alpha=1.0)).select("n", "mae", "r2")


KNN_SQL = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CAST(label AS DOUBLE) AS y,
                  {sql_uniform('knn', 'vec_id')} < 0.8 AS is_train FROM embeddings),
pairs AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.y, list_distance(q.x, t.x) AS d
          FROM v q JOIN v t ON NOT q.is_train AND t.is_train),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, tid) AS rn FROM pairs) WHERE rn <= 5)
SELECT qid AS vec_id, round(CASE WHEN count_if(d = 0) > 0 THEN sum(CASE WHEN d = 0 THEN y END) / count_if(d = 0)
       ELSE sum(y / d) / sum(1.0 / d) END, 6) + 0.0 AS pred
FROM top GROUP BY qid"""


@query("j8_knn_predict", KNN_SQL)
def j8_knn_predict(spark, sf_dir):
    """Label of each held-out embedding predicted from its 5 nearest
    training embeddings (inverse-distance weights)."""
    v = FX.vectors(spark, sf_dir).withColumn("is_train", uniform("knn", F.col("vec_id")) < 0.8)
    train = v.where("is_train").select("vec_id", "features", F.col("label").cast("double").alias("y"))
    q = v.where(~F.col("is_train")).select("vec_id", "features")
    p = knn_predict(q, train, k=5, id_col="vec_id")
    return p.select("vec_id", _r(F.col("pred"), 6).alias("pred"))


@query("j8_knn_meetings")
def j8_knn_meetings(spark, sf_dir):
    """How many (queries, block) packs met, and how many query-block
    meetings, beside all there are, with blocks of 64 rows."""
    v = FX.vectors(spark, sf_dir).withColumn("is_train", uniform("knn", F.col("vec_id")) < 0.8)
    train = v.where("is_train").select("vec_id", "features", F.col("label").cast("double").alias("y"))
    q = v.where(~F.col("is_train")).select("vec_id", "features")
    search = KnnSearch(train, "vec_id", "features", "y", 64)
    _, met = search.nearest(q, "vec_id", "features", 5)
    return met.withColumn("of_all", F.lit(q.count() * search.n_blocks).cast("bigint"))

"""Findings of round 3: the mended steps on small tables built here."""
import math
import os

import numpy as np
import pytest

from stoich.operators import composition as C
from stoich.operators import scaling as N
from stoich.plans import q_models as Q
from stoich.plans.q_results import cross_correlation
from stoich.session import written_tables

FEATURE = "element string, feature_id long, value double"


def folder(spark, path, n_orders=400, brands=25):
    """Orders with two to four line items each, parts of every brand, vectors."""
    rng = np.random.default_rng(5)
    parts = [(i, f"Brand#{i % brands + 1}", 1 + i % 50, 900.0 + i % 100) for i in range(100)]
    items = [(o, int(rng.integers(0, 100)), float(rng.integers(1, 50))) for o in range(n_orders) for _ in range(2 + o % 3)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int, p_retailprice double") \
        .write.parquet(f"{path}/part.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    orders = [(o, o % 40, "FOP"[o % 3], float(rng.normal(100, 20)), "1-URGENT") for o in range(0, n_orders, 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                                  "o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    vectors = [(i, [float(v) for v in rng.normal(size=64)], i % 3) for i in range(60)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_correlation_with_a_constant_feature_is_nan(spark):
    emp = [("a", 0, 1.0), ("b", 0, 1.0), ("a", 1, 1.0), ("b", 1, 2.0), ("a", 2, None), ("b", 2, None)]
    emb = [("a", 0, 0.5), ("b", 0, 0.1), ("a", 1, 3.0), ("b", 1, 3.0)]
    got = {(r["emp_feature"], r["emb_feature"]): r["c"] for r in cross_correlation(
        spark.createDataFrame(emp, FEATURE), spark.createDataFrame(emb, FEATURE)).collect()}
    assert math.isnan(got[0, 0]) and math.isnan(got[0, 1]) and math.isnan(got[1, 1])
    assert got[1, 0] == pytest.approx(-1.0)
    assert got[2, 0] is None and got[2, 1] is None


def test_matrix_arrays_are_the_long_features(spark):
    comp = [(1, "a", 0.25), (1, "b", 0.75), (2, "b", None), (3, "x", 1.0), (None, "a", 1.0), (4, None, 1.0), (4, "a", 2.0)]
    feats = [("a", 0, 1.0), ("a", 2, 4.0), ("b", 0, 3.0), ("b", 1, None)]
    comp = spark.createDataFrame(comp, "sample_id long, element string, share double")
    feats = spark.createDataFrame(feats, FEATURE)
    weighted = C.WeightedMatrix.of(comp, feats)
    want = {r["sample_id"]: r["features"] for r in C.feature_array(
        C.weighted_features(comp, feats)).collect()}
    got = {r["sample_id"]: r["features"] for r in weighted.arrays().collect()}
    assert got == want and not weighted.dense
    assert {r["sample_id"] for r in weighted.known().packed.collect()} == set(want)


def test_model_rows_are_written_as_shares(spark, tmp_path):
    path = folder(spark, tmp_path)
    before = set(written_tables())
    rows = Q._model_rows(spark, path)
    size = sum(os.path.getsize(os.path.join(d, f)) for p in set(written_tables()) - before
               for d, _, files in os.walk(p.removeprefix("file:")) for f in files if f.endswith(".parquet"))
    from stoich.plans.q_results import _wf_rounded
    want = {r["sample_id"]: r["features"] for r in C.feature_array(_wf_rounded(spark, path)).collect()}
    got = {r["sample_id"]: r["features"] for r in rows.collect()}
    assert set(got) == {s for s in want if s % 2 == 0} and all(got[s] == want[s] for s in got)
    assert size < len(got) * 64 * 8 / 2         # not the features themselves


def test_robust_fit_of_arrays_is_that_of_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(rng.integers(0, 5)), float(v), 7.0, None]) for i, v in enumerate(rng.normal(size=303))]
    arrays = spark.createDataFrame(rows, "id long, features array<double>")
    long = arrays.selectExpr("id", "posexplode(features) AS (feature_id, value)")
    middle, width = N.robust_fit_arrays(arrays, "id", "features", 4)
    want = {r["feature_id"]: (r["median"], r["scale"]) for r in N.robust_fit(long).collect()}
    for f in range(3):
        assert (middle[f], width[f]) == pytest.approx(want[f], rel=1e-12)
    assert middle[3] is None and width[3] == 1.0


def test_local_grid_is_the_distinct_walks(spark, monkeypatch):
    from stoich.operators import candidates as CA
    lo, hi = [0.2, 0.2, 0.0], [0.6, 0.6, 0.4]
    points = spark.createDataFrame([(i, [0.3 + 0.01 * (i % 3), 0.4, 0.3]) for i in range(12)],
                                   "id long, comp array<double>").repartition(2)
    want = {tuple(r["units"]) for r in CA.local_grid_walk(points, "id", "comp", lo, hi, per_point=50).collect()}
    for held in (CA.HELD, 10):
        monkeypatch.setattr(CA, "HELD", held)
        monkeypatch.setattr(CA, "GATHERED", 100)
        got = [tuple(r["units"]) for r in CA.local_grid(points, "id", "comp", lo, hi, per_point=50).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_class_fitness_of_several_panels_is_the_direct_one(spark, monkeypatch):
    from stoich.operators import crossval as CV
    from stoich.operators import subset as SS
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(240, 4)), rng.integers(0, 3, 240)
    x[:, 1] += y
    rows = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))],
                                 "id long, features array<double>, y long").repartition(3)
    data = CV.Folded.of(rows, "features", "y", "id", 4, 5, [0, 1])
    subsets = [("1", [1]), ("0*1", [0, 1]), ("1*2", [1, 2]), ("3", [3]), ("1", [1]), ("none", [])]
    frame = spark.createDataFrame(subsets, "key string, indices array<long>")
    monkeypatch.setattr(SS, "PANEL", 1)
    monkeypatch.setattr(SS, "KEPT", 2)
    got = {r["key"]: r for r in SS.class_fitness(frame, data, 3).collect()}
    assert set(got) == {"1", "0*1", "1*2", "3"}
    moments, scales = CV.fold_moments(data, 3), CV.robust_scales(data)
    for key, idx in subsets[:4]:
        coef = CV.coefficients(data, moments, scales, columns=idx)
        want = CV.class_scores(CV.class_counts(data, coef[None])).toPandas().mean()
        assert got[key]["accuracy"] == pytest.approx(want["accuracy"], rel=1e-12)
        assert got[key]["f1_weighted"] == pytest.approx(want["f1_weighted"], rel=1e-12)


def test_climbing_scores_every_composition_once(monkeypatch):
    from stoich.operators import search as SE
    rng = np.random.default_rng(4)
    features = rng.normal(size=(3, 2))
    limits = SE.Limits((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), step=0.01)
    model = SE.GrowingGP.of_features(features)
    for u in ([0.2, 0.3, 0.5], [0.6, 0.2, 0.2], [0.1, 0.8, 0.1]):
        model.add(np.array(u) @ features, float(rng.normal()))
    model.normalise()
    starts = np.array([[20 + i, 30, 50 - i] for i in range(8)])
    alone = [SE.climb(s[None], features, model, 0.5, limits, 6) for s in starts]
    seen = []
    predict = SE.GrowingGP.predict
    monkeypatch.setattr(SE.GrowingGP, "predict", lambda self, f: seen.append(len(f)) or predict(self, f))
    top, ei = SE.climb(starts, features, model, 0.5, limits, 6)
    together = sum(seen)
    seen.clear()
    for s in starts:
        SE.climb(s[None], features, model, 0.5, limits, 6)
    assert together < sum(seen)
    assert np.array_equal(top, np.concatenate([a[0] for a in alone]))
    assert np.allclose(ei, np.concatenate([a[1] for a in alone]))


def test_leaves_at_the_depth_limit_need_no_rows(spark, monkeypatch):
    """With every node above the bound no row leaves its block."""
    from stoich.operators import trees as TR
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 30, (400, 5)), rng.standard_normal(400)
    df = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "id long, features array<double>, y double")
    data = TR.binned(df, "features", "y", "id", 5)
    want = TR.fit_boosting(data, rounds=3, max_depth=2, l2=1.0)

    def no_rows(*_):
        raise AssertionError("rows were sent")

    monkeypatch.setattr(TR, "_finished", no_rows)
    got = TR.fit_boosting(data, rounds=3, max_depth=2, l2=1.0, bound=1)
    codes = np.ascontiguousarray(TR._codes(x.astype(float), data.edges))
    assert np.allclose(got.margins(codes), want.margins(codes))
    assert np.array_equal(got.margins(np.asfortranarray(codes)), got.margins(codes))


@pytest.mark.parametrize("k", [1, 3])
def test_finished_trees_are_kept_as_splits_and_leaf_values(k):
    """the same predictions and gains from less than half the bytes."""
    from stoich.operators import trees as TR
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 99, (300, 6)).astype(np.uint8)
    y = rng.standard_normal((300, 1)) if k == 1 else np.eye(k)[rng.integers(0, k, 300)]
    tree = TR.grow(codes, y, rng.integers(1, 4, 300).astype(float), 3, np.ones(6, bool), TR.Growth())
    blob = tree.to_leaves(6)
    again, gain = TR.Tree.from_leaves(blob)
    assert np.array_equal(again.value[again.leaf(codes)], tree.value[tree.leaf(codes)])
    assert np.array_equal(gain, tree.importance(6)) and 2 * len(blob) < len(tree.to_bytes())


def test_knn_queries_travel_once_per_shelf(spark, monkeypatch):
    """a query's vector is written once per shelf, not once per block."""
    from stoich.operators import neighbors as K
    monkeypatch.setattr(K, "SHELF_ROWS", 150)
    monkeypatch.setattr(K, "SLAB_QUERIES", 20)
    rng = np.random.default_rng(7)
    tr, q = np.round(rng.normal(size=(600, 6)), 1), np.round(rng.normal(size=(70, 6)), 1)
    tdf = spark.createDataFrame([(i, [float(v) for v in r], float(i)) for i, r in enumerate(tr)],
                                "id long, features array<double>, y double").repartition(3)
    qdf = spark.createDataFrame([(i + 5000, [float(v) for v in r]) for i, r in enumerate(q)],
                                "id long, features array<double>").repartition(2)
    search = K.KnnSearch(tdf, "id", "features", "y", 16)
    before = set(written_tables())
    found, met = search.nearest(qdf, "id", "features", 5)
    got = {}
    for r in found.collect():
        got.setdefault(r._id, []).append((r._d, r._tid))
    for i, qq in enumerate(q):
        d = np.sqrt(((tr - qq) ** 2).sum(1))
        assert sorted(got[i + 5000]) == [(d[j], j) for j in np.lexsort((np.arange(600), d))[:5]]
    shelves = len(search.shelves) - 1
    sent = [t for t in (spark.read.parquet(p) for p in set(written_tables()) - before) if "qx" in t.columns]
    vectors = sum(t.selectExpr("coalesce(sum(octet_length(qx)), 0) AS b").first().b for t in sent) / (6 * 8)
    meetings = sum(r.queries for r in met.collect())
    assert 1 < shelves <= 6 and len(sent) == 2 and vectors <= 2 * shelves * len(q)
    assert meetings > 2 * vectors           # a vector per meeting before


def test_signature_of_packed_shares_is_that_of_rows(spark):
    rows = [(1, "a", 0.25), (1, "b", 0.75), (2, "b", None), (3, "c", -0.0), (3, "a", 1 / 3), (4, "x", 0.5), (4, "c", 0.5)]
    comp = spark.createDataFrame(rows, "sample_id long, element string, share double")
    want = {r["sample_id"]: r["signature"] for r in C.signature(comp, ["a", "b", "c"]).collect()}
    got = {r["sample_id"]: r["signature"] for r in C.signature_of_parts(C.pack_shares(comp), ["a", "b", "c"]).collect()}
    assert got == want and got[1] == "0.25000000|0.75000000|0.00000000"


def test_group_folds_compute_no_features(spark, tmp_path, monkeypatch):
    """the groups come from the written shares; no feature is computed."""
    from stoich.plans import q_ml as ML
    path = folder(spark, tmp_path)
    want = {r["sample_id"] for r in Q._model_rows(spark, path).select("sample_id").collect()}
    sig = {r["sample_id"]: r["signature"] for r in C.signature(ML._shares(spark, path), ML.ALL_BRANDS).collect()}

    def none(*_, **__):
        raise AssertionError("features computed")

    monkeypatch.setattr(C.WeightedMatrix, "arrays", none)
    got = ML.g5_group_kfold(spark, path).collect()
    assert {r["sample_id"] for r in got} == want and all(r["signature"] == sig[r["sample_id"]] for r in got)
    assert len({(r["signature"], r["fold"]) for r in got}) == len({r["signature"] for r in got})


def test_folded_rows_write_no_features(spark, tmp_path):
    """The table that all passes read holds shares and folds."""
    path = folder(spark, tmp_path)
    before = set(written_tables())
    data = Q._folded(spark, path, [0, 1])
    written = [spark.read.parquet(p) for p in set(written_tables()) - before]
    assert not any("features" in t.columns for t in written)
    from stoich.operators import crossval as CV
    plain = CV.Folded(data.rows, data.d, data.k, data.seeds)        # counts and samples the rows themselves
    assert np.array_equal(CV.robust_scales(data), CV.robust_scales(plain))


def test_robust_fit_samples_before_features(spark, tmp_path, monkeypatch):
    """neither the count nor the sample for the cuts computes the features
    of all rows."""
    from stoich.operators import scaling
    seen = []
    fit = scaling.robust_fit_arrays

    def watched(*args):
        seen.append(args[4])
        return fit(*args)

    monkeypatch.setattr(scaling, "robust_fit_arrays", watched)
    path = folder(spark, tmp_path)
    got = {r["sample_id"]: r["features"] for r in Q._model_rows(spark, path, robust=True).collect()}
    n, sample = seen[0]
    assert n == 400 and sample.count() == 400
    from stoich.plans.q_results import _wf_rounded
    want = C.feature_array(N.robust_scale(_wf_rounded(spark, path)).selectExpr("sample_id", "feature_id", "scaled AS value"))
    want = {r["sample_id"]: r["features"] for r in want.collect()}
    assert got and all(np.allclose(got[s], want[s], rtol=1e-12, atol=1e-12) for s in got)


def test_normaliser_takes_each_step_once(spark):
    """a step's input is computed once, not once for every way through
    the later steps, and the results are those of the plain steps."""
    import unicodedata

    from pyspark.sql import functions as F

    from stoich.functions import text as X

    rows = [(i, chr(i) + "e" + chr(i)) for i in range(1, 0x800)]
    rows += [(-1, None), (-2, ""), (-3, "café ’ 中文가́"), (-4, "soft­hyphen é"), (-5, "क़​ x　")]
    df = spark.createDataFrame(rows, "i long, t string")
    out = df.select("i", "t", X.normalise_text(F.col("t")).alias("n"), X.strip_py(F.col("t")).alias("s"),
                    X.word_tokens(F.col("t")).alias("w"), F.regexp_extract_all("t", F.lit(X.TOKEN_PATTERN), 0).alias("w0"),
                    F.regexp_replace(F.regexp_replace("t", X.WS_CLASS, " "), X.DROP_CLASS, "").alias("c"))
    plan = df.select(X.normalise_text(F.col("t")).alias("n"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") <= 7
    pad = spark.createDataFrame([(r["i"], r["c"]) for r in out.collect()], "i long, c string")
    want = {r["i"]: None if r["p"] is None else "".join(c for c in unicodedata.normalize("NFD", r["p"]) if unicodedata.category(c) != "Mn")
            for r in pad.select("i", F.regexp_replace("c", X.CJK_CLASS, " $0 ").alias("p")).collect()}
    for r in out.collect():
        assert r["n"] == want[r["i"]], ascii(r)
        assert r["s"] == (None if r["t"] is None else r["t"].strip()), ascii(r)
        assert r["w"] == r["w0"], ascii(r)

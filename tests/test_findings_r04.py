"""Findings of round 4: the mended steps on small tables built here."""
import numpy as np
import pytest


def rows_of(spark, n, d, seed, levels=30):
    """Rows (id, features, y) of whole-number features."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, levels, (n, d))
    y = 3.0 * (x[:, 0] > levels // 2) + x[:, 1] / 10 + rng.normal(size=n)
    return spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))],
                                 "id long, features array<double>, y double").repartition(3)


def test_a_model_that_fails_fails_the_comparison(spark):
    """no row without figures stands for a model that failed."""
    from stoich.operators import registry as RG
    df = rows_of(spark, 60, 2, 1)
    split = RG.Split.of(df, "features", "y", "id", 2, df.id % 5 == 0)

    def broken(_):
        raise ValueError("out of luck")

    good = lambda s: s.test.selectExpr("count(*) AS n", "0.5D AS mae", "0.5D AS r2")
    with pytest.raises(RuntimeError, match="broken failed: ValueError: out of luck"):
        RG.compare_models(split, {"good": good, "broken": broken})
    with pytest.raises(RuntimeError, match="empty returned no figures"):
        RG.compare_models(split, {"empty": lambda s: good(s).where("false")})
    assert [tuple(r) for r in RG.compare_models(split, {"good": good}).collect()] == [("good", 12, 0.5, 0.5)]


@pytest.mark.parametrize("n_features,classes", [(None, 0), (2, 3)])
def test_whole_trees_in_tasks_are_those_of_the_nodes(spark, n_features, classes):
    """trees grown whole by one task each; no row is sent to a node."""
    from stoich.operators import trees as TR
    rng = np.random.default_rng(4)
    x = rng.integers(0, 30, (260, 6))
    y = (x[:, 0] + x[:, 1] > 30).astype(int) + (x[:, 2] > 20) if classes else x[:, 0] * 3 + rng.integers(0, 9, 260)
    df = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "id long, features array<double>, y double").repartition(3)
    data = TR.binned(df, "features", "y", "id", 6, classes=classes)
    n = spark.sparkContext.defaultParallelism + 3
    values = lambda f: np.array([r["values"] for r in f.predict(df, "features").orderBy("id").collect()])
    parts = TR.fit_forest(data, n, n_features=n_features, bound=10_000)
    whole = TR.fit_forest(data, n, n_features=n_features)
    assert isinstance(whole, TR.WholeForest) and not isinstance(parts, TR.WholeForest)
    assert np.allclose(values(parts), values(whole)) and np.allclose(parts.importance(), whole.importance())
    assert "below" not in whole.__dict__            # no tree was written
    assert whole.predict(df, "features").columns == parts.predict(df, "features").columns
    assert whole.predict(df.where("false"), "features").count() == 0
    assert whole.below.count() == n and np.allclose(values(parts), values(whole))


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    """beyond the bound the rows of a node go to a task as before."""
    from stoich.operators import trees as TR
    data = TR.binned(rows_of(spark, 200, 3, 2), "features", "y", "id", 3)
    monkeypatch.setattr(TR, "WHOLE_BYTES", 200)
    assert data.whole is None and not isinstance(TR.fit_forest(data, 40), TR.WholeForest)


@pytest.mark.parametrize("changed", [{}, {"subsample": 0.7, "columns": 0.7, "validation": 0.2, "patience": 16, "rounds": 80, "rate": 0.5, "min_leaf": 12}])
def test_boosting_in_one_task_is_that_over_the_blocks(spark, changed):
    """the same trees and the same stop."""
    from stoich.operators import trees as TR
    df = rows_of(spark, 300, 4, 5)
    data = TR.binned(df, "features", "y", "id", 4)
    how = {"rounds": 10, "rate": 0.2, "max_depth": 3, "l2": 1.0, **changed}
    one, parts = TR.fit_boosting(data, **how), TR.fit_boosting(data, **how, bound=60)
    assert len(one.trees) == len(parts.trees) and np.allclose(one.loss, parts.loss)
    got, want = ([r["prediction"] for r in m.predict(df, "features").orderBy("id").collect()] for m in (one, parts))
    assert np.allclose(got, want)


def test_deep_growth_is_the_same_for_every_split_of_the_work(monkeypatch):
    """histograms with sibling sums, and rows kept in order, give the same tree."""
    from stoich.operators import trees as TR
    rng = np.random.default_rng(8)
    codes, y = rng.integers(0, 200, (3000, 5)).astype(np.uint8), rng.integers(0, 1000, (3000, 1)).astype(float)
    w = rng.integers(1, 4, 3000).astype(float)
    for how in (TR.Growth(), TR.Growth(2, 3), TR.Growth(None, 1, 5, 1.0, True)):
        got = []
        for small, most, once in ((128, 2048, 2048), (1, 1, 0), (5000, 5000, 2048), (20, 60, 10)):
            monkeypatch.setattr(TR, "SMALL_NODE", small)
            monkeypatch.setattr(TR, "SMALL_ROWS", most)
            monkeypatch.setattr(TR, "SUMMED_AT_ONCE", once)
            got.append(TR.grow(codes, y, w, 3, np.ones(5, bool), how))
        for tree in got[1:]:
            assert np.array_equal(tree.feature, got[0].feature) and np.array_equal(tree.threshold, got[0].threshold)
            assert np.allclose(tree.value, got[0].value)


def test_tuning_grows_a_tree_once_for_all_depths(spark):
    """F8: the sums of every trial are those of its own forests."""
    from stoich.operators import trees as TR
    from stoich.operators import tuning as TU
    data = TR.binned(rows_of(spark, 900, 4, 9), "features", "y", "id", 4)
    groups = {(3, 20): [2, 5], (1, 20): [5], (2, 30): [3], (None, 60): [12]}     # no leaf so small that cuts tie
    whole = TU.whole_fold_sums(data, groups, 4, [0, 2])
    for (depth, leaf), sizes in groups.items():
        want = TU.fold_sums(data, sizes, depth, leaf, 4, [0, 2], bound=10_000)
        assert whole[depth, leaf].keys() == want.keys()
        assert all(np.allclose(whole[depth, leaf][key], want[key]) for key in want)


def test_class_picks_of_one_product_are_the_direct_ones(monkeypatch):
    """also for rows with values that are not finite, repeated features and ties."""
    from stoich.operators import subset as SS
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(90, 5)), np.sort(rng.integers(0, 4, 90))
    x[3, 1], x[7, 0], x[8, 4] = np.nan, np.inf, -np.inf
    idx = np.array([[0, 1], [2, 2], [4, 3]])
    coef = rng.normal(size=(3, 4, 3))
    coef[1, 2] = coef[1, 0]                         # a tie: the first class
    calls = []
    picked = SS._picked
    monkeypatch.setattr(SS, "_picked", lambda x, *a: calls.append(len(x)) or picked(x, *a))
    monkeypatch.setattr(SS, "ROWS_AT_ONCE", 20)
    told, hits = np.zeros((3, 4), np.int64), np.zeros((3, 4), np.int64)
    SS._count_picks(x, y, idx, coef, told, hits)
    want = picked(x, idx, coef)
    assert calls == [3]
    for c in range(4):
        assert (told[:, c] == (want == c).sum(axis=1)).all()
        assert (hits[:, c] == ((want == c) & (y == c)).sum(axis=1)).all()

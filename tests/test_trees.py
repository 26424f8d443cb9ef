"""Forests and boosting: the distributed steps against the local ones, a plain
recursive tree, and a direct boosting loop."""
import numpy as np
import pytest

from stoich.operators import trees as TR


def plain_tree(x, y, w, how, idx=None, depth=0):
    """A recursive tree over raw values (x <= cut goes left)."""
    idx = np.arange(len(x)) if idx is None else idx
    total, s = w[idx].sum(), (w[idx, None] * y[idx]).sum(axis=0)
    node = {"value": s / (total + how.l2)}
    spread = (w[idx, None] * y[idx] ** 2).sum() - (s ** 2).sum() / total
    if spread <= 1e-9 or (how.max_depth is not None and depth >= how.max_depth):
        return node
    best = None
    for f in range(x.shape[1]):
        for cut in np.unique(x[idx, f])[:-1]:
            low, high = idx[x[idx, f] <= cut], idx[x[idx, f] > cut]
            if min(w[low].sum(), w[high].sum()) < how.min_leaf:
                continue
            score = sum(((w[p, None] * y[p]).sum(axis=0) ** 2).sum() / (w[p].sum() + how.l2) for p in (low, high))
            if best is None or score > best[0] + 1e-9:
                best = (score, f, cut, low, high)
    if best is None or (how.must_gain and best[0] <= (s ** 2).sum() / (total + how.l2) + 1e-12):
        return node
    _, f, cut, low, high = best
    node.update(f=f, cut=cut, low=plain_tree(x, y, w, how, low, depth + 1),
                high=plain_tree(x, y, w, how, high, depth + 1))
    return node


def plain_value(node, row):
    while "f" in node:
        node = node["low"] if row[node["f"]] <= node["cut"] else node["high"]
    return node["value"]


def table(spark, x, y):
    rows = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, features array<double>, y double").repartition(3)


@pytest.mark.parametrize("max_depth,min_leaf,l2", [(None, 1, 0.0), (3, 1, 0.0), (None, 4, 1.0)])
def test_local_growth_is_the_plain_tree(max_depth, min_leaf, l2):
    rng = np.random.default_rng(1)
    for _ in range(25):
        n, d, k = int(rng.integers(1, 60)), int(rng.integers(1, 4)), int(rng.integers(1, 3))
        x = rng.integers(0, int(rng.integers(2, 12)), (n, d))
        y, w = rng.integers(0, 20, (n, k)).astype(float), rng.integers(1, 4, n).astype(float)
        how = TR.Growth(None, min_leaf, max_depth, l2)
        tree = TR.grow(x.astype(np.uint8), y, w, 3, np.ones(d, bool), how)
        want = plain_tree(x, y, w, how)
        assert np.allclose(tree.value[tree.leaf(x.astype(np.uint8))], [plain_value(want, r) for r in x])
        again = TR.Tree.from_bytes(tree.to_bytes())
        assert all(np.array_equal(getattr(tree, a), getattr(again, a))
                   for a in ("feature", "threshold", "left", "value", "gain"))


@pytest.mark.parametrize("bound", [10_000, 40, 1])
def test_one_tree_whatever_the_bound(spark, bound):
    """Every node finished in one task, some of them, or none."""
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 40, (220, 5)), rng.integers(0, 50, 220)
    data = TR.binned(table(spark, x, y), "features", "y", "id", 5)
    forest = TR.fit_forest(data, 1, bootstrap=False, bound=bound)
    want = plain_tree(x, y[:, None].astype(float), np.ones(220), TR.Growth())
    out = {r.id: r.values for r in forest.predict(table(spark, x, y), "features", "values").collect()}
    assert len(out) == 220 and all(np.isclose(out[i][0], plain_value(want, x[i])[0]) for i in range(220))


def test_leaves_are_pure(spark):
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((300, 4)), rng.standard_normal(300)
    data = TR.binned(table(spark, x, y), "features", "y", "id", 4)
    out = TR.fit_forest(data, 1, bootstrap=False, bound=50).predict(table(spark, x, y), "features", "v").collect()
    codes = {}
    for r in out:
        codes.setdefault(tuple(np.round(r.v, 9)), []).append(r.y)
    assert np.mean([abs(r.v[0] - r.y) for r in out]) < 0.05     # only rows of equal bins share a leaf


@pytest.mark.parametrize("n_features,classes", [(None, 0), (2, 3)])
def test_forest_does_not_depend_on_the_bound_or_the_path(spark, n_features, classes):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 30, (260, 6))
    y = (x[:, 0] + x[:, 1] > 30).astype(int) + (x[:, 2] > 20) if classes else x[:, 0] * 3 + rng.integers(0, 9, 260)
    df = table(spark, x, y)
    data = TR.binned(df, "features", "y", "id", 6, classes=classes)
    got = []
    for bound, model_bytes in ((10_000, TR.MODEL_BYTES), (30, TR.MODEL_BYTES), (30, 0)):
        forest = TR.fit_forest(data, 7, n_features=n_features, bound=bound)
        rows = forest.predict(df, "features", "values", model_bytes).orderBy("id").collect()
        got.append(np.array([r.values for r in rows]))
        imp = forest.importance()
        assert np.isclose(imp.sum(), 1) and imp[0] > imp[5]
    assert np.allclose(got[0], got[1]) and np.allclose(got[1], got[2])
    if classes:
        assert (got[0].argmax(axis=1) == y).mean() > 0.95 and np.allclose(got[0].sum(axis=1), 1)


def test_bootstrap_weights_are_poisson():
    w = np.concatenate([TR.bootstrap_weights(np.arange(20_000), 1, t) for t in range(5)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and abs((w == 0).mean() - np.exp(-1)) < 0.01


@pytest.mark.parametrize("bound", [10_000, 60])
def test_boosting_is_the_direct_loop(spark, bound):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 50, (500, 4))
    y = x[:, 0] + 10.0 * (x[:, 1] > 25) + rng.integers(0, 5, 500)
    df = table(spark, x, y)
    data = TR.binned(df, "features", "y", "id", 4)
    how = TR.Growth(None, 1, 3, 1.0, True)
    margin, seen = np.full(500, y.mean()), []
    for _ in range(20):
        tree = plain_tree(x, (y - margin)[:, None], np.ones(500), how)
        margin = margin + 0.2 * np.array([plain_value(tree, r)[0] for r in x])
        seen.append(((y - margin) ** 2).mean())
    model = TR.fit_boosting(data, 20, 0.2, 3, l2=1.0, bound=bound)
    out = model.predict(df, "features").orderBy("id").collect()
    assert len(model.trees) == 20 and np.allclose([r.prediction for r in out], margin, atol=1e-6)
    assert all(b <= a + 1e-9 for a, b in zip(seen, seen[1:]))


def test_boosting_stops_early(spark):
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((400, 3)), rng.standard_normal(400)
    data = TR.binned(table(spark, x, y), "features", "y", "id", 3)
    model = TR.fit_boosting(data, 200, 0.5, 4, subsample=0.7, columns=0.7, validation=0.2, patience=16)
    assert len(model.trees) < 100 and 3 <= len(model.loss) <= 12


def test_awkward_training_tables(spark):
    rows = [(i, [float(i % 7), None if i % 5 == 0 else float("nan") if i % 5 == 1 else 1.0 * i, 2.0], 1.0 * (i % 3))
            for i in range(40)] + [(100, None, 1.0), (101, [1.0], 2.0), (102, [1.0, 2.0, 3.0], None),
                                   (103, [1.0, 2.0, 3.0], float("nan"))]
    df = spark.createDataFrame(rows, "id long, features array<double>, y double")
    data = TR.binned(df, "features", "y", "id", 3)
    assert data.n_rows == 42 and len(data.edges[2]) <= 2
    out = TR.fit_forest(data, 3).predict(df, "features", "v").collect()
    assert len(out) == 44 and all(np.isfinite(r.v[0]) for r in out)
    assert TR.fit_boosting(data, 3).predict(df, "features").count() == 44
    same = spark.createDataFrame([(i, [1.0], 1.0 * i) for i in range(9)], "id long, features array<double>, y double")
    flat = TR.fit_forest(TR.binned(same, "features", "y", "id", 1), 2, bootstrap=False, bound=2)
    assert all(r.v == [4.0] for r in flat.predict(same, "features", "v").collect())
    none = TR.binned(df.where("false"), "features", "y", "id", 3)
    for fit in (TR.fit_forest, TR.fit_boosting):
        with pytest.raises(ValueError):
            fit(none)


def test_forests_of_very_few_rows(spark):
    """Trees whose sample is empty do not count."""
    df = table(spark, [[1.0], [2.0]], [10.0, 12.0])
    data = TR.binned(df, "features", "y", "id", 1)
    for n in (1, 2, 30):
        out = TR.fit_forest(data, n, seed=n).predict(df, "features", "v").collect()
        assert all(10 <= r.v[0] <= 12 for r in out)

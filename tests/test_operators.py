"""Invariants, hand-made edge cases and brute-force comparisons."""
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stoich.functions import text as X
from stoich.operators import corpus as K
from stoich.operators import linear as L
from stoich.operators import sampling as S
from stoich.operators.neighbors import KnnSearch, knn_predict
from stoich.operators.ordering import global_rank, rank_within, running_max
from stoich.operators.quantiles import exact_quantiles


# -- text ---------------------------------------------------------------------

def _py_norm(s):
    out = []
    for ch in s:
        cp = ord(ch)
        if cp == 0 or cp == 0xFFFD or (unicodedata.category(ch).startswith("C") and ch not in "\t\n\r"):
            continue
        if ch in "\t\n\r" or unicodedata.category(ch) == "Zs" or ch in "  ":
            out.append(" ")
        else:
            out.append(ch)
    s = "".join(out)
    s = "".join(f" {c} " if 0x4E00 <= ord(c) <= 0x9FFF else c for c in s)
    s = unicodedata.normalize("NFD", s)
    return "".join(c for c in s if unicodedata.category(c) != "Mn")


EDGE_TEXT = ["été", "été", "中文a", "a\tb", "a\x00b", "x�y", "zero​width",
             " pad ", "", "   ", "한국어", "Ångström ǅ", "line sep"]


def test_normalise_matches_python_reference(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGE_TEXT)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", X.normalise_text(F.col("t")).alias("n")).collect()}
    for i, t in enumerate(EDGE_TEXT):
        assert got[i] == _py_norm(t), (t, got[i], _py_norm(t))


def test_strip_matches_python(spark):
    vals = ["  a b  ", " x　", "\x1cy\x1f", "​z​", ""]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    got = [r.s for r in df.select(X.strip_py(F.col("t")).alias("s")).collect()]
    assert got == [v.strip() for v in vals]


def test_element_name(spark):
    df = spark.createDataFrame([(" ti%",), ("AL",), ("nb ",), ("%",)], "t string")
    got = [r.n for r in df.select(X.element_name(F.col("t")).alias("n")).collect()]
    assert got == ["Ti", "Al", "Nb", ""]


# -- packing ------------------------------------------------------------------

def _blocks_by_rule(lengths, tokens, full=512):
    """The packing rule, one token at a time: a block opens with CLS; a slot
    is kept for the SEP that ends every piece of a line; a line that does not
    fit goes on in the next block; empty lines leave no trace."""
    blocks, block = [], []

    def close():
        blocks.append(list(block))
        block.clear()

    token = iter(tokens)
    for n in lengths:
        for _ in range(n):
            if len(block) == full - 1:
                block.append(K.SEP_ID)
                close()
            if not block:
                block.append(K.CLS_ID)
            block.append(next(token))
        if n:
            block.append(K.SEP_ID)
            if len(block) == full:
                close()
    if block:
        close()
    return blocks


@pytest.mark.parametrize("lengths", [[0, 1, 509, 510, 511, 1100], [509, 1, 3], [510, 510, 2],
                                     [1] * 700, [1100, 0, 0, 5, 509, 509, 1]])
def test_pack_matches_greedy_loop(spark, lengths):
    rows, toks = [], []
    tid = 10
    for k, r in enumerate(lengths):
        rows.append(("train", 0, k, list(range(tid, tid + r))))
        toks += rows[-1][3]
        tid += r
    encoded = spark.createDataFrame(rows, "split string, doc_id long, line_no long, ids array<int>")
    got = K.pack_sequences(encoded, pad_ids=False).orderBy("block_no").collect()
    assert [list(r.input_ids) for r in got] == _blocks_by_rule(lengths, toks)
    assert [i for r in got for i in r.input_ids if i >= 10] == toks
    assert all(r.input_ids[0] == K.CLS_ID and r.input_ids[-1] == K.SEP_ID for r in got)
    assert all(len(r.input_ids) == 512 for r in got[:-1])
    for r in got:
        assert sum(r.attention_mask) == len(r.input_ids) and len(r.attention_mask) == 512


# -- ranks, quantiles, running max ---------------------------------------------

def test_ranks_are_exact_with_a_hot_group(spark):
    pdf = pd.DataFrame({"g": ["hot"] * 3000 + [f"g{i}" for i in range(300)],
                        "v": np.random.default_rng(1).normal(size=3300)})
    df = spark.createDataFrame(pdf).repartition(7)
    r = rank_within(df, ["g"], [F.col("v")]).toPandas()
    exp = pdf.assign(rank=pdf.groupby("g")["v"].rank(method="first").astype(int) - 1)
    m = r.merge(exp, on=["g", "v"])
    assert (m["rank_x"] == m["rank_y"]).all() and len(m) == 3300
    gr = global_rank(df, [F.col("v")]).toPandas()
    assert sorted(gr["rank"]) == list(range(3300))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": ["a"] * 1001 + ["b"] * 10, "v": rng.normal(size=1011)})
    ties = pd.DataFrame({"g": "ties", "v": rng.integers(0, 5, 3000).astype(float)})
    hot = pd.DataFrame({"g": "hot", "v": [7.0] * 2000 + [1e300, -1e300] + rng.normal(7, 1e-9, 500).tolist()})
    one = pd.DataFrame({"g": ["one", None, None, None], "v": [3.5, -0.0, 0.0, None]})
    pdf = pd.concat([pdf, ties, hot, one], ignore_index=True)
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    df = spark.createDataFrame([(r.g, None if pd.isna(r.v) else r.v) for r in pdf.itertuples()], "g string, v double")
    got = {(r.g, r.q): r.quantile for r in exact_quantiles(df.repartition(7), ["g"], "v", qs).collect()}
    want = {(g, q): np.quantile(v.dropna(), q) for g, v in [
        (None if pd.isna(k) else k, x.v) for k, x in pdf.groupby("g", dropna=False)] for q in qs}
    assert got.keys() == want.keys()
    assert all(np.isclose(got[k], want[k], rtol=1e-12, atol=1e-12) for k in want)
    whole = exact_quantiles(df, [], "v", [0.5]).collect()
    assert len(whole) == 1 and whole[0].quantile == np.quantile(pdf.v.dropna(), 0.5)
    assert exact_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_fixed_point_sum_of_large_and_many_terms(spark):
    from stoich.operators.composition import fixed_point_sum
    df = spark.createDataFrame([(1, 1.5e7), (2, 1e8), (2, 1e15), (3, -2.25), (3, 0.5), (4, 9e18)], "k int, x double")
    got = {r.k: r.s for r in df.groupBy("k").agg(fixed_point_sum(F.col("x")).alias("s")).collect()}
    assert got == {1: 1.5e7, 2: 1e15 + 1e8, 3: -1.75, 4: 9e18}
    many = spark.range(200_000).select(fixed_point_sum(F.lit(1e8) + 0.25).alias("s")).first().s
    assert many == 200_000 * (1e8 + 0.25)


def test_running_max_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"run": rng.integers(0, 3, 2000), "rnd": np.arange(2000), "y": rng.normal(size=2000)})
    got = running_max(spark.createDataFrame(pdf).repartition(5), ["run"], [F.col("rnd")], "y").toPandas()
    exp = pdf.sort_values("rnd").assign(best=lambda d: d.groupby("run")["y"].cummax())
    m = got.merge(exp, on=["run", "rnd"])
    assert np.allclose(m["running_max"], m["best"])


# -- sampling and folds --------------------------------------------------------

def test_hash_rank_independent_of_partitioning(spark):
    base = spark.range(5000).withColumnRenamed("id", "k")
    outs = []
    for n in (1, 4, 16):
        f = S.kfold(base.repartition(n), 10, "s", "k").orderBy("k").toPandas()
        outs.append(f["fold"].tolist())
    assert outs[0] == outs[1] == outs[2]
    sizes = pd.Series(outs[0]).value_counts().sort_index().tolist()
    assert sizes == [500] * 10


def test_kfold_sizes_uneven(spark):
    f = S.kfold(spark.range(23).withColumnRenamed("id", "k"), 10, "s", "k").toPandas()
    assert f["fold"].value_counts().sort_index().tolist() == [3, 3, 3] + [2] * 7


def test_exact_sample_count(spark):
    df = spark.range(1234).withColumnRenamed("id", "k")
    assert S.exact_sample(df, 100, "x", "k").count() == 100
    assert S.exact_sample(df, 5000, "x", "k").count() == 1234


def test_mutate_keeps_distinct(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    p = S.init_population(df, "k", 20, 8)
    m = p.select(S.mutate(F.col("indices"), F.col("k"), 0.5, 20).alias("m")).collect()
    for r in m:
        assert len(set(r.m)) == 8 and all(0 <= x < 20 for x in r.m)


# -- models ------------------------------------------------------------------

def test_ridge_from_stats_matches_normal_equations(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = x @ np.array([1.0, -2.0, 0.5]) + 3 + rng.normal(scale=0.1, size=400)
    pdf = pd.DataFrame({"g": 0, "features": list(x), "y": y})
    st = L.collect_stats(L.gram_stats(spark.createDataFrame(pdf), "features", "y", ["g"], 3), ["g"], 3)[(0,)]
    beta, b0 = L.ridge_fit(st, alpha=1.0)
    xc = x - x.mean(0)
    exp = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ (y - y.mean()))
    assert np.allclose(beta, exp) and abs(b0 - (y.mean() - x.mean(0) @ exp)) < 1e-9
    resid = y - x @ beta - b0
    assert abs(L.sse(st, beta, b0) - resid @ resid) < 1e-6


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    tr = rng.normal(size=(300, 4))
    q = np.vstack([rng.normal(size=(40, 4)), tr[:3]])
    ty = rng.normal(size=300)
    tdf = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "features": list(tr), "y": ty}))
    qdf = spark.createDataFrame(pd.DataFrame({"id": np.arange(43) + 1000, "features": list(q)}))
    got = knn_predict(qdf, tdf, k=5, block_rows=128).toPandas().set_index("id")["pred"]
    for i, qq in enumerate(q):
        d = np.sqrt(((tr - qq) ** 2).sum(1))
        o = np.lexsort((np.arange(300), d))[:5]
        exp = ty[o][d[o] == 0].mean() if (d[o] == 0).any() else (ty[o] / d[o]).sum() / (1 / d[o]).sum()
        assert abs(got[1000 + i] - exp) < 1e-9


def test_knn_meets_few_blocks_of_clustered_rows(spark):
    """Clusters, ties and copies: the same neighbours, a part of the meetings."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(12, 6)) * 20
    tr = np.round(centre[rng.integers(0, 12, 900)] + rng.normal(size=(900, 6)), 1)
    tr[100:140] = tr[7]
    q = np.vstack([np.round(centre[rng.integers(0, 12, 60)] + rng.normal(size=(60, 6)), 1), tr[5:9]])
    tdf = spark.createDataFrame([(i, [float(v) for v in r], float(i)) for i, r in enumerate(tr)],
                                "id long, features array<double>, y double").repartition(3)
    qdf = spark.createDataFrame([(i + 5000, [float(v) for v in r]) for i, r in enumerate(q)],
                                "id long, features array<double>").repartition(2)
    search = KnnSearch(tdf, "id", "features", "y", 40)
    found, met = search.nearest(qdf, "id", "features", 5)
    got = {}
    for r in found.collect():
        got.setdefault(r._id, []).append((r._d, r._tid))
    for i, qq in enumerate(q):
        d = np.sqrt(((tr - qq) ** 2).sum(1))
        o = np.lexsort((np.arange(900), d))[:5]
        assert sorted(got[i + 5000]) == [(d[j], j) for j in o]
    assert search.n_blocks > 12 and sum(r.queries for r in met.collect()) < 0.5 * len(q) * search.n_blocks
    none = KnnSearch(tdf.limit(0), "id", "features", "y").nearest(qdf, "id", "features", 5)[0]
    few = KnnSearch(tdf.limit(3), "id", "features", "y", 1).nearest(qdf.limit(2), "id", "features", 5)[0]
    assert none.count() == 0 and few.count() == 6


def test_register_known_rejects_duplicates(spark):
    from stoich.plans.q_sampling import register_known
    h = spark.createDataFrame([("a",), ("b",)], "comp_key string")
    with pytest.raises(ValueError):
        register_known(h, spark.createDataFrame([("b",)], "comp_key string"))
    assert register_known(h, spark.createDataFrame([("c",)], "comp_key string")).count() == 3


# -- group folds, candidates --------------------------------------------------

def _greedy_group_folds(sizes: dict, k: int) -> dict:
    """Direct restatement: groups by descending size (ties: descending id),
    each into the lightest fold (ties: lowest fold)."""
    kk = max(2, min(k, len(sizes)))
    loads = [0] * kk
    out = {}
    for g, s in sorted(sizes.items(), key=lambda t: (-t[1], -t[0])):
        f = min(range(kk), key=lambda i: (loads[i], i))
        loads[f] += s
        out[g] = f
    return out


def test_group_kfold_matches_greedy(spark):
    from stoich.operators.folds import group_kfold
    rng = np.random.default_rng(7)
    groups = np.concatenate([np.full(300, 0), rng.integers(1, 120, 700)])  # one hot group
    pdf = pd.DataFrame({"rid": np.arange(len(groups)), "g": groups})
    got = group_kfold(spark.createDataFrame(pdf), "g", 10, "rid").toPandas()
    assert got.groupby("g")["fold"].nunique().max() == 1          # a group never spans folds
    want = _greedy_group_folds(pdf.groupby("g").size().to_dict(), 10)
    assert {int(g): int(f) for g, f in got.groupby("g")["fold"].first().items()} == want


def test_projection_is_optimal(spark):
    """Feasible, and the distance to x is one number on free entries, at most
    that at a lower bound and at least that at an upper bound."""
    from stoich.operators.candidates import project_capped_simplex
    lo, hi = np.array([0.2, 0.2, 0.0, 0.0]), np.array([0.55, 0.55, 0.2, 0.2])
    rng = np.random.default_rng(8)
    xs = rng.uniform(0, 0.6, size=(200, 4))
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(200), "x": list(xs)}))
    got = df.select("i", project_capped_simplex(F.col("x"), lo, hi).alias("p")).toPandas().sort_values("i")
    for x, p in zip(xs, np.stack(got["p"])):
        assert abs(p.sum() - 1) < 1e-9 and (p >= lo).all() and (p <= hi).all()
        gap = x - p
        at_lo, at_hi = p <= lo + 1e-12, p >= hi - 1e-12
        free = ~at_lo & ~at_hi
        lam = gap[free].mean() if free.any() else (gap[at_lo].max() if at_lo.any() else gap[at_hi].min())
        assert np.allclose(gap[free], lam, atol=1e-9)
        assert (gap[at_lo & ~at_hi] <= lam + 1e-9).all() and (gap[at_hi & ~at_lo] >= lam - 1e-9).all()


def test_generated_compositions_feasible(spark):
    from stoich.operators import candidates as CA
    lo, hi = [0.20, 0.20, 0.0, 0.0, 0.0, 0.0], [0.55, 0.55, 0.20, 0.20, 0.10, 0.20]
    rows = spark.range(3000).withColumnRenamed("id", "k")
    for df in (CA.feasible_sample(rows, "k", lo, hi), CA.reject_sample(rows, "k", lo, hi),
               CA.substitution_sample(rows, "k", lo, hi, [0, 1, 1, 0, 1, 0], (0.45, 0.55))):
        comps = np.array([r.comp for r in df.collect()])
        assert len(comps) > 0
        assert np.all(np.abs(comps.sum(1) - 1) < 1e-3)
        assert np.all(comps >= np.array(lo) - 1e-9) and np.all(comps <= np.array(hi) + 1e-9)


def test_subset_fitness_matches_direct_solve(spark):
    from stoich.operators import subset as SS
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 6))
    y = x[:, 0] * 2 - x[:, 3] + rng.normal(size=300)
    pdf = pd.DataFrame({"k": np.arange(300), "features": list(x), "y": y})
    st = SS.fold_stats(spark.createDataFrame(pdf), "features", "y", 6, 5, [0, 1], "k")
    totals, folds = SS.split_stats(st)
    subs = spark.createDataFrame([(0, [0, 3]), (1, [1, 2, 5])], "sid int, indices array<long>")
    got = {r.sid: r.fitness for r in SS.subset_fitness(subs, totals, folds).collect()}
    for sid, idx in [(0, [0, 3]), (1, [1, 2, 5])]:
        exp = np.mean([L.pooled_r2(totals[r].select(idx), {f: s.select(idx) for f, s in folds[r].items()}, 1.0)
                       for r in totals])
        assert abs(got[sid] - exp) < 1e-10


def test_elastic_net_is_optimal(spark):
    """At the minimum the residual's correlation with a feature is alpha
    l1_ratio sign(b) + alpha (1 - l1_ratio) b, or within alpha l1_ratio at 0."""
    from stoich.operators import linear as L
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)) * [1, 2, 3, 1, 1, 0] + 5
    y = x @ np.array([1.5, 0.0, -2.0, 0.05, 0.0, 0.0]) + rng.normal(size=400)
    df = spark.createDataFrame([(int(i % 2), [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))],
                               "g int, features array<double>, y double").repartition(5)
    stats = L.collect_stats(L.gram_stats(df, "features", "y", ["g"], 6), ["g"], 6)
    total = stats[(0,)] + stats[(1,)]
    assert total.n == 400 and np.allclose(total.xtx, x.T @ x) and np.allclose(total.xty, x.T @ y)
    for alpha, ratio in ((0.1, 1.0), (0.3, 0.5), (1e9, 1.0)):
        beta, b0 = L.elastic_net_fit(total, alpha, ratio)
        pull = (x - x.mean(0)).T @ (y - x @ beta - b0) / 400 - alpha * (1 - ratio) * beta
        assert (np.abs(pull) <= alpha * ratio + 1e-7).all()
        assert np.allclose(pull[beta != 0], alpha * ratio * np.sign(beta[beta != 0]), atol=1e-7)
    ols, c0 = L.elastic_net_fit(total, 0.0, 1.0)
    assert np.allclose(x[:, :5] @ ols[:5] + c0, x[:, :5] @ np.linalg.lstsq(
        np.c_[x[:, :5], np.ones(400)], y, rcond=None)[0][:5] + np.linalg.lstsq(
        np.c_[x[:, :5], np.ones(400)], y, rcond=None)[0][5], atol=1e-6)

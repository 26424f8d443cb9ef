"""Island search against the DataFrame steps."""
import numpy as np
import pytest

from stoich.operators import crossval as CV
from stoich.operators import subset as SS
from stoich.operators.islands import search_islands

D = 12


@pytest.fixture(scope="module")
def sums(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((150, D))
    y = 2 * x[:, 2] - x[:, 7] + 0.5 * x[:, 9] + 0.3 * rng.standard_normal(150)
    rows = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, features array<double>, y double")
    return SS.folded_stats(CV.Folded.of(df, "features", "y", "id", D, 5, [0, 1]))


def test_islands_follow_the_dataframe_steps(spark, sums):
    totals, folds, scales = sums
    islands = spark.createDataFrame([("a", 3), ("b-1", 2)], "island string, f_n long")
    got = search_islands(islands, totals, folds, D, scales, n_pop=16, ngen=4).collect()
    for name, f_n in (("a", 3), ("b-1", 2)):
        _, dominants = SS.subset_search(spark, totals, folds, D, f_n, n_pop=16, ngen=4, seed=name, scales=scales)
        want = {r.generation: (r.key, r.fitness) for r in dominants.collect()}
        own = {r.generation: (r.key, r.fitness) for r in got if r.island == name}
        assert own.keys() == want.keys() and {g: k for g, (k, _) in own.items()} == {g: k for g, (k, _) in want.items()}
        assert all(np.isclose(own[g][1], want[g][1], rtol=1e-12) for g in want)


def test_islands_climb_and_repeat(spark, sums):
    totals, folds, scales = sums
    islands = spark.createDataFrame([(f"4-{i}", 3) for i in range(6)], "island string, f_n long")
    runs = [sorted(map(tuple, search_islands(islands.repartition(n), totals, folds, D, scales, n_pop=40, ngen=15).collect()))
            for n in (1, 4)]
    assert runs[0] == runs[1] and len(runs[0]) == 90
    by = {}
    for name, _, g, key, value in runs[0]:
        by.setdefault(name, []).append((g, value, key))
    for steps in by.values():
        values = [v for _, v, _ in sorted(steps)]
        assert all(b >= a for a, b in zip(values, values[1:]))
    best = max((v, k) for steps in by.values() for _, v, k in steps)
    assert best[1] == "2*7*9"


def test_islands_edges(spark, sums):
    totals, folds, scales = sums
    none = spark.createDataFrame([], "island string, f_n long")
    assert search_islands(none, totals, folds, D, scales, ngen=2).count() == 0
    with pytest.raises(Exception, match="1 to 12 features"):
        search_islands(spark.createDataFrame([("x", 13)], "island string, f_n long"), totals, folds, D, scales).count()
    full = spark.createDataFrame([("x", 12)], "island string, f_n long")
    assert {r.key for r in search_islands(full, totals, folds, D, scales, n_pop=8, ngen=3).collect()} == {
        "*".join(map(str, range(12)))}

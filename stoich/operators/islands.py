"""M13 at full size: many independent subset searches at once.

Every (subset size, trajectory) is an island: its population, memo and whole
loop of generations live in one task, on the broadcast fold sums, and islands
run side by side.  No Spark job per generation.  An island follows the same
draws as :func:`stoich.operators.subset.subset_search` with the same seed (the
hashes of :mod:`stoich.functions.rng`), so both give the same generations.

A population is bounded by its parameter; the memo of an island by population
times generations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoich.operators.subset import _prepare, batch_r2


def _uniform(*parts) -> float:
    return int(md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2 ** 32


def _shuffled(values: list[int], *parts) -> list[int]:
    prefix = "|".join(map(str, parts))
    return sorted(values, key=lambda x: (md5(f"{prefix}|{x}".encode()).hexdigest(), x))


def _subset(key: int, total: int, size: int, seed: str) -> list[int]:
    """A draw without replacement: the r-th index not drawn yet, ``size`` times."""
    drawn: list[int] = []
    for j in range(size):
        r = math.floor(_uniform(seed, key, j) * (total - j))
        drawn.append(r + sum(p - m <= r for m, p in enumerate(sorted(drawn))))
    return drawn


def _crossed(a: list[int], b: list[int], pair: int, prob: float, seed: str) -> tuple[list[int], list[int]]:
    common = sorted(set(a) & set(b))
    own_a = _shuffled([x for x in a if x not in common], f"{seed}-a", pair)
    own_b = _shuffled([x for x in b if x not in common], f"{seed}-b", pair)
    swap = [_uniform(seed, pair, t) < prob for t in range(max(len(own_a), len(own_b)))]
    new_a = [own_b[t] if swap[t] and t < len(own_b) else x for t, x in enumerate(own_a)]
    new_b = [own_a[t] if swap[t] and t < len(own_a) else x for t, x in enumerate(own_b)]
    return common + new_a, common + new_b


def _mutated(indices: list[int], rank: int, prob: float, total: int, seed: str) -> list[int]:
    hit = [i for i in range(len(indices)) if _uniform(seed, rank, i + 1) < prob]
    if not hit:
        return indices
    held = set(indices)
    pool = _shuffled([x for x in range(total) if x not in held], f"{seed}-pool", rank)
    out = list(indices)
    for i, x in zip(hit, pool):
        out[i] = x
    return out


class Island:
    """One search: individuals are (ind_id, indices), scored through a memo."""

    def __init__(self, prepared: list, total: int, f_n: int, seed: str, n_pop: int, cxpb: float, mutpb: float,
                 alpha: float):
        self.prepared, self.total, self.seed, self.alpha = prepared, total, seed, alpha
        self.n_pop, self.cxpb, self.mutpb = n_pop, cxpb, mutpb
        self.memo: dict[str, float] = {}
        self.pop = self.scored([(i, _subset(i, total, f_n, f"init-{seed}")) for i in range(n_pop)])

    def scored(self, individuals: list[tuple[int, list[int]]]) -> list[tuple[int, list[int], str, float]]:
        keys = ["*".join(map(str, sorted(x))) for _, x in individuals]
        fresh = {k: x for k, (_, x) in zip(keys, individuals) if k not in self.memo}
        if fresh:
            self.memo.update(zip(fresh, batch_r2(self.prepared, np.array(list(fresh.values())), self.alpha).tolist()))
        return [(i, x, k, self.memo[k]) for k, (i, x) in zip(keys, individuals)]

    def dominant(self) -> tuple[str, float]:
        best = max(self.pop, key=lambda r: (r[3], -r[0]))
        return best[2], best[3]

    def step(self, g: int) -> None:
        fitness = np.array([r[3] for r in self.pop])
        total = fitness.sum()
        p = fitness / total if total > 0 else fitness
        e = np.exp(p - p.max())
        prob = e / e.sum()
        order = sorted(range(len(self.pop)), key=lambda i: (
            -math.log(_uniform(f"sel-{self.seed}-{g}", 0, self.pop[i][0]) + 1e-300) / prob[i], self.pop[i][0]))
        chosen = [self.pop[i][1] for i in order[:self.n_pop // 2]]
        new: list[tuple[int, list[int]]] = []
        for pair in range(len(chosen) // 2):
            kids = _crossed(chosen[2 * pair], chosen[2 * pair + 1], pair, self.cxpb, f"cx-{self.seed}-{g}")
            new += [(2 * pair, kids[0]), (2 * pair + 1, kids[1])]
        new += [(self.n_pop + rank, _mutated(x, rank, self.mutpb, self.total, f"mut-{self.seed}-{g}"))
                for rank, x in enumerate(chosen)]
        offspring = self.scored([((g + 1) * 10 * self.n_pop + o, x) for o, x in new])
        both = [(-r[3], False, r[0], r) for r in self.pop] + [(-r[3], True, r[0], r) for r in offspring]
        self.pop = [r[3] for r in sorted(both, key=lambda r: r[:3])[:len(self.pop)]]


def search_islands(islands: DataFrame, totals: dict, folds: dict, total_features: int, scales: dict | None = None,
                   n_pop: int = 192, cxpb: float = 0.8, mutpb: float = 0.1, ngen: int = 100,
                   alpha: float = 1.0) -> DataFrame:
    """(island, f_n, generation, key, fitness): the dominant of every
    generation of every island; ``islands`` has (island, f_n), the island's
    name being its seed.  One partition per island, as far as 10,000 go."""
    n = max(1, islands.count())
    shared = islands.sparkSession.sparkContext.broadcast(_prepare(totals, folds, scales))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, f_n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not 0 < f_n <= total_features:
                    raise ValueError(f"island {name}: a subset has 1 to {total_features} features")
                island, best = Island(shared.value, total_features, f_n, name, n_pop, cxpb, mutpb, alpha), []
                for g in range(ngen):
                    best.append(island.dominant())
                    if g + 1 < ngen:
                        island.step(g)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * ngen), pa.array([f_n] * ngen, pa.int64()), pa.array(range(ngen), pa.int64()),
                     pa.array([k for k, _ in best]), pa.array([v for _, v in best], pa.float64())],
                    names=["island", "f_n", "generation", "key", "fitness"])

    spread = islands.select(F.col("island").cast("string"), F.col("f_n").cast("bigint")) \
        .repartitionByRange(min(n, 10_000), "island")
    return spread.mapInArrow(run, "island string, f_n long, generation long, key string, fitness double")

"""Forests and boosted trees grown by Spark over binned features (M1-M5).

Features are binned once into bytes (:func:`binned`): up to 256 bins of about
equal shares, one per value where a feature has no more.  Rows travel as packed
blocks (codes, targets, keys), so a pass over the table is a few numpy calls per
block.

**Forests** (:func:`fit_forest`) grow all trees at once without a depth limit.
A row's weight in a tree is a Poisson draw from the hash of (seed, tree, row
key).  Nodes with more than ``bound`` rows are split level by level: tasks add
up (node, feature, bin) histograms, these are added in two steps per node, and
the task that holds a node's sum picks its split.  The rows of every smaller
node are then shipped to one task, which finishes the node until its leaves are
pure (or the depth limit is reached).  Targets are vectors: one number for
regression, one indicator per class for classification (the variance of
indicators is Gini impurity).  Only the split nodes above the bound reach the
driver; finished nodes stay in a table, and prediction joins rows to them unless
the whole model is small enough to be broadcast.

**Boosting** (:func:`fit_boosting`) adds depth-limited trees one after another,
for squared loss, grown by the same two steps on the residuals.  Margins are a
column that is brought up to date every few rounds; the trees since then are
applied in the pass.  Row subsampling is a hash of (seed, round, row key), the
validation part for early stopping a hash of (seed, row key).

Rows without a target are not trained on; null and NaN features take the
lowest bin, in training and prediction alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stoich.session import cut_lineage

BINS = 256
SEED = 43
BLOCK_ROWS = 32_768
BOUND = 16_384                  # rows of a node that one task finishes
PART_CELLS = 8_000_000          # binned values per partition of the block table
LEAST_CELLS = 2_000_000         # the same where there are fewer partitions than cores
SMALL_TREE = 4_096              # nodes up to which a tree is applied to all rows at once
HELD_BYTES = 64 << 20           # histograms that a task holds back
MODEL_BYTES = 64 << 20          # largest forest that is broadcast
WHOLE_BYTES = 96 << 20          # largest binned table that is broadcast: a task then grows whole trees
SCORED_ROWS = 8_192             # rows whose scores travel together
FEW_ROWS = 1_000                # rows of which a sample may be empty
TREE_WIDTH = 64
UPDATE_ROUNDS = 16              # rounds between two updates of the margins
CHECK_ROUNDS = 8                # rounds between two looks at the validation part


# -- hashes --------------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(keys: np.ndarray, *salts: int) -> np.ndarray:
    """64-bit hash of every key and some numbers."""
    h = np.asarray(keys).astype(np.uint64)
    for s in salts:
        h = _mixed(h + np.uint64((s * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2 ** 64))
    return h


def _uniform(keys: np.ndarray, *salts: int) -> np.ndarray:
    return (_hashed(keys, *salts) >> np.uint64(11)) / float(1 << 53)


_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1.0, 20.0)]))


def bootstrap_weights(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """Poisson(1) draws: how often a row stands in the sample of a tree."""
    return np.searchsorted(_POISSON, _uniform(keys, seed, tree)).astype(np.float64)


def _chosen(node_key: np.ndarray, d: int, n_features: int) -> np.ndarray:
    """(nodes, d): the features that a node may split on, by hash."""
    if n_features >= d:
        return np.ones((len(node_key), d), bool)
    h = np.stack([_hashed(node_key, f) for f in range(d)], axis=1)
    rank = np.argsort(np.argsort(h, axis=1, kind="stable"), axis=1)
    return rank < n_features


def _children(node_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _hashed(node_key, 101), _hashed(node_key, 102)


# -- bins ----------------------------------------------------------------------

def feature_edges(rows: DataFrame, features: str, d: int, bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of the bins of every feature, in one pass of mergeable
    quantile summaries."""
    qs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    value = lambda i: F.nanvl(F.get(features, F.lit(i)).cast("double"), F.lit(None).cast("double"))
    found = rows.agg(*[F.percentile_approx(value(i), qs, 10_000).alias(f"e{i}") for i in range(d)]).first()
    return [np.unique(np.array(e if e else [], np.float64)) for e in found]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    x = np.full((len(column), d), np.nan)
    for i, v in enumerate(column.to_numpy(zero_copy_only=False)):
        if v is not None:
            x[i, :len(v)] = v[:d]
    return x


def _dense(column: pa.Array, d: int) -> np.ndarray:
    """Rows of an array column as a matrix, nulls as NaN."""
    flat = column.flatten()
    if column.null_count or len(flat) != len(column) * d:
        return _matrix(column, d)
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)


def _codes(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    out = np.zeros(x.shape, np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), 0, np.searchsorted(e, x[:, f], side="left"))
    return out


@dataclass
class Binned:
    """A training table as packed blocks (n, codes by feature, y, key)."""

    blocks: DataFrame
    edges: list[np.ndarray]
    n_rows: int
    n_parts: int
    n_targets: int

    @property
    def d(self) -> int:
        return len(self.edges)

    @cached_property
    def whole(self) -> Broadcast | None:
        """The table in one piece, (codes by feature, y, key) in order of the
        key, for tasks that grow whole trees; None where it is too large."""
        if not 0 < self.n_rows * (self.d + 16) <= WHOLE_BYTES:
            return None
        held = [(np.frombuffer(r["codes"], np.uint8).reshape(self.d, r["n"]), np.frombuffer(r["y"]),
                 np.frombuffer(r["key"], np.int64)) for r in self.blocks.collect()]
        codes, y, key = (np.concatenate(v, axis=-1) for v in zip(*held))
        order = np.lexsort((y, key))
        return self.blocks.sparkSession.sparkContext.broadcast((codes.take(order, axis=1), y[order], key[order]))


_BLOCK = "n long, codes binary, y binary, key binary"


def binned(rows: DataFrame, features: str, y: str, key: str, d: int, classes: int = 0, bins: int = BINS,
           edges: list[np.ndarray] | None = None) -> Binned:
    """Bin ``rows`` and pack them.  ``y`` is a number, or with ``classes`` a
    class number below it."""
    rows = rows.where(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))
    edges = feature_edges(rows, features, d, bins) if edges is None else edges
    n_rows = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n_parts = max(1, -(-n_rows * d // PART_CELLS), min(-(-n_rows * d // LEAST_CELLS), cores))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            codes, target, key = (np.concatenate(v, axis=-1) for v in zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([len(key)]), *[pa.array([v.tobytes()], pa.binary()) for v in (codes, target, key)]],
                names=["n", "codes", "y", "key"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                target = part.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                if classes == 1:
                    target = np.eye(1)[target.astype(np.int64), 0]
                if held and sum(len(key) for _, _, key in held) + part.num_rows > BLOCK_ROWS:
                    yield block()
                held.append((np.ascontiguousarray(_codes(_dense(part.column(0), d), edges).T), target,
                             part.column(2).to_numpy()))
        if held:
            yield block()

    table = rows.select(F.col(features), F.col(y).cast("double"), F.xxhash64(key).alias("_key"))
    blocks = cut_lineage(table.repartition(n_parts, "_key").mapInArrow(pack, _BLOCK))
    return Binned(blocks, edges, n_rows, n_parts, max(1, classes))


def _blocks_of(batches: Iterator[pa.RecordBatch], d: int, k: int) -> Iterator[tuple]:
    """(codes, y, key, further columns) of every block; the codes of a feature
    lie side by side, classes are spread into indicators."""
    for batch in batches:
        for i in range(batch.num_rows):
            n = batch.column(0)[i].as_py()
            codes, y, key = (batch.column(c)[i].as_py() for c in (1, 2, 3))
            target = np.frombuffer(y, np.float64)
            yield (np.frombuffer(codes, np.uint8).reshape(d, n).T,
                   np.eye(k)[target.astype(np.int64)] if k > 1 else target[:, None], np.frombuffer(key, np.int64), [batch.column(c)[i].as_py() for c in range(4, batch.num_columns)])


# -- trees ---------------------------------------------------------------------

@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1, children are left, left + 1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaf(self, codes: np.ndarray) -> np.ndarray:
        if codes.T.flags.c_contiguous and len(self.feature) <= SMALL_TREE:
            return self._leaf_by_level(codes.T)
        node = np.zeros(len(codes), np.int64)
        at = np.flatnonzero(self.feature[node] >= 0)
        while len(at):
            here = node[at]
            f = self.feature[here]
            node[at] = self.left[here] + (codes[at, f] > self.threshold[here])
            at = at[self.feature[node[at]] >= 0]
        return node

    def _leaf_by_level(self, by_feature: np.ndarray) -> np.ndarray:
        """The same for codes that lie by feature: all rows go down together,
        a leaf is its own child."""
        n, ends = by_feature.shape[1], self.feature < 0
        flat, row = by_feature.ravel(), np.arange(n)
        start = np.where(ends, 0, self.feature).astype(np.int64) * n
        threshold = np.where(ends, 255, self.threshold).astype(np.uint8)
        left = np.where(ends, np.arange(len(ends)), self.left).astype(np.int64)
        node = np.zeros(n, np.int64)
        while not ends.take(node).all():
            node = left.take(node) + (flat.take(start.take(node) + row) > threshold.take(node))
        return node

    def values_at(self, by_feature: np.ndarray, depths: Sequence[int | None]) -> dict[int | None, np.ndarray]:
        """For codes that lie by feature: the values of the tree cut off at
        some depths (None: whole); inner nodes must have their values."""
        n, ends = by_feature.shape[1], self.feature < 0
        flat, row = by_feature.ravel(), np.arange(n)
        start = np.where(ends, 0, self.feature).astype(np.int64) * n
        threshold = np.where(ends, 255, self.threshold).astype(np.uint8)
        left = np.where(ends, np.arange(len(ends)), self.left).astype(np.int64)
        node, level, found = np.zeros(n, np.int64), 0, {}
        while True:
            if level in depths:
                found[level] = self.value[node, 0]
            if ends.take(node).all():
                break
            node, level = left.take(node) + (flat.take(start.take(node) + row) > threshold.take(node)), level + 1
        return {depth: found[depth] if depth in found else self.value[node, 0] for depth in depths}

    def importance(self, d: int) -> np.ndarray:
        split = self.feature >= 0
        return np.bincount(self.feature[split], self.gain[split], minlength=d).astype(np.float64)

    def to_bytes(self) -> bytes:
        k = self.value.shape[1]
        return b"".join([np.array([len(self.feature), k], np.int32).tobytes(), self.feature.astype(np.int16).tobytes(),
                         self.threshold.astype(np.uint8).tobytes(), self.left.astype(np.int32).tobytes(),
                         self.value.astype(np.float64).tobytes(), self.gain.astype(np.float64).tobytes()])

    def to_leaves(self, d: int) -> bytes:
        """What a finished tree is asked for: splits, leaf values and the gain
        of every feature.  Nodes stand level by level, so the children of the
        j-th split are 2j + 1 and 2j + 2; values that repeat are numbered."""
        split = self.feature >= 0
        if not np.array_equal(self.left[split], 2 * np.arange(split.sum()) + 1):
            raise ValueError("the nodes do not stand level by level")
        value, number = self.value[~split], np.zeros(0, np.uint8)
        if value.shape[1] > 1:
            own, where = np.unique(value, axis=0, return_inverse=True)
            if len(own) <= 256:
                value, number = own, where.ravel().astype(np.uint8)
        wide = np.int8 if d <= 127 else np.int16
        return b"".join([np.array([len(split), value.shape[1], len(value), len(number), d], np.int32).tobytes(),
                         self.feature.astype(wide).tobytes(), self.threshold[split].astype(np.uint8).tobytes(),
                         value.astype(np.float64).tobytes(), number.tobytes(), self.importance(d).tobytes()])

    @staticmethod
    def from_leaves(blob: bytes) -> tuple[Tree, np.ndarray]:
        """The tree, without gains and inner values, and the gain per feature."""
        n, k, n_values, n_numbers, d = (int(v) for v in np.frombuffer(blob, np.int32, 5))
        feature = np.frombuffer(blob, np.int8 if d <= 127 else np.int16, n, 20).astype(np.int16)
        split = feature >= 0
        inner = int(split.sum())
        at = 20 + n * (1 if d <= 127 else 2)
        threshold, left, value = np.zeros(n, np.uint8), np.zeros(n, np.int32), np.zeros((n, k))
        threshold[split], left[split] = np.frombuffer(blob, np.uint8, inner, at), 2 * np.arange(inner) + 1
        leaves = np.frombuffer(blob, np.float64, n_values * k, at + inner).reshape(n_values, k)
        at += inner + leaves.nbytes
        value[~split] = leaves[np.frombuffer(blob, np.uint8, n_numbers, at)] if n_numbers else leaves
        return Tree(feature, threshold, left, value, np.zeros(n)), np.frombuffer(blob, np.float64, d, at + n_numbers)

    @staticmethod
    def from_bytes(blob: bytes) -> Tree:
        n, k = (int(v) for v in np.frombuffer(blob, np.int32, 2))
        at, out = 8, []
        for dtype, size in ((np.int16, n), (np.uint8, n), (np.int32, n), (np.float64, n * k), (np.float64, n)):
            out.append(np.frombuffer(blob, dtype, size, at))
            at += out[-1].nbytes
        return Tree(out[0], out[1], out[2], out[3].reshape(n, k), out[4])


@dataclass(frozen=True)
class Growth:
    """How trees are grown: features per node (all if None), least weight of a
    leaf, depth limit (none if None), l2 penalty of leaf values, and whether a
    split must reduce the loss (else every node is split until it is pure)."""

    n_features: int | None = None
    min_leaf: float = 1.0
    max_depth: int | None = None
    l2: float = 0.0
    must_gain: bool = False
    columns: float = 1.0            # share of the features that a tree may use
    seed: int = SEED

    def features(self, d: int, tree: int) -> np.ndarray:
        if self.columns >= 1:
            return np.ones(d, bool)
        u = _uniform(np.arange(d), self.seed, tree, 7)
        return np.argsort(np.argsort(u)) < max(1, round(self.columns * d))


def _score(s: np.ndarray, w: np.ndarray, l2: float) -> np.ndarray:
    return s * s / (w + l2)


def _pick(best: np.ndarray, keys: np.ndarray, tree_features: np.ndarray, how: Growth) -> np.ndarray:
    """Best score per (feature, node) without the features that a node must
    not use; if none of its features can split it, all of the tree's count."""
    d = len(tree_features)
    best = np.where(tree_features[:, None], best, -np.inf)
    if how.n_features is None or how.n_features >= d:
        return best
    own = np.where(_chosen(keys, d, how.n_features).T, best, -np.inf)
    return np.where(np.isfinite(own).any(axis=0), own, best)


def _scores(w_left: np.ndarray, s_left, w: np.ndarray, s: np.ndarray, how: Growth) -> np.ndarray:
    """Scores of cuts: ``s_left(j)`` holds the left sums of target j, ``w`` and
    ``s[j]`` the nodes' totals."""
    score = np.zeros(w_left.shape)
    w_right = w - w_left
    with np.errstate(divide="ignore", invalid="ignore"):
        for j in range(len(s)):
            left = s_left(j)
            score += _score(left, w_left, how.l2) + _score(s[j] - left, w_right, how.l2)
    least = max(how.min_leaf, 1e-9)
    score[(w_left < least) | (w_right < least)] = -np.inf
    return score


class _Nodes:
    """The nodes of a tree while it grows, numbered as they come; children are
    left, left + 1."""

    def __init__(self, rows: int, k: int):
        cap = 2 * rows
        self.feature, self.threshold = np.full(cap, -1, np.int16), np.zeros(cap, np.uint8)
        self.left, self.value, self.gain = np.zeros(cap, np.int32), np.zeros((cap, k)), np.zeros(cap)
        self.n = 1

    def split(self, ids: np.ndarray, f: np.ndarray, cut: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """The left children of the nodes ``ids``."""
        left = self.n + 2 * np.arange(len(ids))
        self.feature[ids], self.threshold[ids], self.gain[ids], self.left[ids] = f, cut, gain, left
        self.n += 2 * len(ids)
        return left

    def tree(self) -> Tree:
        return Tree(self.feature[:self.n], self.threshold[:self.n], self.left[:self.n], self.value[:self.n],
                    self.gain[:self.n])


def _by_level(tree: Tree) -> Tree:
    """The same tree, its nodes numbered level by level."""
    levels = [np.zeros(1, np.int64)]
    while len(split := levels[-1][tree.feature[levels[-1]] >= 0]):
        levels.append((tree.left[split].astype(np.int64)[:, None] + np.arange(2)).ravel())
    order = np.concatenate(levels)
    feature, left = tree.feature[order], np.zeros(len(order), np.int32)
    split = feature >= 0
    left[split] = 1 + 2 * np.arange(split.sum())
    return Tree(feature, tree.threshold[order], left, tree.value[order], tree.gain[order])


def _splits(top: np.ndarray, w: np.ndarray, s: np.ndarray, how: Growth) -> tuple[np.ndarray, np.ndarray]:
    """Gain of the best cut of every node, and whether it is made."""
    with np.errstate(invalid="ignore"):
        gain = top - _score(s, w[:, None], how.l2).sum(axis=1)
    return gain, np.isfinite(top) & ((gain > 0) | (not how.must_gain))


def _sums(block: np.ndarray, at: np.ndarray, w: np.ndarray, wy: np.ndarray, bins: int) -> np.ndarray:
    """(targets + 1, features, bins) sums of the rows at the places ``at`` of a
    block that lies by feature; their weights, and these times the targets."""
    d, every = len(block), len(at) == block.shape[1]
    if len(at) <= SUMMED_AT_ONCE:
        cells = ((block if every else block.take(at, axis=1)) + (np.arange(d) * bins)[:, None]).ravel()
        return np.stack([np.bincount(cells, np.tile(v, d), d * bins) for v in (w, *wy)]).reshape(-1, d, bins)
    out, counted = np.empty((1 + len(wy), d, bins)), bool((w == 1).all())
    for f, codes in enumerate(block):
        cells = (codes if every else codes.take(at)).astype(np.int64)
        out[0, f] = np.bincount(cells, None if counted else w, bins)
        for j, v in enumerate(wy):
            out[j + 1, f] = np.bincount(cells, v, bins)
    return out


def _cut_of(sums: np.ndarray, w: float, s: np.ndarray, key: int, tree_features: np.ndarray,
            how: Growth) -> tuple[int, int, float]:
    """(feature, cut, score) of a node's histogram; the score is -inf without a
    cut.  A cut behind an empty bin is that before it."""
    if sums.shape[2] == 1:
        return 0, 0, -np.inf
    left = np.cumsum(sums[1:], axis=2)[:, :, :-1]
    score = _scores(np.cumsum(sums[0], axis=1)[:, :-1], lambda j: left[j], w, s, how)
    score[sums[0][:, :-1] <= 0] = -np.inf
    best = _pick(score.max(axis=1)[:, None], np.array([key], np.uint64), tree_features, how)[:, 0]
    f = int(best.argmax())
    return f, int(score[f].argmax()), float(best[f])


def _finish_small(nodes: _Nodes, codes: np.ndarray, wy: np.ndarray, w: np.ndarray, square: np.ndarray, seg: np.ndarray,
                  ids: np.ndarray, keys: np.ndarray, depths: np.ndarray, tree_features: np.ndarray, how: Growth) -> None:
    """Grow what is below some small nodes, all of a level together; ``seg``
    numbers the node of every row, in ascending order.  Every feature keeps the
    rows in order of (node, code), so prefix sums give the score of every cut."""
    d, m = codes.shape
    width = (np.arange(d) * m)[:, None]
    least, counted = max(how.min_leaf, 1e-9), bool((w == 1).all())
    bounded = least > w.min()
    # by code, then by node: small numbers are sorted by their digits
    order = np.argsort(codes, axis=1, kind="stable")
    order = np.take_along_axis(order, np.argsort(seg.astype(np.uint16).take(order), axis=1, kind="stable"), axis=1)
    while True:
        starts = np.flatnonzero(np.diff(seg, prepend=-1))
        rows = order[0]
        node_w, node_q = np.add.reduceat(w[rows], starts), np.add.reduceat(square[rows], starts)
        node_s = np.stack([np.add.reduceat(v[rows], starts) for v in wy], axis=1)
        nodes.value[ids] = node_s / (node_w + how.l2)[:, None]
        live = (node_q - (node_s ** 2).sum(axis=1) / node_w > 1e-12 * node_q) & (node_w >= 2 * how.min_leaf)
        if how.max_depth is not None:
            live &= depths < how.max_depth
        if not live.any():
            return
        if not live.all():
            own = np.flatnonzero(live[seg])
            order, seg = order.take(own, axis=1), (np.cumsum(live) - 1)[seg[own]]
            ids, keys, depths, node_w, node_s = ids[live], keys[live], depths[live], node_w[live], node_s[live]
            starts = np.flatnonzero(np.diff(seg, prepend=-1))
        code = codes.ravel().take(order + width)
        # the left sums: running sums less what stands before the node
        if counted:
            wl = (np.arange(1, len(seg) + 1) - starts[seg]).astype(np.float64)[None]
        else:
            wl = w.take(order)
            np.cumsum(wl, axis=1, out=wl)
            wl -= (np.cumsum(node_w) - node_w)[seg]
        wr = node_w[seg] - wl
        wr[:, np.append(starts[1:], len(seg)) - 1] = 1.0        # no cut there
        score = None
        with np.errstate(divide="ignore", invalid="ignore"):
            for j, v in enumerate(wy):
                left = v.take(order)
                np.cumsum(left, axis=1, out=left)
                left -= (np.cumsum(node_s[:, j]) - node_s[:, j])[seg]
                right = node_s[:, j][seg] - left
                left *= left
                left /= wl + how.l2 if how.l2 else wl
                right *= right
                right /= wr + how.l2 if how.l2 else wr
                left += right
                score = left if score is None else score + left
        none = np.ones(code.shape, bool)
        np.equal(code[:, 1:], code[:, :-1], out=none[:, :-1])
        none[:, :-1] |= seg[1:] != seg[:-1]
        if bounded:
            none |= (wl < least) | (wr < least)
        score -= none * NEVER
        best = np.maximum.reduceat(score, starts, axis=1)
        best = _pick(np.where(best < -NEVER / 2, -np.inf, best), keys, tree_features, how)
        f = best.argmax(axis=0)
        top = best[f, np.arange(len(f))]
        gain, split = _splits(top, node_w, node_s, how)
        if not split.any():
            return
        hit = np.flatnonzero((score[f[seg], np.arange(len(seg))] == top[seg]) & split[seg])
        _, first = np.unique(seg[hit], return_index=True)
        at, f = hit[first], f[split]
        cut = code[f, at]
        new = nodes.split(ids[split], f, cut, gain[split])
        # left children come first, then the right ones
        number = np.cumsum(split) - 1
        if not split.all():
            own = np.flatnonzero(split[seg])
            order, seg = order.take(own, axis=1), seg[own]
        seg = number[seg]
        goes = np.zeros(m, bool)
        rows = order[0]
        goes[rows] = codes[f[seg], rows] <= cut[seg]
        lefts = goes.take(order)
        order = np.concatenate([order.ravel().take(np.flatnonzero(v)).reshape(d, -1) for v in (lefts, ~lefts)], axis=1)
        seg = np.concatenate([seg[lefts[0]], seg[~lefts[0]] + len(new)])
        ids, depths = np.concatenate([new, new + 1]), np.tile(depths[split] + 1, 2)
        keys = np.concatenate(_children(keys[split]))


SMALL_NODE = 128                # rows of a node below which its rows are kept in order
SMALL_ROWS = 2_048              # rows of such nodes that are finished together (below 65,536)
SUMMED_AT_ONCE = 2_048          # rows whose features are counted in one step
NEVER = 1e300                   # taken from the score of what is no cut


def grow(codes: np.ndarray, y: np.ndarray, w: np.ndarray, node_key: int, tree_features: np.ndarray,
         how: Growth, depth: int = 0) -> Tree:
    """The tree below one node."""
    return grow_at(np.ascontiguousarray(codes.T), np.arange(len(w)), y, w, node_key, tree_features, how, depth)


def grow_at(block: np.ndarray, places: np.ndarray, y: np.ndarray, w: np.ndarray, node_key: int,
            tree_features: np.ndarray, how: Growth, depth: int = 0) -> Tree:
    """The tree of the rows at some places of a block that lies by feature.
    Nodes with many rows are split by histograms, of two children only the
    smaller one's is counted; those with few are finished together, as many as
    the processor's cache holds."""
    wy = np.ascontiguousarray((w[:, None] * y).T)
    square = (wy.T * y).sum(axis=1)
    nodes, bins = _Nodes(len(w), y.shape[1]), int(block.max(initial=0)) + 1
    small: list[tuple] = []         # node, key, depth, rows, their codes

    def finish() -> None:
        if small:
            ids, keys, depths, rows, parts = zip(*small)
            seg, rows = np.repeat(np.arange(len(ids)), [len(r) for r in rows]), np.concatenate(rows)
            _finish_small(nodes, np.concatenate(parts, axis=1), wy[:, rows], w[rows], square[rows], seg, np.array(ids),
                          np.array(keys, np.uint64), np.array(depths), tree_features, how)
            small.clear()

    # node, key, depth, rows, a block that holds them, their places there, sums or None
    todo = [(0, int(node_key), depth, np.arange(len(w)), block, places, None)]
    while todo:
        node, key, level, rows, block, at, sums = todo.pop()
        if len(rows) < SMALL_NODE:
            if sum(len(v[3]) for v in small) + len(rows) > SMALL_ROWS:
                finish()
            small.append((node, key, level, rows, block.take(at, axis=1)))
            continue
        own_w, own_s, own_q = w[rows].sum(), wy[:, rows].sum(axis=1), square[rows].sum()
        nodes.value[node] = own_s / (own_w + how.l2)
        if how.max_depth is not None and level >= how.max_depth or own_w < 2 * how.min_leaf or not (
                own_q - (own_s ** 2).sum() / own_w > 1e-12 * own_q):
            continue
        if 4 * len(rows) <= block.shape[1]:
            block, at = np.stack([b.take(at) for b in block]), np.arange(len(rows))
        if sums is None:
            sums = _sums(block, at, w[rows], wy[:, rows], bins)
        f, cut, top = _cut_of(sums, own_w, own_s, key, tree_features, how)
        gain, split = _splits(np.array([top]), np.array([own_w]), own_s[None], how)
        if not split[0]:
            continue
        left = int(nodes.split(np.array([node]), f, cut, gain)[0])
        goes = block[f].take(at) <= cut
        keys = [int(c[0]) for c in _children(np.array([key], np.uint64))]
        parts = [np.flatnonzero(goes), np.flatnonzero(~goes)]
        less = 0 if len(parts[0]) <= len(parts[1]) else 1
        their: list = [None, None]
        if len(parts[1 - less]) >= SMALL_NODE and (how.max_depth is None or level + 1 < how.max_depth):
            i = parts[less]
            their[less] = _sums(block, at[i], w[rows[i]], wy[:, rows[i]], bins)
            their[1 - less] = sums - their[less]
        for c in (1, 0):
            i = parts[c]
            todo.append((left + c, keys[c], level + 1, rows[i], block, at[i], their[c]))
    finish()
    return _by_level(nodes.tree())


class _Top:
    """The upper part of a tree while it grows: nodes as lists, each open one
    with its weight, key and depth."""

    def __init__(self, weight: float, key: int, k: int):
        self.k = k
        self.feature, self.threshold, self.left, self.gain = [-1], [0], [0], [0.0]
        self.value = [np.zeros(k)]
        self.open = {0: (weight, key, 0)}
        self.grown = False

    def add(self, row, how: Growth) -> None:
        """Apply the outcome of a node's histogram.  Children at the depth
        limit are leaves: the histogram has their values, no row is needed."""
        self.grown = True
        node = int(row.node)
        _, key, depth = self.open.pop(node)
        self.value[node] = np.frombuffer(row.value, np.float64)
        if row.feature >= 0:
            low, high = (int(c[0]) for c in _children(np.array([key], np.uint64)))
            self.feature[node], self.threshold[node], self.gain[node] = int(row.feature), int(row.threshold), row.gain
            self.left[node] = len(self.feature)
            for weight, child, value in ((row.weight_left, low, row.value_left),
                                         (row.weight - row.weight_left, high, row.value_right)):
                if depth + 1 != how.max_depth:
                    self.open[len(self.feature)] = (weight, child, depth + 1)
                self.feature.append(-1)
                self.threshold.append(0)
                self.left.append(0)
                self.gain.append(0.0)
                self.value.append(np.frombuffer(value, np.float64))

    def tree(self) -> Tree:
        return Tree(np.array(self.feature), np.array(self.threshold), np.array(self.left),
                    np.stack(self.value), np.array(self.gain))


_SPLIT = ("tree long, node long, feature long, threshold long, gain double, weight double, weight_left double, "
          "value binary, value_left binary, value_right binary")


def _histograms(data: Binned, blocks: DataFrame, tops: dict[int, _Top], nodes: dict[int, list[int]], view,
                how: Growth) -> list:
    """One row per big node: its best split, or feature -1."""
    d, k = data.d, data.n_targets
    shape = (k + 1, d, BINS)
    trees = {t: tops[t].tree() for t in nodes}
    place = {t: np.full(len(trees[t].feature), -1) for t in nodes}
    for t, own in nodes.items():
        place[t][own] = np.arange(len(own))
    keys = {t: {i: tops[t].open[i][1] for i in nodes[t]} for t in nodes}
    node_bytes = (k + 1) * d * BINS * 8
    most = max(1, HELD_BYTES // node_bytes)

    def histogram(by_feature: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, r: np.ndarray,
                  n: int) -> tuple[np.ndarray, np.ndarray]:
        """(targets + 1, features, nodes, bins) sums of the rows ``r``, whose
        nodes ``at`` are numbered below n; and the nodes' sums of squares."""
        every = len(r) == by_feature.shape[1]
        y, w = (y, w) if every else (y[r], w[r])
        first, wy = at * BINS, [w * y[:, j] for j in range(k)]
        counted = bool((w == 1).all())
        out = np.empty((k + 1, d, n * BINS))
        for f in range(d):
            cells = first + (by_feature[f] if every else by_feature[f][r])
            out[0, f] = np.bincount(cells, None if counted else w, n * BINS)
            for j in range(k):
                out[j + 1, f] = np.bincount(cells, wy[j], n * BINS)
        return out.reshape(k + 1, d, n, BINS), np.bincount(at, (w[:, None] * y * y).sum(axis=1), n)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId() % TREE_WIDTH
        held: dict[tuple, tuple] = {}       # (tree, first node): sums, squares

        def rows() -> Iterator[pa.RecordBatch]:
            for (t, low), (sums, square) in held.items():
                some = np.flatnonzero(sums[0, 0].sum(axis=1) > 0).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t] * len(some), pa.int64()), pa.array([nodes[t][low + i] for i in some], pa.int64()),
                     pa.array([part] * len(some), pa.int64()),
                     pa.array([np.append(sums[:, :, i].ravel(), square[i]).tobytes() for i in some], pa.binary())],
                    names=["tree", "node", "part", "sums"])
            held.clear()

        for block in _blocks_of(batches, d, k):
            for t, y, w in view(block, nodes):
                at = place[t][trees[t].leaf(block[0])]
                at[w <= 0] = -1
                for low in range(0, len(nodes[t]), most):
                    n = min(most, len(nodes[t]) - low)
                    r = np.flatnonzero((at >= low) & (at < low + n))
                    if not len(r):
                        continue
                    sums, square = histogram(block[0].T, y, w, at[r] - low, r, n)
                    if (t, low) in held:
                        held[t, low][0].__iadd__(sums)
                        held[t, low][1].__iadd__(square)
                        continue
                    if sum(v.nbytes for v, _ in held.values()) + sums.nbytes > HELD_BYTES:
                        yield from rows()
                    held[t, low] = sums, square
        yield from rows()

    def added(pdf: pd.DataFrame) -> np.ndarray:
        return sum(np.frombuffer(v, np.float64) for v in sorted(pdf["sums"]))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(sums=[added(pdf).tobytes()])

    def split(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, node = int(key[0]), int(key[1])
        sums = added(pdf)
        square, sums = sums[-1], sums[:-1].reshape(shape)
        weight, s = sums[0, 0].sum(), sums[1:, 0].sum(axis=1)
        value = (s / (weight + how.l2)).tobytes()
        wl = np.cumsum(sums[0], axis=1)[:, :-1]
        score = _scores(wl, lambda j: np.cumsum(sums[j + 1], axis=1)[:, :-1], weight, s, how)
        best = _pick(score.max(axis=1)[:, None], np.array([keys[t][node]], np.uint64), how.features(d, t), how)[:, 0]
        f = int(best.argmax())
        gain = best[f] - _score(s, weight, how.l2).sum()
        pure = square - (s ** 2).sum() / weight <= 1e-12 * square
        if pure or not np.isfinite(best[f]) or (how.must_gain and gain <= 0):
            row = [t, node, -1, 0, 0.0, weight, 0.0, value, b"", b""]
        else:
            cut = int(score[f].argmax())
            left = sums[1:, f, :cut + 1].sum(axis=1)
            row = [t, node, f, cut, gain, weight, wl[f, cut], value, (left / (wl[f, cut] + how.l2)).tobytes(),
                   ((s - left) / (weight - wl[f, cut] + how.l2)).tobytes()]
        return pd.DataFrame([row], columns=["tree", "node", "feature", "threshold", "gain", "weight", "weight_left",
                                            "value", "value_left", "value_right"])

    schema = "tree long, node long, part long, sums binary"
    sums = blocks.mapInArrow(add_up, schema)
    if data.n_parts > TREE_WIDTH:
        sums = sums.groupBy("tree", "node", "part").applyInPandas(add, schema)
    return sums.groupBy("tree", "node").applyInPandas(split, _SPLIT).collect()


def _finished(data: Binned, blocks: DataFrame, tops: dict[int, _Top], view, how: Growth) -> DataFrame:
    """(tree, node, blob): the trees below the small nodes, one group each.
    A row travels as its codes, its target (or the number of its class) and
    its weight, a count below 256."""
    d, k = data.d, data.n_targets
    small = {t: sorted(top.open) for t, top in tops.items() if top.open}
    trees = {t: tops[t].tree() for t in small}
    flag = {t: np.isin(np.arange(len(trees[t].feature)), small[t]) for t in small}
    info = {(t, i): tops[t].open[i] for t in small for i in small[t]}
    n_nodes = len(info)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks_of(batches, d, k):
            codes = block[0]
            for t, y, w in view(block, small):
                at = trees[t].leaf(codes)
                inside = np.flatnonzero((w > 0) & flag[t][at])
                inside = inside[np.argsort(at[inside], kind="stable")]
                some, starts = np.unique(at[inside], return_index=True)
                some = some.tolist()
                if some:
                    parts = np.split(inside, starts[1:])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t] * len(some), pa.int64()), pa.array(some, pa.int64()),
                         *[pa.array([np.ascontiguousarray(v[r]).tobytes() for r in parts], pa.binary())
                           for v in (codes, y[:, 0] if k == 1 else y.argmax(axis=1).astype(np.int32),
                                     w.astype(np.uint8))]], names=["tree", "node", "codes", "y", "w"])

    def finish(table: pa.Table) -> pa.Table:
        t, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        codes, y, w = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype)
                       for c, dtype in (("codes", np.uint8), ("y", np.float64 if k == 1 else np.int32), ("w", np.uint8)))
        _, key, depth = info[t, node]
        tree = grow(codes.reshape(-1, d), y[:, None] if k == 1 else np.eye(k)[y], w.astype(np.float64), key,
                    how.features(d, t), how, depth)
        return pa.table({"tree": [t], "node": [node], "blob": pa.array([tree.to_leaves(d)], pa.binary())})

    dealt = blocks.mapInArrow(deal, "tree long, node long, codes binary, y binary, w binary")
    if n_nodes > 1:                 # one task per node where possible: nodes are work, not bytes
        dealt = dealt.repartition(min(n_nodes, 10_000), "tree", "node")
    return dealt.groupBy("tree", "node").applyInArrow(finish, "tree long, node long, blob binary")


def _grown(data: Binned, blocks: DataFrame, roots: dict[int, int], view, how: Growth,
           bound: int) -> tuple[dict[int, _Top], DataFrame | None]:
    """Grow the trees of ``roots`` (tree: key): their upper parts, and the
    table of the parts below."""
    tops = {t: _Top(data.n_rows, key, data.n_targets) for t, key in roots.items()}
    while True:
        big = {t: [i for i, (w, _, depth) in top.open.items()
                   if w > bound and (how.max_depth is None or depth < how.max_depth)] for t, top in tops.items()}
        big = {t: nodes for t, nodes in big.items() if nodes}
        if not big:
            break
        for row in _histograms(data, blocks, tops, big, view, how):
            tops[row.tree].add(row, how)
        for t, nodes in big.items():    # nodes without a row in their tree's sample
            for i in nodes:
                if tops[t].feature[i] < 0:
                    tops[t].open.pop(i, None)
    return tops, _finished(data, blocks, tops, view, how) if any(t.open for t in tops.values()) else None


# -- forests -------------------------------------------------------------------

@dataclass
class Forest:
    """A fitted forest: upper parts on the driver, the rest in a table."""

    edges: list[np.ndarray]
    tops: dict[int, Tree]
    below: DataFrame                # tree, node, blob
    n_targets: int

    def _model_bytes(self) -> int:
        return self.below.agg(F.sum(F.octet_length("blob"))).first()[0] or 0

    def predict(self, rows: DataFrame, features: str, out: str = "values", model_bytes: int = MODEL_BYTES) -> DataFrame:
        """``rows`` with the mean of all trees' leaf values, an array."""
        if self._model_bytes() > model_bytes:
            return self._joined(rows, features, out)
        edges, tops, d, k = self.edges, self.tops, len(self.edges), self.n_targets
        model = rows.sparkSession.sparkContext.broadcast(
            {(r["tree"], r["node"]): bytes(r["blob"]) for r in self.below.toLocalIterator()})
        at = rows.columns.index(features)
        names = [*rows.columns, out]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            below = {key: Tree.from_leaves(blob)[0] for key, blob in model.value.items()}
            for batch in batches:
                codes = _codes(_dense(batch.column(at), d), edges)
                total = np.zeros((len(codes), k))
                for t, top in tops.items():
                    node = top.leaf(codes)
                    value = top.value[node]
                    for i in np.unique(node).tolist():
                        if (t, i) in below:
                            r = np.flatnonzero(node == i)
                            tree = below[t, i]
                            value[r] = tree.value[tree.leaf(codes[r])]
                    total += value
                flat = pa.array((total / max(1, len(tops))).ravel())
                cuts = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(cuts, flat)], names=names)

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))

    def _joined(self, rows: DataFrame, features: str, out: str) -> DataFrame:
        """The same where the model is too large for every task: rows go to
        the parts of the model that they reach."""
        edges, tops, d, k = self.edges, self.tops, len(self.edges), self.n_targets
        kept = cut_lineage(rows.withColumn("_rid", F.monotonically_increasing_id()))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = _codes(_dense(batch.column(1), d), edges)
                rid = batch.column(0).to_numpy()
                for t, top in tops.items():
                    node = top.leaf(codes)
                    some = np.unique(node).tolist()
                    part = [np.flatnonzero(node == i) for i in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t] * len(some), pa.int64()), pa.array(some, pa.int64()),
                         pa.array([rid[r].tobytes() for r in part], pa.binary()),
                         pa.array([codes[r].tobytes() for r in part], pa.binary()),
                         pa.array([top.value[i].tobytes() for i in some], pa.binary())],
                        names=["tree", "node", "rids", "codes", "value"])

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rids, codes, value, blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    codes = np.frombuffer(codes, np.uint8).reshape(-1, d)
                    if blob is None:
                        v = np.tile(np.frombuffer(value, np.float64), (len(codes), 1))
                    else:
                        tree = Tree.from_leaves(blob)[0]
                        v = tree.value[tree.leaf(codes)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.frombuffer(rids, np.int64)), *[pa.array(v[:, j]) for j in range(k)]],
                        names=["_r", *[f"v{j}" for j in range(k)]])

        routed = kept.select("_rid", features).mapInArrow(
            route, "tree long, node long, rids binary, codes binary, value binary")
        values = (routed.join(self.below, ["tree", "node"], "left").select("rids", "codes", "value", "blob")
                  .mapInArrow(settle, "_r long, " + ", ".join(f"v{j} double" for j in range(k)))
                  .groupBy("_r").agg(F.array(*[F.sum(f"v{j}") / F.lit(len(tops)) for j in range(k)]).alias(out)))
        return kept.join(values, F.col("_rid") == F.col("_r")).drop("_rid", "_r")

    def importance(self) -> np.ndarray:
        """Share of every feature in the loss reduction, averaged over trees."""
        d = len(self.edges)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [Tree.from_leaves(b)[1] for b in batch.column(1).to_pylist()]
                for t, v in zip(batch.column(0).to_pylist(), rows):
                    yield pa.RecordBatch.from_arrays([pa.array([t] * d), pa.array(np.arange(d)), pa.array(v)],
                                                     names=["tree", "f", "v"])

        total = {t: top.importance(d) for t, top in self.tops.items()}
        found = self.below.select("tree", "blob").mapInArrow(run, "tree long, f long, v double")
        for r in found.groupBy("tree", "f").agg(F.sum("v").alias("v")).collect():
            total[r["tree"]][r["f"]] += r["v"]
        shares = [v / v.sum() for v in total.values() if v.sum() > 0]
        return np.mean(shares, axis=0) if shares else np.zeros(d)


class WholeForest(Forest):
    """A forest whose trees are grown by one task each, from the binned table
    that every task has.  Nothing is kept of a tree but what is asked for: rows
    are scored, gains are added up in the task that grew it.  ``below`` writes
    the trees, if they are wanted themselves."""

    def __init__(self, data: Binned, trees: Sequence[int], roots: dict[int, int], weights: Callable, how: Growth):
        leaf = Tree(np.array([-1]), np.array([0]), np.array([0]), np.zeros((1, data.n_targets)), np.zeros(1))
        self.edges, self.n_targets, self.tops = data.edges, data.n_targets, {t: leaf for t in trees}
        self.data, self.roots, self.weights, self.how = data, roots, weights, how

    def _each(self, use: Callable, schema: str) -> DataFrame:
        """``use`` of the trees (number, tree) of every task."""
        d, k, trees, shared = len(self.edges), self.n_targets, list(self.tops), self.data.whole
        roots, weights, how = self.roots, self.weights, self.how
        spark = self.data.blocks.sparkSession

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, y, key = shared.value
            target = np.eye(k)[y.astype(np.int64)] if k > 1 else y[:, None]

            def grown(t: int) -> tuple[int, Tree]:
                w = weights(key, t)
                r = np.flatnonzero(w > 0)
                return t, grow_at(codes, r, target[r], w[r], roots[t], how.features(d, t), how)

            for batch in batches:
                yield from use(grown(trees[i]) for i in batch.column(0).to_pylist())

        tasks = min(len(trees), 4 * spark.sparkContext.defaultParallelism)
        return spark.range(0, len(trees), 1, tasks).mapInArrow(run, schema)

    @cached_property
    def below(self) -> DataFrame:
        d = len(self.edges)

        def use(trees: Iterator[tuple[int, Tree]]) -> Iterator[pa.RecordBatch]:
            for t, tree in trees:
                yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([0]), pa.array([tree.to_leaves(d)], pa.binary())],
                                                 names=["tree", "node", "blob"])

        return cut_lineage(self._each(use, "tree long, node long, blob binary"))

    def predict(self, rows: DataFrame, features: str, out: str = "values", model_bytes: int = MODEL_BYTES) -> DataFrame:
        """``rows`` with the mean of all trees' leaf values: the codes of the
        rows travel to the trees, unless these have been written."""
        d, k, edges, n_trees = len(self.edges), self.n_targets, self.edges, len(self.tops)
        if "below" in self.__dict__:
            return super().predict(rows, features, out, model_bytes)
        kept = cut_lineage(rows.withColumn("_rid", F.monotonically_increasing_id()))
        n = kept.count()
        if n * (d + 8 * k) > WHOLE_BYTES:
            return super().predict(rows, features, out, model_bytes)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = np.ascontiguousarray(_codes(_dense(batch.column(1), d), edges).T)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (batch.column(0).to_numpy(), codes)],
                                                 names=["rids", "codes"])

        held = [(np.frombuffer(r["rids"], np.int64), np.frombuffer(r["codes"], np.uint8))
                for r in kept.select("_rid", features).mapInArrow(pack, "rids binary, codes binary").collect()]
        rids = np.concatenate([r for r, _ in held]) if held else np.zeros(0, np.int64)
        codes = np.concatenate([c.reshape(d, len(r)) for r, c in held], axis=1) if held else np.zeros((d, 0), np.uint8)
        shared = kept.sparkSession.sparkContext.broadcast((rids, codes))

        def use(trees: Iterator[tuple[int, Tree]]) -> Iterator[pa.RecordBatch]:
            rids, codes = shared.value
            total = np.zeros((len(rids), k))
            for _, tree in trees:
                total += tree.value[tree.leaf(codes.T)]
            for at in range(0, len(rids), SCORED_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total[at:at + SCORED_ROWS].tobytes()], pa.binary())],
                                                 names=["at", "sums"])

        def add(table: pa.Table) -> pa.Table:
            at = table.column("at")[0].as_py()
            total = sum(np.frombuffer(v) for v in sorted(table.column("sums").to_pylist())).reshape(-1, k) / n_trees
            cuts = pa.array(np.arange(len(total) + 1, dtype=np.int32) * k)
            return pa.table({"_r": shared.value[0][at:at + SCORED_ROWS],
                             out: pa.ListArray.from_arrays(cuts, pa.array(total.ravel()))})

        values = self._each(use, "at long, sums binary").groupBy("at").applyInArrow(
            add, T.StructType([T.StructField("_r", T.LongType()), T.StructField(out, T.ArrayType(T.DoubleType()))]))
        return kept.join(values, F.col("_rid") == F.col("_r")).select(*rows.columns, out)

    def importance(self) -> np.ndarray:
        d = len(self.edges)

        def use(trees: Iterator[tuple[int, Tree]]) -> Iterator[pa.RecordBatch]:
            for t, tree in trees:
                yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([tree.importance(d).tobytes()], pa.binary())],
                                                 names=["tree", "gains"])

        found = {r["tree"]: np.frombuffer(r["gains"]) for r in self._each(use, "tree long, gains binary").collect()}
        shares = [v / v.sum() for _, v in sorted(found.items()) if v.sum() > 0]
        return np.mean(shares, axis=0) if shares else np.zeros(d)


def fit_forest(data: Binned, n_trees: int = 100, seed: int = SEED, n_features: int | None = None,
               bootstrap: bool = True, max_depth: int | None = None, min_leaf: float = 1.0,
               bound: int | None = None) -> Forest:
    """M1-M4: ``n_trees`` trees until their leaves are pure (or ``max_depth``).
    Without ``bootstrap`` every row counts once in every tree.  Where there are
    as many trees as cores, and the table is small enough to be broadcast, every
    tree is grown by one task, unless a ``bound`` is given."""
    how = Growth(n_features, min_leaf, max_depth, seed=seed)

    def view(block, trees) -> Iterator[tuple]:
        _, y, key, _ = block
        for t in trees:
            yield t, y, bootstrap_weights(key, seed, t) if bootstrap else np.ones(len(y))

    if not data.n_rows:
        raise ValueError("no rows to train on")
    roots = {t: int(_hashed(np.array([t]), seed, 11)[0]) for t in range(n_trees)}
    cores = data.blocks.sparkSession.sparkContext.defaultParallelism
    if bound is None and n_trees >= cores and data.whole is not None:
        weights = lambda key, t: bootstrap_weights(key, seed, t) if bootstrap else np.ones(len(key))
        held = range(n_trees)
        if data.n_rows < FEW_ROWS:      # the sample of a tree may be empty
            keys = data.whole.value[2]
            held = [t for t in held if weights(keys, t).any()]
        if held:
            return WholeForest(data, held, roots, weights, how)
        return fit_forest(data, 1, seed, n_features, False, max_depth, min_leaf)
    bound = BOUND if bound is None else bound
    tops, below = _grown(data, data.blocks, roots, view, how, bound)
    if below is None:
        below = data.blocks.sparkSession.createDataFrame([], "tree long, node long, blob binary")
    below = cut_lineage(below)
    # a sample of very few rows may be empty: such a tree says nothing
    held = {r["tree"] for r in below.select("tree").distinct().collect()}
    held |= {t for t, top in tops.items() if len(top.feature) > 1 or not top.open and top.grown}
    if not held:
        return fit_forest(data, 1, seed, n_features, False, max_depth, min_leaf, bound)
    return Forest(data.edges, {t: top.tree() for t, top in tops.items() if t in held}, below, data.n_targets)


# -- boosting ------------------------------------------------------------------

@dataclass
class Boosted:
    """A fitted boosting model; ``loss`` holds the mean squared error of the
    validation part before every CHECK_ROUNDS-th round (empty without one)."""

    edges: list[np.ndarray]
    base: float
    rate: float
    trees: list[Tree] = field(default_factory=list)
    loss: list[float] = field(default_factory=list)

    def margins(self, codes: np.ndarray) -> np.ndarray:
        total = np.full(len(codes), self.base)
        for tree in self.trees:
            total += self.rate * tree.value[tree.leaf(codes), 0]
        return total

    def predict(self, rows: DataFrame, features: str, out: str = "prediction") -> DataFrame:
        """The model's size is bounded by rounds and depth; it travels whole."""
        model = rows.sparkSession.sparkContext.broadcast(self)
        at, d, names = rows.columns.index(features), len(self.edges), [*rows.columns, out]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = model.value
            for batch in batches:
                margin = own.margins(_codes(_dense(batch.column(at), d), own.edges))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(margin)], names=names)

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())]))


def _whole(top: Tree, below: dict[int, Tree]) -> Tree:
    """One tree of its upper part and the parts below."""
    parts, at = [top], len(top.feature)
    new = Tree(*(np.array(v) for v in (top.feature, top.threshold, top.left, top.value, top.gain)))
    for node, tree in below.items():
        # the root takes the node's place, the other nodes go behind
        shift = at - 1
        for name in ("feature", "threshold", "value", "gain"):
            getattr(new, name)[node] = getattr(tree, name)[0]
        new.left[node] = tree.left[0] + shift
        parts.append(Tree(tree.feature[1:], tree.threshold[1:], tree.left[1:] + shift, tree.value[1:], tree.gain[1:]))
        at += len(tree.feature) - 1
    parts[0] = new
    return Tree(*(np.concatenate([getattr(p, name) for p in parts])
                  for name in ("feature", "threshold", "left", "value", "gain")))


def _settled(loss: Sequence[float], patience: int) -> bool:
    """Whether the validation loss has not fallen for ``patience`` rounds."""
    return (len(loss) - 1 - int(np.argmin(loss))) * CHECK_ROUNDS >= patience


def _boost_whole(data: Binned, model: Boosted, rounds: int, subsample: float, how: Growth, is_train: Callable,
                 patience: int | None) -> None:
    """All rounds in one task, from the binned table that every task has; the
    same trees as round by round over the blocks."""
    d, seed, shared, base, rate = data.d, how.seed, data.whole, model.base, model.rate

    def run(_) -> Iterator[pa.RecordBatch]:
        codes, y, key = shared.value
        train, margin, loss = is_train(key), np.full(len(y), base), []
        rows, out = np.flatnonzero(train), np.flatnonzero(~train)
        for step in range(rounds):
            if patience is not None and step % CHECK_ROUNDS == 0:
                r = y[out] - margin[out]
                loss.append(float(r @ r / len(r)) if len(r) else 0.0)
                if _settled(loss, patience):
                    break
            r = rows[_uniform(key[rows], seed, 5, step) < subsample] if subsample < 1 else rows
            if len(r):
                tree = grow_at(codes, r, (y[r] - margin[r])[:, None], np.ones(len(r)), 0, how.features(d, step), how)
            else:
                tree = Tree(np.array([-1]), np.array([0]), np.array([0]), np.zeros((1, 1)), np.zeros(1))
            margin += rate * tree.value[:, 0][tree.leaf(codes.T)]
            yield pa.RecordBatch.from_arrays([pa.array([step]), pa.array([tree.to_bytes()], pa.binary())], names=["step", "blob"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([np.array(loss).tobytes()], pa.binary())], names=["step", "blob"])

    found = {r["step"]: bytes(r["blob"]) for r in
             data.blocks.sparkSession.range(0, 1, 1, 1).mapInArrow(run, "step long, blob binary").collect()}
    model.loss = np.frombuffer(found.pop(-1)).tolist()
    model.trees = [Tree.from_bytes(blob) for _, blob in sorted(found.items())]


def fit_boosting(data: Binned, rounds: int = 100, rate: float = 0.1, max_depth: int = 3, subsample: float = 1.0,
                 columns: float = 1.0, l2: float = 0.0, min_leaf: float = 1.0, seed: int = SEED,
                 validation: float = 0.0, patience: int | None = None, bound: int | None = None) -> Boosted:
    """M5: boosted trees for squared loss.  With ``validation`` that share of
    the rows (by hash) is kept out, and boosting stops once its loss has not
    fallen for ``patience`` rounds; the trees up to the best round are kept.
    A table that is small enough to be broadcast is boosted by one task, unless
    a ``bound`` is given."""
    spark, d = data.blocks.sparkSession, data.d
    how = Growth(None, min_leaf, max_depth, l2, True, columns, seed)

    def is_train(key: np.ndarray) -> np.ndarray:
        return _uniform(key, seed, 3) >= validation if validation > 0 else np.ones(len(key), bool)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, y, key, _ in _blocks_of(batches, d, 1):
            mine = is_train(key)
            yield pa.RecordBatch.from_arrays([pa.array([float(mine.sum())]), pa.array([float(y[mine].sum())])],
                                             names=["n", "s"])

    first = data.blocks.mapInArrow(start, "n double, s double").agg(F.sum("n"), F.sum("s")).first()
    if not first[0]:
        raise ValueError("no rows to train on")
    model = Boosted(data.edges, first[1] / first[0], rate)

    def moved(blocks: DataFrame, trees: list[Tree], has: bool) -> DataFrame:
        """Blocks with margins as a further column."""
        base = model.base

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = []
                for codes, y, _, rest in _blocks_of([batch], d, 1):
                    margin = np.frombuffer(rest[0], np.float64).copy() if has else np.full(len(y), base)
                    for tree in trees:
                        margin += rate * tree.value[:, 0][tree.leaf(codes)]
                    new.append(margin.tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(new, pa.binary())],
                                                 names=["n", "codes", "y", "key", "margin"])

        return cut_lineage(blocks.mapInArrow(run, _BLOCK + ", margin binary"))

    def residual(block, recent: list[Tree]) -> np.ndarray:
        codes, y, _, rest = block
        margin = np.frombuffer(rest[0], np.float64)
        for tree in recent:
            margin = margin + rate * tree.value[:, 0][tree.leaf(codes)]
        return y - margin[:, None]

    def validation_loss(blocks: DataFrame, recent: list[Tree]) -> float:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks_of(batches, d, 1):
                r = residual(block, recent)[~is_train(block[2])]
                yield pa.RecordBatch.from_arrays([pa.array([float(len(r))]), pa.array([float((r * r).sum())])],
                                                 names=["n", "s"])

        n, s = blocks.mapInArrow(run, "n double, s double").agg(F.sum("n"), F.sum("s")).first()
        return s / n if n else 0.0

    if bound is None and data.whole is not None:
        _boost_whole(data, model, rounds, subsample, how, is_train, patience if validation > 0 else None)
        rounds = 0
    bound = BOUND if bound is None else bound
    blocks, recent = moved(data.blocks, [], False) if rounds else data.blocks, []
    for step in range(rounds):
        if len(recent) == UPDATE_ROUNDS:
            blocks, recent = moved(blocks, recent, True), []
        if validation > 0 and patience is not None and step % CHECK_ROUNDS == 0:
            model.loss.append(validation_loss(blocks, recent))
            if _settled(model.loss, patience):
                break
        now = list(recent)

        def view(block, trees, now=now, step=step) -> Iterator[tuple]:
            key = block[2]
            w = is_train(key)
            if subsample < 1:
                w = w & (_uniform(key, seed, 5, step) < subsample)
            yield step, residual(block, now), w.astype(np.float64)

        tops, below = _grown(data, blocks, {step: 0}, view, how, bound)
        parts = {r["node"]: Tree.from_leaves(bytes(r["blob"]))[0] for r in below.collect()} if below is not None else {}
        tree = _whole(tops[step].tree(), parts)
        model.trees.append(tree)
        recent = [*recent, tree]
    if model.loss:
        model.trees = model.trees[:max(1, int(np.argmin(model.loss)) * CHECK_ROUNDS)]
    return model

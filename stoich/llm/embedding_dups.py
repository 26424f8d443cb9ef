"""Near-copies among embeddings by randomised-rotation binary codes.

Equal vectors of a label are one class.  A class's unit vector is rotated by a
random orthogonal matrix and stored, once, as its sign bits with one correction
factor, the inner product of the vector with its own code; for its part as a
query it is stored with QUERY_BITS bits a component.  For a query vector ``q``
the code's inner product with ``q``, divided by the factor, is an unbiased
estimate of ``<o, q>`` whose error is bounded, with confidence, by a multiple of
``sqrt((1 - f^2) / f^2 / (D - 1))``.  Pairs whose upper bound stays below the
threshold are dropped; all others are recomputed in double precision.

Only codes travel to the buckets.  A first pass finds the entries of a bucket
that have a pair left; the vectors of these alone are joined for the exact
products.

Pairs to estimate come from hash tables of random hyperplanes: ``k`` signs make
a bucket key, ``k`` growing with the logarithm of the label's size so buckets
stay small, and as many tables as bring the chance to miss a pair right at the
threshold below ``MISS``.  A pair counts in the first table in which it meets,
so nothing has to be de-duplicated and no list of pairs is kept: a task emits,
per class, the number of vectors linked, and a spanning forest of the links it
saw.  Buckets above ``BLOCK`` entries are dealt in blocks, one task per pair of
blocks, so no bucket is held whole.

Defined cases: a null label, and a vector that is null, empty, zero or holds
null or non-finite components, link with nothing; vectors of different length
do not link; equal vectors link with each other; rows that repeat a vec_id are
vectors of their own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoich.llm.common import materialise
from stoich.llm.components import connected_components

THRESHOLD = 0.98
MISS = 2e-4
BUCKET = 8               # wanted entries per bucket
BLOCK = 1024
CONFIDENCE = 5.0         # width of the bounds in standard errors
QUERY_BITS = 4
SEED = 20240229
BROADCAST_ROWS = 200_000


def key_bits(n: int) -> int:
    """Signs per key for a label of ``n`` classes."""
    return int(min(60, max(1, ceil(np.log2(max(2, n) / BUCKET)))))


def n_tables(bits: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Tables that leave a pair at the threshold unmet with chance ``miss``."""
    same = (1 - acos(threshold) / pi) ** bits
    return max(1, ceil(log(miss) / log(1 - same))) if same < 1 else 1


@cache
def _planes(dim: int, bits: int, table: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, dim, table])).standard_normal((dim, bits))


@cache
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([SEED, dim])).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """Sign bits and correction factors of rotated unit vectors, and the
    vectors as queries: ``QUERY_BITS`` bit planes between ``low`` and
    ``low + step * (2 ** QUERY_BITS - 1)``."""

    def __init__(self, unit: np.ndarray):
        dim = self.dim = unit.shape[1]
        turned = unit @ rotation(dim)
        pack = lambda on: np.ascontiguousarray(np.packbits(
            np.pad(on, ((0, 0), (0, -dim % 64))), axis=1, bitorder="little")).view(np.uint64)
        self.words = pack(turned > 0)
        low = turned.min(axis=1)
        step = np.maximum(turned.max(axis=1) - low, 1e-12) / (2 ** QUERY_BITS - 1)
        # one random offset per component, the same for all vectors
        dither = np.random.Generator(np.random.PCG64([SEED, dim, 1])).random(dim)
        level = np.minimum(np.floor((turned - low[:, None]) / step[:, None] + dither), 2 ** QUERY_BITS - 1).astype(np.uint8)
        self.planes = np.stack([pack((level >> j) & 1) for j in range(QUERY_BITS)], axis=1)
        self.numbers = np.stack([np.bitwise_count(self.words).sum(axis=1), np.abs(turned).sum(axis=1) / np.sqrt(dim),
                                 low, step, level.sum(axis=1, dtype=np.int64)], axis=1).astype(np.float64)

    def to_bytes(self) -> list[bytes]:
        return [w.tobytes() + p.tobytes() + n.tobytes() for w, p, n in zip(self.words, self.planes, self.numbers)]

    @staticmethod
    def of_bytes(rows: list[bytes], dim: int) -> Codes:
        n, width = len(rows), -(-dim // 64)
        raw = np.frombuffer(b"".join(rows), np.uint64).reshape(n, -1)
        new = object.__new__(Codes)
        new.dim = dim
        new.words, planes, numbers = np.split(raw, [width, width * (1 + QUERY_BITS)], axis=1)
        new.planes = planes.reshape(n, QUERY_BITS, width)
        new.numbers = np.ascontiguousarray(numbers).view(np.float64)
        return new

    def take(self, rows: np.ndarray) -> Codes:
        new = object.__new__(Codes)
        new.dim, new.words, new.planes, new.numbers = self.dim, self.words[rows], self.planes[rows], self.numbers[rows]
        return new

    def upper_bounds(self, queries: Codes) -> np.ndarray:
        """Upper confidence bounds of <o, q> for all codes o (rows) and
        queries q (columns), from popcounts over the queries' bit planes."""
        dot = np.zeros((len(self.words), len(queries.words)))
        for j in range(QUERY_BITS):
            for w in range(self.words.shape[1]):
                dot += np.float64(1 << j) * np.bitwise_count(self.words[:, w, None] & queries.planes[None, :, j, w])
        ones, f = self.numbers[:, :1], self.numbers[:, 1:2]
        low, step, level = queries.numbers[:, 2], queries.numbers[:, 3], queries.numbers[:, 4]
        signed = 2 * (low * ones + step * dot) - (self.dim * low + step * level)
        estimate = signed / np.sqrt(self.dim) / f
        error = np.sqrt((1 - np.minimum(f * f, 1)) / (f * f) / max(1, self.dim - 1)) + 0.5 * step / f
        return estimate + CONFIDENCE * error


def _read(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, k1, k2, vec): usable vectors as float64 bytes with
    a 128-bit hash; dim is null for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, label, v in zip(*batch.columns):
                dim = k1 = k2 = vec = None
                if label.is_valid and v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    if np.isfinite(x).all() and x.any():
                        vec = x.tobytes()
                        h = int.from_bytes(blake2b(vec, digest_size=16).digest(), "little")
                        dim, k1, k2 = len(x), (h >> 64) - (1 << 63), (h & (2 ** 64 - 1)) - (1 << 63)
                rows.append((i.as_py(), label.as_py(), dim, k1, k2, vec))
            if rows:
                types = [pa.int64()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                                 names=["vec_id", "label", "dim", "k1", "k2", "vec"])

    return vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"),
                          F.col("embedding").cast("array<double>")).mapInArrow(
        run, "vec_id long, label long, dim long, k1 long, k2 long, vec binary")


def _unit(batch: pa.RecordBatch, column: int, dim: int, rows: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so neither tiny nor
    huge vectors lose digits."""
    col = batch.column(column)
    x = np.stack([np.frombuffer(col[int(r)].as_py(), np.float64) for r in rows]).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket keys (rows x tables)."""
    power = np.int64(1) << np.arange(bits, dtype=np.int64)
    return np.stack([((unit @ _planes(unit.shape[1], bits, t)) > 0) @ power for t in range(tables)], axis=1)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns rep, label, dim, vec, n, mult: one row per class with its code
    and keys."""
    for batch in batches:
        dim, n = (batch.column(i).to_numpy() for i in (2, 4))
        bits = np.array([key_bits(int(x)) for x in n])
        for d, b in sorted({*zip(dim.tolist(), bits.tolist())}):
            rows = np.flatnonzero((dim == d) & (bits == b))
            unit = _unit(batch, 3, d, rows)
            keys = _keys(unit, b, n_tables(b))
            flat = pa.array(keys.ravel())
            cuts = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * keys.shape[1])
            take = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [take.column(0), take.column(1), take.column(2), take.column(5), take.column(3),
                 pa.array(Codes(unit).to_bytes(), pa.binary()), pa.ListArray.from_arrays(cuts, flat)],
                names=["rep", "label", "dim", "mult", "vec", "code", "keys"])


def _reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over links (i, j)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def _pairs_left(at: tuple, block: np.ndarray, keys: np.ndarray, codes: Codes,
                threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries of one pair of blocks whose bound reaches the
    threshold and that did not meet in an earlier table."""
    _, _, table, _, a, z = at
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == z)
    if not len(left) or not len(right):
        return left[:0], right[:0]
    i, j = np.nonzero(codes.take(left).upper_bounds(codes.take(right)) >= threshold)
    i, j = left[i], right[j]
    if a == z:
        i, j = i[i < j], j[i < j]
    new = np.ones(len(i), dtype=bool)
    for s in range(0, len(i), 1 << 15):
        p, q = i[s:s + (1 << 15)], j[s:s + (1 << 15)]
        new[s:s + (1 << 15)] = ~(keys[p, :table] == keys[q, :table]).any(axis=1)
    return i[new], j[new]


def _left(group: list[tuple], threshold: float) -> list[tuple]:
    """The entries (at..., rep, block) of one pair of blocks that have a pair
    left; rows are (at, rep, block, keys, code)."""
    at = group[0][0]
    block, keys = np.array([r[2] for r in group]), np.array([r[3] for r in group])
    i, j = _pairs_left(at, block, keys, Codes.of_bytes([r[4] for r in group], at[1]), threshold)
    return [(*at, group[r][1], group[r][2]) for r in np.union1d(i, j).tolist()]


def _solve(group: list[tuple], threshold: float) -> list[tuple]:
    """Link counts (x, n, null) and connections (x, null, y) within one pair of
    blocks; rows are (at, rep, block, keys, code, mult, vec)."""
    at = group[0][0]
    group.sort(key=lambda r: r[1])
    rep = [r[1] for r in group]
    block, keys = np.array([r[2] for r in group]), np.array([r[3] for r in group])
    mult = np.array([r[5] for r in group])
    x = np.stack([np.frombuffer(r[6], np.float64) for r in group])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    i, j = _pairs_left(at, block, keys, Codes.of_bytes([r[4] for r in group], at[1]), threshold)
    ok = np.zeros(len(i), dtype=bool)
    for s in range(0, len(i), 1 << 15):
        p, q = i[s:s + (1 << 15)], j[s:s + (1 << 15)]
        ok[s:s + (1 << 15)] = (x[p] * x[q]).sum(axis=1) >= threshold
    i, j = i[ok], j[ok]
    degree = (np.bincount(i, mult[j], minlength=len(x)) + np.bincount(j, mult[i], minlength=len(x))).astype(np.int64)
    root = _reachable(len(x), i, j)
    return ([(rep[r], int(degree[r]), None) for r in np.flatnonzero(degree)]
            + [(rep[r], None, rep[root[r]]) for r in np.flatnonzero(root != np.arange(len(x)))])


_GROUP = ["label", "dim", "tab", "key", "a", "z"]


def _by_blocks(solve, names: list[str], threshold: float):
    """Rows come block pair by block pair: the columns of _GROUP, then those
    of an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

        for batch in batches:
            out = []
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols):
                at = row[:len(_GROUP)]
                if held and held[0][0] != at:
                    out += solve(held, threshold)
                    held = []
                held.append((at, *row[len(_GROUP):]))
            if out:
                yield emit(out)
        if held and (out := solve(held, threshold)):
            yield emit(out)

    return run


def near_copies(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    read = materialise(_read(vectors).withColumn("row", F.monotonically_increasing_id()))
    usable = read.where("dim IS NOT NULL")
    kind = ["label", "dim", "k1", "k2"]
    classes = materialise(usable.groupBy(*kind).agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("mult")))
    labels = classes.groupBy(F.col("label").alias("_l"), F.col("dim").alias("_d")).agg(F.count(F.lit(1)).alias("n"))
    ones = (classes.join(_few(labels), (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d")))
            .select("rep", "mult", "n"))
    entries = materialise(
        usable.join(ones, F.col("row") == F.col("rep")).select("rep", "label", "dim", "vec", "n", "mult")
        .mapInArrow(_entries, "rep long, label long, dim long, mult long, vec binary, code binary, keys array<long>"))
    slots = entries.select("rep", "label", "dim", F.posexplode("keys").alias("tab", "key"))
    full = (slots.groupBy("label", "dim", "tab", "key").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
            .withColumn("_blocks", F.ceil(F.col("_m") / BLOCK)))
    own = F.pmod(F.xxhash64("rep"), F.col("_blocks"))
    dealt = (slots.join(full, ["label", "dim", "tab", "key"]).withColumn("block", own)
             .withColumn("_o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
             .select("label", "dim", "tab", "key", F.least("block", "_o").alias("a"), F.greatest("block", "_o").alias("z"),
                     "rep", "block"))
    met = (dealt.join(entries.select("rep", "keys", "code"), "rep").select(*_GROUP, "rep", "block", "keys", "code")
           .repartition(*_GROUP).sortWithinPartitions(*_GROUP))
    names = [*_GROUP, "rep", "block"]
    left = materialise(met.mapInArrow(_by_blocks(_left, names, threshold), ", ".join(f"{c} long" for c in names)))
    found = materialise(
        left.join(entries.select("rep", "keys", "code", "mult", "vec"), "rep")
        .select(*_GROUP, "rep", "block", "keys", "code", "mult", "vec")
        .repartition(*_GROUP).sortWithinPartitions(*_GROUP)
        .mapInArrow(_by_blocks(_solve, ["x", "n", "y"], threshold), "x long, n long, y long"))
    degree = found.where("n IS NOT NULL").groupBy(F.col("x").alias("rep")).agg(F.sum("n").alias("_deg"))
    roots = connected_components(found.where("y IS NOT NULL").select(F.col("x").alias("a"), F.col("y").alias("b")))
    solved = (classes.join(degree, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
              .select(*[F.col(c).alias(f"_{c}") for c in kind], F.coalesce("root", "rep").alias("root"),
                      (F.col("mult") - 1 + F.coalesce("_deg", F.lit(0))).alias("n_links")))
    member = materialise(usable.select("vec_id", *kind).join(solved, [F.col(c) == F.col(f"_{c}") for c in kind])
                         .select("vec_id", "n_links", "root"))
    least = member.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    alone = read.where("dim IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"),
                                             F.col("vec_id").alias("component_id"))
    return (member.join(least, "root").select("vec_id", "n_links", "component_id").unionAll(alone)
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def _few(df: DataFrame) -> DataFrame:
    """Broadcast while the table has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df

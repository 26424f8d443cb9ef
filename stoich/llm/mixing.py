"""Mixing sources to target weights by blocks.

Every source's words form one stream (documents in row-hash order), cut into
blocks of ``block_words``; a source of fewer than FINE such blocks has shorter
ones, so that about FINE of them make up the source (down to one word).  The
output is a list of slots, one block each, written shard by shard: each shard
draws its source counts from a multinomial (the whole part of every expectation
is taken, the rest is drawn), the slots of a source are numbered through all
shards, and a last shard settles what the draws left open, so a source has as
many slots as blocks make up its target.  Slot ``j`` of a source takes
block ``perm(j mod n_blocks)`` of that source, ``perm`` being a keyed
pseudorandom permutation of its block indices (one key per pass).  Blocks and
slots meet by an equi-join on (source, block index); nothing but one row per
source reaches the driver.

Targets: the sources, by code point and null last, weigh 5, 2, 1, 5, 2, 1, ...
and share ``share`` times all words; a target stops at ``most`` times its
source's words and the excess is shared again by weight.  As slots of a source
beyond ``most`` whole passes name no block, no block is taken more than
``most`` times, hence no document more than ``most`` times its size.

Defined cases: a null or blank text has size 0 and takes nothing; a null source
is a source of its own; repeated rows are separate rows; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stoich.llm.common import bounded_batches, materialise, packed, running_offset, unpacked
from stoich.llm.words import Words, text_chunks

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_WORDS = 64
FINE = 64
SHARD_SLOTS = 4096
SEED = 20240229


def targets(sizes: list[tuple[str | None, int]], share: float = 1.5, most: float = 2.0,
            weights: tuple[float, ...] = WEIGHTS) -> list[tuple[str | None, int, float]]:
    """(source, words, target words) for every source, in the order that
    decides the weights.  One row per source; the work is small."""
    named = sorted((s for s in sizes if s[0] is not None), key=lambda s: s[0].encode("utf-32-be"))
    order = named + [s for s in sizes if s[0] is None]
    size = np.array([float(n) for _, n in order])
    weight = np.array([weights[i % len(weights)] for i in range(len(order))])
    goal = np.zeros(len(order))
    full = size <= 0
    rest = share * size.sum()
    while rest > 0 and not full.all():
        now = rest * np.where(full, 0.0, weight) / weight[~full].sum()
        over = ~full & (now >= most * size)
        if not over.any():
            goal[~full] = now[~full]
            break
        goal[over] = most * size[over]
        rest -= goal[over].sum()
        full |= over
    return [(s, n, float(g)) for (s, n), g in zip(order, goal)]


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of ``index`` under the keyed permutation of ``0..n-1``: a four
    round Feistel network on the next even number of bits, walked along its
    cycle until the image is below ``n``."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2)
    mask = (np.int64(1) << half) - 1
    x = index.astype(np.int64).copy()
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x[todo] >> h, x[todo] & m
        for r in range(4):
            f = (right.astype(np.uint64) + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64)) ^ k
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f >> np.uint64(33)).astype(np.int64) & m)
        x[todo] = (left << h) | right
        todo = x >= n
    return x


def document_sizes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(doc_id, source, size) per row, counted over whole texts, and the row's
    number ``row`` if there is one."""
    names = ["doc_id", "source", "size"] + ["_row"] * bool(row)
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                n = Words(part.column(2)).counts()
                rest = [part.column(3)] if row else []
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), *rest], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string"),
                       *([F.col(row).alias("_row")] if row else [])).mapInArrow(
        count, "doc_id long, source string, size long" + ", _row long" * bool(row))


def _block_size(n: int, block_words: int) -> int:
    return max(1, min(block_words, n // FINE))


def _slots(plan: list[tuple[int, int, float]], block_words: int, shard_slots: int, seed: int,
           spark, most: float) -> DataFrame:
    """(source number, block, pass) per output slot that names a block."""
    blocks = np.array([ceil(n / _block_size(n, block_words)) for _, n, _ in plan], dtype=np.int64)
    quota = np.array([g * m / max(n, 1) for (_, n, g), m in zip(plan, blocks)])
    wanted = np.rint(quota).astype(np.int64)
    shards = max(1, ceil(quota.sum() / shard_slots))
    expect = quota / shards
    base = np.floor(expect).astype(np.int64)
    frac = expect - base

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                rng = np.random.Generator(np.random.PCG64([seed, shard]))
                extra = int(np.floor(frac.sum() + rng.random()))
                n = base + (rng.multinomial(extra, frac / frac.sum()) if extra else 0)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), shard), pa.int64()), pa.array(some, pa.int64()),
                     pa.array(n[some], pa.int64())], names=["shard", "src", "n"])

    counts = materialise(spark.range(shards).mapInArrow(draw, "shard long, src long, n long"))
    drawn = {r[0]: r[1] for r in counts.groupBy("src").agg(F.sum("n")).collect()}
    open_ = [(shards, i, int(w) - drawn.get(i, 0)) for i, w in enumerate(wanted) if w > drawn.get(i, 0)]
    if open_:
        counts = materialise(counts.unionAll(spark.createDataFrame(open_, counts.schema)))
    spread = running_offset(counts, "src", ["shard"], "n", "first")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, first, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for a in range(0, len(src), 64):
                m = n[a:a + 64]
                s = np.repeat(src[a:a + 64], m)
                j = np.repeat(first[a:a + 64] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                turn = j // blocks[s]
                ok = (turn < most) & (j < wanted[s])
                s, j, turn = s[ok], j[ok], turn[ok]
                key = (s * 1_000_003 + turn * 7_919 + seed) * 0x5851F42D
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s, pa.int64()), pa.array(permuted(j % blocks[s], blocks[s], key), pa.int64()),
                     pa.array(turn, pa.int64())], names=["src", "block", "turn"])

    return spread.select("src", "first", "n").mapInArrow(place, "src long, block long, turn long")


def _mixed(sizes: DataFrame, share: float, most: float, block_words: int, shard_slots: int,
           seed: int) -> tuple[DataFrame, DataFrame]:
    """From (doc_id, source, size, _row): one row per document with its source's
    figures, and one row
    (_row, turn, lo, words) per piece of a document in an output slot, ``lo``
    being the piece's first word in the document."""
    spark = sizes.sparkSession
    sizes = materialise(sizes)
    totals = [(r[0], int(r[1])) for r in sizes.groupBy("source").agg(F.sum("size")).collect()]
    plan = targets(totals, share, most)
    table = spark.createDataFrame(
        [(i, s, n, g, _block_size(n, block_words)) for i, (s, n, g) in enumerate(plan)],
        T.StructType([T.StructField("src", T.LongType()), T.StructField("_s", T.StringType()),
                      T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
                      T.StructField("_b", T.LongType())]))
    known = sizes.join(F.broadcast(table) if len(plan) <= 100_000 else table,
                       F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    if not sum(n for _, n, _ in plan):
        none = spark.createDataFrame([], "_row long, turn long, lo long, words long")
        return known, none
    placed = running_offset(materialise(known.where("size > 0").select("_row", "doc_id", "src", "size", "_b")),
                            "src", ["doc_id", "size", "_row"], "size", "at")
    b = F.col("_b")
    begin = F.greatest(F.col("at"), F.col("block") * b)
    pieces = (placed.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b))))
        .select("_row", "src", "block", (begin - F.col("at")).alias("lo"),
                (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b) - begin).alias("words")))
    slots = _slots([(i, n, g) for i, (_, n, g) in enumerate(plan)], block_words, shard_slots, seed, spark, most)
    return known, pieces.join(slots, ["src", "block"]).select("_row", "turn", "lo", "words")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS,
        shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    sized = document_sizes(docs).withColumn("_row", F.monotonically_increasing_id())
    known, pieces = _mixed(sized, share, most, block_words, shard_slots, seed)
    taken = pieces.groupBy(F.col("_row").alias("_r")).agg(F.sum("words").alias("_t"))
    return known.join(taken, F.col("_row") == F.col("_r"), "left").select(
        "doc_id", "source", "size", "source_size", "target",
        F.coalesce(F.col("_t"), F.lit(0)).cast("bigint").alias("taken"))


def mixed_texts(docs: DataFrame, share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS,
                shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix itself: per document and pass a row with the words taken in
    that pass, all other columns as in ``docs``.

    A pass that takes the whole document gives its text unchanged; otherwise
    the taken runs of words, each with its inner white space, are joined by a
    line break.  Documents of which nothing is taken give no row.
    """
    rows = materialise(packed(docs).withColumn("_row", F.monotonically_increasing_id()))
    own = rows.select("_row", "whole.doc_id", "whole.source", "whole.text")
    _, pieces = _mixed(document_sizes(own, "_row"), share, most, block_words, shard_slots, seed)
    runs = pieces.groupBy(F.col("_row").alias("_r"), "turn").agg(
        F.sort_array(F.collect_list(F.struct("lo", "words"))).alias("_runs"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, r) for t, r in zip(text, runs)], dtype=object)

    mixed = rows.join(runs, F.col("_row") == F.col("_r")).select(
        "whole", cut("whole.text", "_runs").alias("_text"))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return unpacked(mixed, docs.columns, **changed)


def _cut(text: str, runs) -> str:
    words = Words(pa.array([text], pa.large_string()))
    n = len(words.start)
    if sum(r["words"] for r in runs) == n:
        return text
    merged: list[list[int]] = []
    for r in runs:
        if merged and merged[-1][1] == r["lo"]:
            merged[-1][1] += r["words"]
        else:
            merged.append([r["lo"], r["lo"] + r["words"]])
    raw = words.data
    return "\n".join(bytes(raw[words.start[a]:words.end[z - 1]]).decode("utf-8") for a, z in merged)

"""Periodic runs of words: Kruskal over the suffix classes by falling LCP.

A run is a stretch of words with smallest period q and length of at least
max(12, 2q) that no neighbouring word extends.  Its first word p and the word
p + q start suffixes that agree on l = length - q >= q words, and no start
between them agrees on that many.  So all runs appear as follows:

1. **Suffixes.** Words of a batch of texts become ranks per text, and prefix
   doubling sorts the suffixes of every text; a position whose next MIN_LCP
   words occur once in its text is in no run and takes no further part.
2. **LCP.** Neighbours in suffix order are compared by the ranks of all
   doubling levels, longest first: exact, without hashes of stretches.
3. **Kruskal.** Neighbour pairs are united by falling LCP l with union-find.
   Every class keeps its positions in order, the smaller one is inserted into
   the larger one, and two positions that become adjacent at a distance q <= l
   are a seed: the words from the left one on have period q for q + l words.
   It is a run if the word before it breaks the period.

Memory is bounded by the longest text (a batch is cut into chunks of texts).
The longest run of a text may be the whole text; a text is never split.

Defined cases: null, empty and blank texts have no run and collapse to the
empty text; repeated rows and rows that repeat a doc_id are treated one by
one; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoich.llm.common import bounded_batches
from stoich.llm.words import Words, joined, text_chunks

MIN_LENGTH = 12
MIN_LCP = MIN_LENGTH // 2       # a run of period q agrees with itself on length - q words
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of keys, the first key being the most significant."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty_like(new)
    out[order] = np.cumsum(new)
    return out


class Suffixes:
    """Suffixes of the texts of one batch that share MIN_LCP words with
    another suffix of the same text, in order, with neighbours' LCP."""

    def __init__(self, words: Words):
        n = self.n = len(words.start)
        self.stop = np.repeat(words.first[1:], words.counts())
        owner = np.repeat(np.arange(len(words.first) - 1), words.counts())
        self.levels: list[tuple[int, np.ndarray]] = []
        rank = _ranks(owner, words.hashes(lower=False))
        for have, add in ((1, 1), (2, 2), (4, 2)):
            self.levels.append((have, rank))
            after = rank if add == have else self.levels[1][1]
            rank = _ranks(rank, self._at(after, np.arange(n), have))
        size = np.bincount(rank, minlength=1)
        first = np.cumsum(size) - size
        active = np.flatnonzero(size[rank] > 1)
        rank, length = first[rank], MIN_LCP
        self.order = active[np.argsort(rank[active], kind="stable")]
        group = rank
        while len(active):
            self.levels.append((length, rank))
            after = self._at(rank, active, length)
            order = np.lexsort((after, rank[active]))
            active, after = active[order], after[order]
            old = rank[active]
            fresh = np.ones(len(active), bool)
            fresh[1:] = old[1:] != old[:-1]
            new = fresh.copy()
            new[1:] |= after[1:] != after[:-1]
            at = np.arange(len(active))
            begin = np.maximum.accumulate(np.where(fresh, at, 0))
            now = np.maximum.accumulate(np.where(new, at, 0))
            rank = rank.copy()
            rank[active] = old + now - begin
            alone = new & np.append(new[1:], True)
            active, length = active[~alone], 2 * length
        self.order = self.order[np.argsort(rank[self.order], kind="stable")]
        left, right = self.order[:-1], self.order[1:]
        near = group[left] == group[right]
        self.left, self.right = left[near], right[near]
        self.lcp = self._lcp(self.left, self.right)

    def _at(self, rank: np.ndarray, position: np.ndarray, step: int) -> np.ndarray:
        """Rank of what follows ``step`` words later, -1 behind the text."""
        to = position + step
        return np.where(to < self.stop[position], rank[np.minimum(to, max(0, self.n - 1))], -1)

    def _lcp(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = np.zeros(len(a), np.int64)
        for length, rank in reversed(self.levels):
            x, y = a + same, b + same
            inside = (x < self.stop[a]) & (y < self.stop[b])
            top = self.n - 1
            same += np.where(inside & (rank[np.minimum(x, top)] == rank[np.minimum(y, top)]), length, 0)
        return same


def _united(suffixes: Suffixes, word: list[int], first: list[int]) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) from the seeds of all unions; ``first``
    holds the first position of every position's text."""
    up: dict[int, int] = {}
    places: dict[int, list[int]] = {}
    seeds: dict[tuple[int, int], int] = {}

    def top(x: int) -> int:
        path = []
        while (parent := up.setdefault(x, x)) != x:
            path.append(x)
            x = parent
        for p in path:
            up[p] = x
        return x

    def adjacent(p: int, r: int, lcp: int) -> None:
        q = r - p
        if q <= lcp and q + lcp >= MIN_LENGTH and (p == first[p] or word[p - 1] != word[r - 1]):
            seeds.setdefault((p, q), lcp)

    by_lcp = np.argsort(-suffixes.lcp, kind="stable")
    for i, j, lcp in zip(suffixes.left[by_lcp].tolist(), suffixes.right[by_lcp].tolist(),
                         suffixes.lcp[by_lcp].tolist()):
        a, b = top(i), top(j)
        large, small = places.pop(a, None) or [a], places.pop(b, None) or [b]
        if len(small) > len(large):
            large, small, a, b = small, large, b, a
        up[b] = a
        for k, p in enumerate(small):
            at = bisect_left(large, p)
            if at:
                adjacent(large[at - 1], p, lcp)
            if at < len(large) and (k + 1 == len(small) or small[k + 1] > large[at]):
                adjacent(p, large[at], lcp)
            large.insert(at, p)
        places[a] = large
    return [(p, q + lcp, q) for (p, q), lcp in seeds.items()]


def runs_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All runs of a batch of texts as rows (text, start, length, period) by
    text, start and period, and which words no run makes redundant."""
    keep = np.ones(len(words.start), bool)
    found: list[tuple[int, int, int]] = []
    if len(keep):
        suffixes = Suffixes(words)
        if len(suffixes.lcp):
            first = np.repeat(words.first[:-1], words.counts())
            found = _united(suffixes, suffixes.levels[0][1].tolist(), first.tolist())
    rows = np.array(sorted((p, q, n) for p, n, q in found), np.int64).reshape(-1, 3)
    start, period, length = rows.T
    text = np.searchsorted(words.first, start, side="right") - 1
    step = np.zeros(len(keep) + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    keep &= np.cumsum(step[:-1]) == 0
    return np.stack([text, start - words.first[text], length, period], axis=1), keep


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per document doc_id, n_words, its runs by start and period, and the
    text collapsed: no run keeps more than its first period, words joined by
    one space."""
    bounded_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                words = Words(part.column(1))
                runs, keep = runs_of(words)
                cuts = np.searchsorted(runs[:, 0], np.arange(part.num_rows + 1)).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words.counts()), pa.ListArray.from_arrays(pa.array(cuts), values),
                     joined(words, keep).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        scan, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) where, for every tenth crc32 of the id, the
    words from some place on repeat the first words from there."""
    h = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    some = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, words).alias("_w"))
    g, n = F.floor(F.col("_h") / 10), F.size("_w")
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice("_w", a + 1, p), F.ceil((n - a) / p).cast("int")))
    whole = F.array_join(F.concat(F.slice("_w", F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return some.select("doc_id", F.when((F.col("_h") % 10 == 0) & (n > 0), whole).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """The runs of every document (its tail planted) as counts and digests."""
    found = periodic_runs(with_planted_tails(docs))
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n"))), "")
    return (found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
                         F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
            .select("doc_id", "n_runs", F.col("best.start").alias("start"), (-F.col("best.minus")).alias("length"),
                    F.col("best.period").alias("period"),
                    F.floor(F.lit(-1000) * F.col("best.minus") / F.col("best.period")).alias("exponent_milli"),
                    "runs_sha256", "collapsed_sha256"))

"""Substring dedup: windows of words counted exactly by super-k-mers.

A window is SPAN consecutive words of one document.  Its minimiser is the least
hash of the GRAM-word grams inside it, so equal windows have equal minimisers.

1. **Minimisers.** One pass counts them.  A string whose minimiser occurs once
   in the corpus holds no repeated window; a bitmap of the repeated minimisers,
   with at least MIN_BITS bits for each, tells most of these strings apart.  It
   is broadcast up to BITMAP_BYTES; beyond that all strings travel.
2. **Packing.** Consecutive windows of a document with the same minimiser
   travel as one packed string, the slice of the text that they cover, to the
   bucket of the minimiser.  A task packs all strings of some megabytes of text
   that go to the same bucket into one compressed row.
3. **Counting.** A bucket ranks its strings' 2, 4 and 8-word grams by sorting
   pairs of ranks; positions whose grams occur once drop out, and the ranks of
   the grams that make up a window are sorted into ranks of windows.  Windows of
   equal rank are equal.
4. **Frequent minimisers.** A minimiser of more than FREQUENT strings would
   make its bucket heavy.  Its windows are counted by a plain aggregate of
   their 128-bit hashes instead, which is combined before the shuffle.  The list
   of these minimisers holds at most LIST entries (the bound of strings rises
   if there were more).
5. **Removal.** Repeated windows come back as word ranges per text (by the
   128-bit digest of the text, so copies of a text share them) and are joined
   with the documents; every covered word is removed.

The number of buckets grows with the text; a bucket holds about BUCKET_BYTES.

Defined cases: null, empty and short texts have no window and stay whole;
windows never cross documents; repeated rows, and rows that repeat a doc_id,
count as documents of their own, so their windows are repeated; a window that
starts twice in one document is repeated; an empty table gives an empty one;
other columns are ignored.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoich.llm.common import bounded_batches, materialise, shared
from stoich.llm.words import Words, give_back, joined, mix64, text_chunks

SPAN = 35
GRAM = 8
FREQUENT = 20_000
LIST = 1_000_000
MIN_BITS, BITS = 4, 16          # bits of the bitmap per repeated minimiser
BITMAP_BYTES = 64 << 20
BROADCAST_ROWS = 500_000
MAX_PARTITIONS = 50_000
BUCKET_BYTES = 12 << 20
HELD_BYTES = 16 << 20           # packed strings that a task holds back
OVERLAP = 3.2                   # bytes of packed strings per byte of text
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def _rolled(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Hash of every ``n`` consecutive words, by repeated doubling."""
    out, have, length, part = None, 0, 1, h
    while length <= n:
        if n & length:
            if out is None:
                out, have = part, length
            else:
                m = len(part) - have
                out, have = out[:m] + part[have:have + m] * _power(base, have), have + length
        m = max(0, len(part) - length)
        part, length = part[:m] + part[length:length + m] * _power(base, length), 2 * length
    return out[:max(0, len(h) - n + 1)]


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Least of every ``n`` consecutive values, by repeated doubling."""
    length = 1
    while 2 * length <= n:
        h = np.minimum(h[:-length], h[length:])
        length *= 2
    rest = n - length
    return np.minimum(h[:len(h) - rest], h[rest:])


class Strings:
    """Super-k-mers of a batch: ``first`` word, ``count`` of windows, the
    ``key`` (minimiser) of every one, and how often the minimiser ``stands`` in
    it, in text order.  (Where it stands twice, a window may be repeated.)"""

    def __init__(self, words: Words, span: int, gram: int):
        counts = words.counts()
        n = len(words.start)
        self.hashes = words.hashes(lower=False)
        self.first = self.count = np.zeros(0, np.int64)
        self.key = self.stands = np.zeros(0, np.int64)
        if n < span:
            return
        grams = mix64(_rolled(self.hashes, gram, _ODD[0])).view(np.int64)
        least = _least(grams, span - gram + 1)
        stop = np.repeat(words.first[1:], counts)
        good = np.arange(len(least)) + span <= stop[:len(least)]
        begin = good.copy()
        begin[1:] &= ~good[:-1] | (least[1:] != least[:-1]) | (stop[1:len(least)] != stop[:len(least) - 1])
        self.first = np.flatnonzero(begin)
        ends = good.copy()
        ends[:-1] &= begin[1:] | ~good[1:]
        self.count = np.flatnonzero(ends) + 1 - self.first
        self.key = least[self.first]
        places = self.count + span - gram
        same = grams[_spread(self.first, places)] == np.repeat(self.key, places)
        self.stands = np.add.reduceat(same, np.cumsum(places) - places, dtype=np.int64) if len(places) else places


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from text_chunks(batch.rename_columns([f"c{i}" for i in range(batch.num_columns)]),
                               column=f"c{column}", limit=1 << 20)


class Minimisers:
    """What a task knows of the corpus: which minimisers are frequent (a sorted
    list), and which are repeated (a bitmap, or none)."""

    def __init__(self, frequent: np.ndarray, bits: int, bitmap: np.ndarray | None):
        self.frequent, self.bits, self.bitmap = frequent, bits, bitmap

    def is_frequent(self, key: np.ndarray) -> np.ndarray:
        return np.isin(key, self.frequent)

    def may_repeat(self, key: np.ndarray) -> np.ndarray:
        if self.bitmap is None:
            return np.ones(len(key), bool)
        at = _address(key, self.bits)
        return (self.bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _address(key: np.ndarray, bits: int) -> np.ndarray:
    return mix64(key.view(np.uint64) + _ODD[2]) >> np.uint64(64 - bits)


def _bitmap(repeated: DataFrame, most_bytes: int) -> tuple[int, np.ndarray | None]:
    """The bitmap of repeated minimisers, built in slices by tasks."""
    n = repeated.count()
    bits = max(13, int(np.ceil(np.log2(max(1, n * BITS)))))
    bits = min(bits, int(np.log2(most_bytes * 8)))
    if n * MIN_BITS > 1 << bits:
        return bits, None
    slices = min(10, bits - 12)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _address(batch.column(0).to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(bits - slices)).astype(np.int64)),
                                              pa.array(at.astype(np.int64))], names=["slice", "at"])

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        flags = np.zeros(1 << (bits - slices), np.uint8)
        flags[table.column("at").to_numpy() - (key[0].as_py() << (bits - slices))] = 1
        return pa.table({"slice": [key[0].as_py()], "flags": [np.packbits(flags, bitorder="little").tobytes()]})

    out = np.zeros(1 << (bits - 3), np.uint8)
    step = 1 << (bits - slices - 3)
    found = (repeated.select("key").mapInArrow(build, "slice long, at long").groupBy("slice")
             .applyInArrow(fill, "slice long, flags binary"))
    for i, flags in found.toLocalIterator():
        out[i * step:(i + 1) * step] = np.frombuffer(flags, np.uint8)
    return bits, out


def minimisers(texts: DataFrame, span: int, gram: int, frequent: int, bitmap_bytes: int) -> Minimisers:
    """Minimisers that stand in more than ``frequent`` places of strings, LIST
    at most, and the bitmap of those that stand in two or more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 1):
            found = Strings(Words(part.column(1)), span, gram)
            keys, of = np.unique(found.key, return_inverse=True)
            n = np.bincount(of, found.stands, len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    repeated = materialise(texts.mapInArrow(scan, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
                           .where("n > 1"))
    while repeated.where(F.col("n") > frequent).limit(LIST + 1).count() > LIST:
        frequent = max(1, 2 * frequent)
    listed = np.array([r[0] for r in repeated.where(F.col("n") > frequent).select("key").collect()], np.int64)
    return Minimisers(np.sort(listed), *_bitmap(repeated, bitmap_bytes))


def _packed(texts: DataFrame, listed, n_buckets: int, span: int, gram: int) -> DataFrame:
    """Rows (bucket, blob): strings of one task's texts, compressed."""

    def ship(held: list[tuple]) -> pa.RecordBatch:
        """One row per bucket; ``low`` and ``high`` are places in ``data``."""
        bucket, low, high, word, key, data = (np.concatenate([h[i] for h in held]) for i in range(6))
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        parts = [order[a:b] for a, b in zip(cut, np.append(cut[1:], len(order)))]
        blobs = [_compressed(data[_spread(low[p], high[p] - low[p])], high[p] - low[p], word[p], key[p]) for p in parts]
        return pa.RecordBatch.from_arrays([pa.array(bucket[order][cut]), pa.array(blobs, pa.binary())],
                                          names=["bucket", "blob"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = listed.value
        held, size, n_bytes = [], 0, 0
        for part in _parts(batches, 1):
            words = Words(part.column(1))
            found = Strings(words, span, gram)
            mine = np.flatnonzero(known.may_repeat(found.key) & ~known.is_frequent(found.key))
            if not len(mine):
                continue
            first = found.first[mine]
            low, high = words.start[first], words.end[first + found.count[mine] + span - 2]
            owner = np.searchsorted(words.first, first, side="right") - 1
            keys = np.frombuffer(b"".join(part.column(0).to_pylist()), "V16")
            # of the text only what the strings cover is held
            inside = np.zeros(len(words.data) + 1, np.int32)
            np.add.at(inside, low, 1)
            np.add.at(inside, high, -1)
            inside = np.cumsum(inside[:-1]) > 0
            place = np.concatenate(([0], np.cumsum(inside))) + n_bytes
            held.append((np.mod(found.key[mine], n_buckets), place[low], place[high],
                         first - words.first[owner], keys[owner], words.data[inside]))
            size += int((high - low).sum())
            n_bytes += len(held[-1][5])
            if size >= HELD_BYTES:
                yield ship(held)
                held, size, n_bytes = [], 0, 0
                give_back()
        if held:
            yield ship(held)
        give_back()

    return texts.mapInArrow(scan, "bucket long, blob binary")


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of all stretches, one after another."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers, all lowest bytes first: the high bytes are mostly zero."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel()


def _compressed(letters: np.ndarray, sizes: np.ndarray, word: np.ndarray, key: np.ndarray) -> bytes:
    """Strings (bytes and sizes) with the digests of their texts and their
    first words, as one zstd frame."""
    raw = b"".join([np.array([len(letters), len(sizes)], np.int64).tobytes(), letters.tobytes(), _planes(sizes),
                    _planes(word), key.tobytes()])
    return np.array([len(raw)], np.int64).tobytes() + pa.Codec("zstd").compress(raw, asbytes=True)


def _restored(blob: bytes) -> tuple[np.ndarray, ...]:
    """(hash of every word, words per string, first words, digests)."""
    raw = pa.Codec("zstd").decompress(blob[8:], int(np.frombuffer(blob[:8], np.int64)[0]), asbytes=True)
    n_bytes, n = (int(v) for v in np.frombuffer(raw, np.int64, 2))
    at = 16 + n_bytes
    sizes, word = (_from_planes(raw, n, at + 4 * n * i).astype(np.int64) for i in (0, 1))
    key = np.frombuffer(raw, "V16", n, at + 8 * n)
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    hashes, counts = [], []
    for a, b in _stretches(cuts):       # hashing takes several times the bytes it reads
        words = Words(pa.LargeStringArray.from_buffers(
            b - a, pa.py_buffer(cuts[a:b + 1] - cuts[a]), pa.py_buffer(raw[16 + cuts[a]:16 + cuts[b]])))
        hashes.append(words.hashes(lower=False))
        counts.append(words.counts())
    return np.concatenate(hashes), np.concatenate(counts), word, key


def _stretches(cuts: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of strings of about ``size`` bytes."""
    at = 0
    while at < len(cuts) - 1:
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + size, side="right")) - 1)
        yield at, to
        at = to


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs of dense ranks."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b,
                     return_inverse=True)[1].astype(np.int32)


def repeated_windows(ids: np.ndarray, first: np.ndarray, span: int) -> np.ndarray:
    """Positions where a window of ``ids`` starts that starts elsewhere too;
    string ``i`` is ``ids[first[i]:first[i + 1]]``."""
    n = len(ids)
    stop = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + span <= stop)
    if not len(at):
        return at
    base, length = ids.astype(np.int32), 1
    while 4 * length < span and length < 8:
        base = _pairs(base, np.append(base[length:], np.zeros(length, base.dtype)))
        length *= 2
    lone = np.bincount(base)[base] < 2
    steps = [*range(0, span - length, length), span - length]
    for s in steps:
        at = at[~lone[at + s]]
    if not len(at):
        return at
    rank = base[at]
    for s in steps:
        rank = _pairs(rank, base[at + s]) if s else rank
        twice = np.bincount(rank)[rank] > 1
        at, rank = at[twice], rank[twice]
        if not len(at):
            return at
    return at


def _ranges(text: np.ndarray, word: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows at (text, word), sorted, as rows (text, from, to) of words."""
    new = np.ones(len(word), bool)
    new[1:] = (text[1:] != text[:-1]) | (word[1:] > word[:-1] + span)
    first = np.flatnonzero(new)
    last = np.append(first, len(word))[1:] - 1
    return text[first], word[first], word[last] + span


def _repeated_ranges(table: pa.Table, span: int) -> pa.Table:
    """(text_key, low, high) of the repeated windows of one bucket."""
    blobs = [_restored(b.as_py()) for b in table.column("blob")]
    hashes, size, word, key = (np.concatenate([b[i] for b in blobs]) for i in range(4))
    del blobs
    ids = np.unique(hashes, return_inverse=True)[1].astype(np.int32)
    del hashes
    first = np.concatenate(([0], np.cumsum(size)))
    at = repeated_windows(ids, first, span)
    string = np.searchsorted(first, at, side="right") - 1
    string, low, high = _ranges(string, at - first[string] + word[string], span)
    return pa.table({"text_key": pa.array([k.tobytes() for k in key[string]], pa.binary()),
                     "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())})


def _from_buckets(packed: DataFrame, span: int) -> DataFrame:
    def count(table: pa.Table) -> pa.Table:
        out = _repeated_ranges(table, span)
        give_back()
        return out

    return packed.groupBy("bucket").applyInArrow(count, "text_key binary, low long, high long")


def _from_frequent(texts: DataFrame, listed, span: int, gram: int) -> DataFrame:
    """Ranges of repeated windows whose minimiser is listed."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = listed.value
        for part in _parts(batches, 1):
            words = Words(part.column(1))
            found = Strings(words, span, gram)
            mine = known.is_frequent(found.key)
            n = found.count[mine]
            if not len(n):
                continue
            at = np.repeat(found.first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            owner = np.searchsorted(words.first, at, side="right") - 1
            ids = [mix64(_rolled(found.hashes, span, odd))[at].view(np.int64) for odd in _ODD[1:]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[0]), pa.array(ids[1]), part.column(0).take(pa.array(owner)),
                 pa.array(at - words.first[owner])], names=["a", "b", "text_key", "low"])

    windows = materialise(texts.mapInArrow(scan, "a long, b long, text_key binary, low long")
                          .groupBy("a", "b", "text_key", "low").agg(F.count(F.lit(1)).alias("n")))
    twice = materialise(windows.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("a", "b"))
    # few windows: no window of many documents has to meet them in one task
    few = twice.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return windows.join(F.broadcast(twice) if few else twice, ["a", "b"]).select("text_key", "low", (F.col("low") + span).alias("high"))


def _text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("text_key")


def repeated_ranges(docs: DataFrame, span: int = SPAN, gram: int = GRAM, frequent: int = FREQUENT,
                    bucket_bytes: int = BUCKET_BYTES, bitmap_bytes: int = BITMAP_BYTES) -> DataFrame:
    """Per text with a repeated window its key (md5) and the word ranges
    [low, high) that repeated windows cover; ranges may overlap."""
    if not 1 <= gram <= span:
        raise ValueError("a gram is at most as long as a window")
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(_text_key(), "text")
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, int(np.ceil(total * OVERLAP / bucket_bytes)))
    known = minimisers(texts, span, gram, frequent, bitmap_bytes)
    listed = shared(spark, known)
    packed = _packed(texts, listed, n_buckets, span, gram).repartition(min(n_buckets, MAX_PARTITIONS), "bucket")
    ranges = _from_buckets(packed, span)
    if len(known.frequent):
        ranges = ranges.unionByName(_from_frequent(texts, listed, span, gram))
    return ranges.distinct().groupBy("text_key").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))


def without_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, frequent: int = FREQUENT,
                    bucket_bytes: int = BUCKET_BYTES, bitmap_bytes: int = BITMAP_BYTES) -> DataFrame:
    """Per document doc_id, n_words, n_removed and the kept text, its words
    joined by one space."""
    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    ranges = repeated_ranges(plain, span, gram, frequent, bucket_bytes)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 1):
            words = Words(part.column(1))
            keep = np.ones(len(words.start), bool)
            for i, some in enumerate(part.column(2)):
                for r in some.as_py() or ():
                    keep[words.first[i] + r["low"]:words.first[i] + r["high"]] = False
            left = np.diff(np.concatenate(([0], np.cumsum(keep)))[words.first])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words.counts()), pa.array(words.counts() - left),
                 joined(words, keep).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return (plain.select("doc_id", "text", _text_key()).join(ranges, "text_key", "left")
            .select("doc_id", "text", "ranges")
            .mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string"))

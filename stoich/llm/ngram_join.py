"""Near copies by word shingles: T-occurrence search with DivideSkip.

A document's set holds the hashes of its distinct five-word shingles.  Two sets
link when their Jaccard similarity is at least 3/4, that is when the overlap
reaches ``T = ceil(3 (|x| + |y|) / 7)``.

1. **List lengths.** One pass counts how many documents hold each shingle (the
   length of its inverted list).  The hash space is cut into ranges; tasks ship
   sorted, delta-coded hashes per range, each range counts its own.  The driver
   receives two tables of fixed size: which shingles occur in two documents or
   more, and the logarithm of the count of those in four or more.
2. **Unreachable sets.** A shingle in one document only is in no overlap.  A
   set whose other shingles cannot reach 3/4 of its size links with nothing;
   its shingles are never stored or shuffled.
3. **Classes.** Equal sets form a class; one row stands for it from here on.
4. **Candidates.** All sets are ordered shortest list first; only the first
   ``|x| - ceil(3|x|/4) + 1`` shingles of a set can be the first one that it
   shares with a partner, so only these are indexed.  Short lists give all
   their pairs that the length and position bounds admit; of a long list every
   entry is paired with the list's most central entry only.
5. **T-occurrence search.** A class (the query) is searched in the inverted
   lists of its candidates, in parts of bounded size: DivideSkip sets the
   longest lists aside, heap-merges the short ones, and probes the long ones by
   binary search for the candidates that can still reach T.
6. **Rest of the long lists.** A long list's entries outside its largest
   component are searched, the same way, among all entries of the lists with
   that largest component, dealt in blocks: every set travels once per block,
   no pair is ever a row.  So every pair that shares a list is either searched
   or already connected.

Defined cases: null, empty and blank texts have an empty set, are linked with
nothing and are their own component; with one to four words the whole sequence
is the only shingle; repeated rows and equal texts are linked; rows that repeat
a doc_id stay apart but share the smallest doc_id of their component; other
columns are ignored.  Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoich.llm.common import bounded_batches, materialise, shared
from stoich.llm.components import connected_components
from stoich.llm.words import Words, mix64, shingle_sets, text_chunks

WORDS = 5
SHORT_LIST = 8
PART = 128
BLOCK = 256
CLASS_BITS = 24          # entries of the list-length table (bytes)
REPEAT_BITS = 27         # entries of the occurs-twice table (bits)
SLOT_BITS = 28           # hash bits that a range tells apart
RANGE_SHINGLES = 1 << 21
BROADCAST_ROWS = 200_000


# -- 1. list lengths ---------------------------------------------------------

def _range_bits(total_bytes: int) -> int:
    """log2 of the number of hash ranges: about RANGE_SHINGLES per range."""
    return int(np.clip(np.ceil(np.log2(max(1, total_bytes / 6 / RANGE_SHINGLES))), 6, CLASS_BITS - 3))


def _pack(slots: np.ndarray) -> bytes:
    """Sorted slots as deltas, lowest bytes of all first: the high bytes are
    mostly zero and vanish in the shuffle's compression."""
    return np.diff(slots, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


class ListLengths:
    """The two fixed-size tables, addressed by the top bits of a hash."""

    def __init__(self, classes: np.ndarray, repeated: np.ndarray):
        self.classes, self.repeated = classes, repeated

    def alone(self, h: np.ndarray) -> np.ndarray:
        """True where a shingle certainly occurs in one document only."""
        at = h >> np.uint64(64 - REPEAT_BITS)
        return (self.repeated[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 0

    def order(self, h: np.ndarray) -> np.ndarray:
        """Positions of sorted distinct hashes, shortest list first."""
        return np.argsort(self.classes[h >> np.uint64(64 - CLASS_BITS)], kind="stable")


def list_lengths(texts: DataFrame, n: int = WORDS) -> ListLengths:
    spark = texts.sparkSession
    total = texts.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _range_bits(total)

    def ship(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(held))
        slot = ((h << np.uint64(bits)) >> np.uint64(64 - SLOT_BITS)).astype(np.uint32)
        cut = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cut))
        return pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()), pa.array([_pack(slot[cut[r]:cut[r + 1]]) for r in some], pa.binary())],
            names=["range", "blob"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in text_chunks(batch):
                for s in shingle_sets(Words(part.column(0)), n):
                    held.append(s)
                    size += len(s)
                if size >= RANGE_SHINGLES:
                    yield ship(held)
                    held, size = [], 0
        if size:
            yield ship(held)

    def count(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        slots = np.sort(np.concatenate([_unpack(b) for b in frame["blob"]]))
        first = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1])))
        times = np.diff(np.append(first, len(slots)))
        slots = slots[first]
        flags = np.zeros(1 << (REPEAT_BITS - bits), np.uint8)
        flags[slots[times >= 2] >> np.uint32(SLOT_BITS - REPEAT_BITS + bits)] = 1
        classes = np.zeros(1 << (CLASS_BITS - bits), np.uint8)
        many = times >= 4
        np.maximum.at(classes, slots[many] >> np.uint32(SLOT_BITS - CLASS_BITS + bits),
                      np.log2(times[many]).astype(np.uint8))
        return pd.DataFrame({"range": [key[0]], "flags": [np.packbits(flags, bitorder="little").tobytes()],
                             "classes": [classes.tobytes()]})

    found = (texts.select("text").mapInArrow(scan, "range long, blob binary").groupBy("range")
             .applyInPandas(count, "range long, flags binary, classes binary"))
    classes = np.zeros(1 << CLASS_BITS, np.uint8)
    repeated = np.zeros(1 << (REPEAT_BITS - 3), np.uint8)
    wide, deep = 1 << (CLASS_BITS - bits), 1 << (REPEAT_BITS - 3 - bits)
    for r, flags, cls in found.toLocalIterator():
        classes[r * wide:(r + 1) * wide] = np.frombuffer(cls, np.uint8)
        repeated[r * deep:(r + 1) * deep] = np.frombuffer(flags, np.uint8)
    return ListLengths(classes, repeated)


# -- 2. sets ------------------------------------------------------------------

def document_sets(texts: DataFrame, lengths, n: int = WORDS) -> DataFrame:
    """Per row doc_id, a hash of the text, n_shingles, a hash of the set, how many of its shingles
    other documents hold too (``free``), and the set itself where these can
    reach 3/4 of it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lengths.value
        for batch in batches:
            for part in text_chunks(batch):
                size, sig, free, sets = [], [], [], []
                keys = [0 if t is None else int.from_bytes(blake2b(t.encode("utf-8"), digest_size=8).digest(),
                                                           "little", signed=True)
                        for t in part.column(1).to_pylist()]
                for s in shingle_sets(Words(part.column(1)), n):
                    k = len(s) - int(table.alone(s).sum())
                    size.append(len(s))
                    free.append(k)
                    sig.append(mix64(np.array([mix64(s).sum(dtype=np.uint64)])).view(np.int64)[0])
                    sets.append(s.view(np.int64) if len(s) and 4 * k >= 3 * len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(keys, pa.int64()), pa.array(size, pa.int64()),
                     pa.array(sig, pa.int64()), pa.array(free, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "n", "sig", "free", "shingles"])

    return texts.select("doc_id", "text").mapInArrow(
        scan, "doc_id long, text_key long, n long, sig long, free long, shingles array<long>")


# -- 4. candidates --------------------------------------------------------------

def _prefixes(sets: DataFrame, lengths) -> DataFrame:
    """Index rows (shingle, node, n, free, idx): idx counts the shared shingles
    before this one in the order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lengths.value
        for batch in batches:
            rows = []
            for node, n, free, s in zip(*(batch.column(i) for i in range(4))):
                n, free = n.as_py(), free.as_py()
                h = s.values.to_numpy().view(np.uint64)
                h = h[~table.alone(h)]
                p = n - (3 * n + 3) // 4 + 1 - (n - free)
                own = h[table.order(h)[:p]].view(np.int64)
                rows.append((own, np.full(len(own), node.as_py()), np.full(len(own), n),
                             np.full(len(own), free), np.arange(len(own))))
                if len(rows) >= 256:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return sets.select("node", "n", "free", "shingles").mapInArrow(
        scan, "shingle long, node long, n long, free long, idx long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows)]
    return pa.RecordBatch.from_arrays(cols, names=["shingle", "node", "n", "free", "idx"])


def _admissible(n1, f1, i1, n2, f2, i2):
    """Whether two entries of one list can still reach the overlap T."""
    most = np.minimum(np.minimum(f1, f2),
                      np.minimum(i1, i2) + 1 + np.minimum(f1 - i1 - 1, f2 - i2 - 1))
    return 7 * most >= 3 * (n1 + n2)


def _pairs_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries come list by list, most central first.  Emits candidate pairs
    (shingle null), and the entries of long lists (y null).  Only the open
    list's first SHORT_LIST + 1 entries are held."""

    def out(x, y, rows=None) -> pa.RecordBatch:
        if rows is None:
            pair = np.unique(np.stack([x, y]), axis=1)
            cols = [pa.array(pair[0]), pa.array(pair[1]), pa.nulls(pair.shape[1], pa.int64())]
        else:
            cols = [pa.array(x), pa.nulls(len(x), pa.int64()), pa.array(rows[:, 0])]
        return pa.RecordBatch.from_arrays(cols, names=["x", "y", "shingle"])

    held = np.zeros((0, 5), np.int64)   # rows of the open list: shingle, node, n, free, idx
    is_long = False                     # whether the open list's entries were already emitted
    for batch in batches:
        new = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        rows = np.concatenate([held, new])
        if not len(rows):
            continue
        first = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
        size = np.diff(np.append(first, len(rows)))
        owner = np.repeat(np.arange(len(first)), size)
        nth = np.arange(len(rows)) - first[owner]
        long_list = size > SHORT_LIST
        if is_long:
            long_list[0] = True
        xs, ys = [], []
        # the last list may go on in the next batch: unless long, wait
        ready = np.ones(len(first), dtype=bool)
        ready[-1] = long_list[-1]
        if (ready & ~long_list).any():
            short = rows[(ready & ~long_list)[owner]]
            for d in range(1, SHORT_LIST):
                if len(short) <= d:
                    break
                p, q = short[:-d], short[d:]
                ok = (p[:, 0] == q[:, 0]) & _admissible(p[:, 2], p[:, 3], p[:, 4], q[:, 2], q[:, 3], q[:, 4])
                xs.append(p[ok, 1])
                ys.append(q[ok, 1])
        if long_list.any():
            far = long_list[owner]
            lead = rows[first[owner[far]]]
            q = rows[far]
            ok = (nth[far] > 0) & _admissible(lead[:, 2], lead[:, 3], lead[:, 4], q[:, 2], q[:, 3], q[:, 4])
            xs.append(lead[ok, 1])
            ys.append(q[ok, 1])
            fresh = far.copy()
            if is_long:                 # the held leader was emitted before
                fresh[0] = False
            if fresh.any():
                yield out(rows[fresh, 1], None, rows[fresh])
        if xs and sum(map(len, xs)):
            yield out(np.concatenate(xs), np.concatenate(ys))
        is_long = bool(long_list[-1])
        held = rows[first[-1]:first[-1] + 1] if is_long else rows[first[-1]:]
    if len(held) > 1 and not is_long:
        xs, ys = [], []
        for d in range(1, len(held)):
            p, q = held[:-d], held[d:]
            ok = _admissible(p[:, 2], p[:, 3], p[:, 4], q[:, 2], q[:, 3], q[:, 4])
            xs.append(p[ok, 1])
            ys.append(q[ok, 1])
        if sum(map(len, xs)):
            yield out(np.concatenate(xs), np.concatenate(ys))


# -- 5. search ----------------------------------------------------------------------

class InvertedLists:
    """Per shingle the sorted list of the members that hold it."""

    def __init__(self, members: list[np.ndarray]):
        self.sizes = np.array([len(m) for m in members])
        flat = np.concatenate(members)
        order = np.argsort(flat, kind="stable")
        self.shingle = flat[order]
        self.entry = np.repeat(np.arange(len(members)), self.sizes)[order]

    def search(self, query: np.ndarray, mu: float = 0.0085) -> list[tuple[int, int]]:
        """(member, overlap) of the members that reach T with the query, by
        DivideSkip: the longest lists are set aside, the others heap-merged,
        and what may still reach T is probed in the long ones."""
        need = -(-3 * (len(query) + self.sizes) // 7)
        possible = need <= np.minimum(len(query), self.sizes)
        if not possible.any():
            return []
        start = np.searchsorted(self.shingle, query, "left")
        length = np.searchsorted(self.shingle, query, "right") - start
        least = int(need[possible].min())
        longest = max(2, int(length.max()))
        aside = min(least - 1, int(least / (mu * np.log2(longest) + 1)))
        by_length = np.argsort(-length, kind="stable")
        by_length = by_length[:np.count_nonzero(length)]
        lists = [self.entry[start[k]:start[k] + length[k]] for k in by_length]
        seen: dict[int, int] = {}
        for member in heapq.merge(*(x.tolist() for x in lists[aside:])):
            seen[member] = seen.get(member, 0) + 1
        left = np.array([m for m, t in seen.items() if possible[m] and t >= need[m] - aside], np.int64)
        if not len(left):
            return []
        times = np.array([seen[m] for m in left.tolist()])
        for x in lists[:aside]:
            at = np.minimum(np.searchsorted(x, left), len(x) - 1)
            times += x[at] == left
        reached = times >= need[left]
        return list(zip(left[reached].tolist(), times[reached].tolist()))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, part, node, is_member, is_query, shingles) come group part
    by group part: every query is searched among the part's members."""
    at: tuple | None = None
    queries: list[tuple[int, np.ndarray]] = []
    members: list[tuple[int, np.ndarray]] = []

    def close() -> list[tuple[int, int, int]]:
        if not queries or not members:
            return []
        lists = InvertedLists([s for _, s in members])
        return [(q, members[m][0], overlap) for q, s in queries
                for m, overlap in lists.search(s) if members[m][0] != q]

    for batch in batches:
        links = []
        keys = zip(*(batch.column(i).to_pylist() for i in range(5)))
        for (group, part, node, is_member, is_query), s in zip(keys, batch.column(5)):
            if at != (group, part):
                links += close()
                at, queries, members = (group, part), [], []
            h = s.values.to_numpy().view(np.uint64).copy()
            if is_member:
                members.append((node, h))
            if is_query:
                queries.append((node, h))
        if links:
            yield _links(links)
    if links := close():
        yield _links(links)


def _links(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "b", "overlap"])


def _search_groups(wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b, overlap) found in the groups ``wanted`` (group, part, node,
    is_member, is_query)."""
    rows = sets.select(F.col("node").alias("_n"), "shingles").join(
        _few(materialise(wanted)), F.col("node") == F.col("_n"))
    return (rows.select("group", "part", "node", "is_member", "is_query", "shingles").repartition("group", "part")
            .sortWithinPartitions("group", "part").mapInArrow(_search, "a long, b long, overlap long"))


def search_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among candidate pairs (x, y): x is searched among its y, in parts
    of about PART."""
    parts = pairs.groupBy(F.col("x").alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    dealt = pairs.join(parts, F.col("x") == F.col("_x")).select(
        F.col("x").alias("group"), F.pmod(F.xxhash64("y"), F.ceil(F.col("_c") / PART)).alias("part"), "y")
    yes, no = F.lit(True), F.lit(False)
    return _search_groups(
        dealt.select("group", "part", F.col("y").alias("node"), yes.alias("is_member"), no.alias("is_query"))
        .unionAll(dealt.select("group", "part").distinct().select(
            "group", "part", F.col("group").alias("node"), no.alias("is_member"), yes.alias("is_query"))), sets)


def search_rest(entries: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links of long-list entries (shingle, node) outside their list's largest
    component with the entries of all lists that have this component."""
    placed = materialise(entries.join(roots, "node", "left")
                         .select("shingle", "node", F.coalesce("root", "node").alias("root")))
    sizes = placed.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("_c"))
    main = sizes.groupBy("shingle").agg(F.max_by("root", F.struct("_c", "root")).alias("group"),
                                        F.count(F.lit(1)).alias("_parts")).where("_parts > 1").drop("_parts")
    nodes = materialise(placed.join(main, "shingle").groupBy("group", "node").agg(
        F.max(F.col("root") != F.col("group")).alias("is_query")))
    if nodes.isEmpty():
        return None
    blocks = nodes.groupBy("group").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).alias("_m"),
        F.greatest(F.lit(1), F.ceil(F.sum(F.col("is_query").cast("int")) / BLOCK)).alias("_q"))
    dealt = nodes.join(blocks, "group").withColumn("_h", F.xxhash64("node"))
    m, q = F.pmod("_h", F.col("_m")), F.pmod("_h", F.col("_q"))
    zero = F.lit(0).cast("bigint")
    # part = member block * query blocks + query block
    member = dealt.withColumn("_o", F.explode(F.sequence(zero, F.col("_q") - 1))).select(
        "group", (m * F.col("_q") + F.col("_o")).alias("part"), "node", F.lit(True).alias("is_member"),
        F.lit(False).alias("is_query"))
    query = dealt.where("is_query").withColumn("_o", F.explode(F.sequence(zero, F.col("_m") - 1))).select(
        "group", (F.col("_o") * F.col("_q") + q).alias("part"), "node", F.lit(False).alias("is_member"),
        F.lit(True).alias("is_query"))
    return _search_groups(member.unionAll(query), sets)


# -- the join ------------------------------------------------------------------------

def near_copies(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, a hash of the
    text, and whether the document is its component's first."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    lengths = shared(spark, list_lengths(texts, n))
    sets = materialise(document_sets(texts, lengths, n).withColumn("node", F.monotonically_increasing_id()))
    live = sets.where("shingles IS NOT NULL")
    classes = materialise(live.groupBy("sig", "n").agg(F.min("node").alias("rep")))
    reps = classes.select(F.col("rep").alias("node"))
    entries = _prefixes(live, lengths).join(reps, "node", "left_semi")
    found = materialise(
        entries.select("shingle", "node", "n", "free", "idx").repartition("shingle")
        .sortWithinPartitions("shingle", F.col("n") - F.col("free"), "n", "node")
        .mapInArrow(_pairs_of_lists, "x long, y long, shingle long"))
    pairs = materialise(found.where("y IS NOT NULL").select("x", "y").distinct())
    links = materialise(search_pairs(pairs, live).select("a", "b"))
    rest = search_rest(found.where("y IS NULL").select("shingle", F.col("x").alias("node")),
                       connected_components(links), live)
    if rest is not None:
        links = links.unionAll(materialise(rest.select("a", "b")))
    roots = connected_components(links).withColumnRenamed("node", "rep")
    member = (live.select("doc_id", "text_key", "n", "sig").join(classes, ["sig", "n"])
              .join(roots, "rep", "left").select("doc_id", "text_key", "n", F.coalesce("root", "rep").alias("root")))
    member = materialise(member)
    first = member.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    linked = member.join(first, "root").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), "text_key",
        F.col("first").eqNullSafe(F.struct("doc_id", "text_key")).alias("kept"))
    single = sets.where("shingles IS NULL").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_key",
        F.lit(True).alias("kept"))
    return linked.unionAll(single)


def one_of_each(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """``docs`` with one document of every component: the one with the smallest
    doc_id (rows that repeat it: the smallest hash of the text, once).

    Only the few rows that go, or stand more than once, travel back to the
    texts: by broadcast while they are few, else by a join on doc_id."""
    verdict = materialise(near_copies(docs, n).select("doc_id", "text_key", "kept", "n_shingles"))
    ids = F.col("doc_id").cast("bigint")
    key = [F.col("doc_id").alias("__id"), F.col("text_key").alias("__text_key")]
    dropped = verdict.where("NOT kept").select(*key).distinct()
    again = (verdict.where("kept AND n_shingles > 0").groupBy(*key)
             .agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    special = materialise(dropped.withColumn("_keep", F.lit(False)).unionAll(again.withColumn("_keep", F.lit(True))))
    repeated = materialise(verdict.groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("_n"))
                           .where("_n > 1").select("__id"))
    # an id that stands once needs no text to be told apart
    alone = special.where("NOT _keep").join(repeated, "__id", "left_anti").select("__id")
    rows = docs.join(_few(alone), ids.eqNullSafe(F.col("__id")), "left_anti")
    if repeated.isEmpty():
        return rows
    twins = rows.join(_few(repeated), ids.eqNullSafe(F.col("__id")), "left_semi").withColumn(
        "__own_key", _text_key("text"))
    gone = special.where("NOT _keep").select("__id", "__text_key")
    keep_once = special.where("_keep").select("__id", "__text_key")
    match = ids.eqNullSafe(F.col("__id")) & (F.col("__own_key") == F.col("__text_key"))
    twins = twins.join(gone, match, "left_anti")
    once = twins.join(keep_once, match, "left_semi").dropDuplicates(["doc_id", "__own_key"])
    rest = twins.join(keep_once, match, "left_anti")
    return (rows.join(_few(repeated), ids.eqNullSafe(F.col("__id")), "left_anti")
            .unionByName(once.unionByName(rest).drop("__own_key")))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _text_key(column: str):
    """The hash that ``document_sets`` gives a text."""

    @F.pandas_udf("long")
    def key(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: 0 if t is None else int.from_bytes(
            blake2b(t.encode("utf-8"), digest_size=8).digest(), "little", signed=True)).astype("int64")

    return key(F.col(column))

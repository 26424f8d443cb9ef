"""Personal data: patterns, and the terms that give protected entities away.

The patterns find e-mail addresses, IP addresses, payment cards and phone
numbers.  Every distinct value found is a protected entity.  How strongly a
term reveals an entity is estimated from whole documents: the pointwise mutual
information of the two, ``log2 N p(entity | term) / df(entity)``, against the
entity's information content ``log2 N / df(entity)``.  ``p(entity | term)`` is
smoothed, ``co / (df(term) + SMOOTHING)``, so that few sightings weigh less
than many and no entity is too rare to be judged.  A share of 1 means that the
term surely occurs nowhere without the entity.  In every document that holds
the entity, all places of a term whose share reaches ``GENERALISE`` are
replaced by a placeholder, of one that reaches ``REMOVE`` removed.  Documents
with one and the same text count once: copies are no evidence.  A term is a
word without the punctuation around it, A-Z as a-z.

One pass reads the texts; it emits each row's spans, the words of the rows that
hold an entity (and, for ``find``, their text), and how many texts hold each
word (summed per task, then per word).  A term in more than
``N^(1-GENERALISE) df(entity)^GENERALISE`` texts cannot reach the threshold and
is dropped before pairs are made; pairs of entity and term are counted by
partial aggregation.

Defined cases: a null text is empty and has no span; spans count code points,
ends exclusive; matches that fail a kind's check are dropped without another
try; spans of different kinds may overlap; an entity in every document reveals
nothing; repeated rows count each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoich.llm.common import bounded_batches, materialise, packed
from stoich.llm.words import Words, text_chunks

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
SMOOTHING = 2.0
GENERALISE = 0.8
REMOVE = 0.95
BROADCAST_ROWS = 200_000
BROADCAST_LISTS = 20_000    # rows that hold a list of terms
DULL = 8                    # documents with an entity that make a term worth dropping early

# The patterns of the kinds.  The look-behind starts a match only where a run
# of digits starts, which changes no match and keeps long runs linear.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their ``@``."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    spans = [("email", a, z) for a, z in emails(text)] if "@" in text else []
    spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
              if all(len(n := x.lstrip("0") or "0") <= 3 and int(n) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
    if "+" in text:
        spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text)
                  if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return spans


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def _long(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


_SCAN = ("row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, "
         "ctx long, entities array<long>, terms array<long>, text string, word long, df long")
_EDGE = np.zeros(256, dtype=bool)
_EDGE[list(b".,;:!?\"'()[]{}<>|*#$%&")] = True


def core_words(texts: pa.Array) -> Words:
    """Words without the punctuation around them; some may be left empty."""
    words = Words(texts)
    cut = np.flatnonzero(_EDGE[words.data[words.start]] | _EDGE[words.data[words.end - 1]])
    solid = np.flatnonzero(~_EDGE[words.data])
    start, end = words.start[cut], words.end[cut]
    after = np.searchsorted(solid, start)
    until = np.searchsorted(solid, end)
    words.start[cut] = np.where(after < until, np.append(solid, 0)[after], start)
    words.end[cut] = np.where(after < until, solid[until - 1] + 1 if len(solid) else start, start)
    return words


def _places(words: Words, i: int, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words of text ``i`` that are neither empty nor part of a
    span, and where each begins and ends in the text."""
    k = np.arange(words.first[i], words.first[i + 1])
    k = k[words.end[k] > words.start[k]]
    base, end = int(words.off[i]), int(words.off[i + 1])
    point = np.cumsum((words.data[base:end] & 0xC0) != 0x80)        # code points up to and with each byte
    start, stop = point[words.start[k] - base] - 1, point[words.end[k] - base - 1]
    free = np.ones(len(k), dtype=bool)
    for _, s, e in spans:
        free[np.searchsorted(stop, s, "right"):np.searchsorted(start, e, "left")] = False
    return k[free], start[free], stop[free]


def _terms(text: str, spans: list[tuple[str, int, int]], words: Words, hashes: np.ndarray, i: int) -> np.ndarray:
    """Distinct hashes of the words that can be terms."""
    k, start, stop = _places(words, i, spans)
    fit = [any(map(str.isalpha, text[a:z])) for a, z in zip(start.tolist(), stop.tolist())]
    return np.unique(hashes[k[np.array(fit, dtype=bool) & (stop - start >= 3)]]).view(np.int64)


def _found(texts: list[str | None], terms: list[list[dict] | None]) -> list[list[tuple[int, int, bool]]]:
    """(start, end, removed) of every place of each text's terms, by start."""
    out: list[list[tuple[int, int, bool]]] = [[] for _ in texts]
    some = [i for i, t in enumerate(terms) if t and texts[i]]
    words = core_words(pa.array([texts[i] for i in some], pa.large_string()))
    hashes = words.hashes().view(np.int64)
    for n, i in enumerate(some):
        removed = {t["term"]: t["removed"] for t in terms[i]}
        k, start, stop = _places(words, n, base_spans(texts[i]))
        hit = np.isin(hashes[k], np.fromiter(removed, np.int64, len(removed)))
        out[i] = [(a, z, removed[h]) for a, z, h in
                  zip(start[hit].tolist(), stop[hit].tolist(), hashes[k[hit]].tolist())]
    return out


def scan(rows: DataFrame, with_text: bool = False) -> DataFrame:
    """One pass over (row, doc_id, text): a line per row with its spans and, if
    there are any, a hash of its text, its entities and its terms (word null),
    and lines (word, df) counting the texts that hold each word (row null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def counts() -> pa.RecordBatch:
            u, inv = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            n = np.bincount(inv, np.concatenate([c for _, c in held])).astype(np.int64)
            kinds = [pa.int64()] * 6 + [pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 2, pa.string()]
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(u), k) for k in kinds), pa.array(u.view(np.int64)), pa.array(n)], names=names)

        names = ["row", "doc_id", *(f"n_{k}" for k in KINDS), "base", "ctx", "entities", "terms", "text", "word", "df"]
        for batch in batches:
            for part in text_chunks(batch):
                texts = [t or "" for t in part.column(2).to_pylist()]
                words = core_words(part.column(2))
                hashes = words.hashes()
                lines, held_here = [], []
                for i, text in enumerate(texts):
                    spans = base_spans(text)
                    lines.append([sum(s[0] == k for s in spans) for k in KINDS] + [listed(spans)])
                    held_here.append((
                        _long(text.encode()), sorted({_long(f"{k}:{text[a:z].lower()}".encode()) for k, a, z in spans}),
                        _terms(text, spans, words, hashes, i), text if with_text else None) if spans else (None,) * 4)
                cols = list(zip(*lines))
                ctx, entities, terms, own = zip(*held_here)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in cols[:4]),
                     pa.array(cols[4], pa.string()), pa.array(ctx, pa.int64()),
                     pa.array(entities, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.int64())),
                     pa.array(own, pa.string()), pa.nulls(len(texts), pa.int64()), pa.nulls(len(texts), pa.int64())], names=names)
                doc = np.repeat(np.arange(len(texts)), words.counts())
                order = np.lexsort((doc, hashes))
                h, d = hashes[order], doc[order]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else h.astype(bool)
                u, n = np.unique(h[new], return_counts=True)
                held.append((u, n))
                size += len(u)
                if size > 1 << 19:
                    yield counts()
                    held, size = [], 0
        if size:
            yield counts()

    bounded_batches(rows.sparkSession)
    return rows.select("row", F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, _SCAN)


def _few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def revealing_terms(scanned: DataFrame, smoothing: float = SMOOTHING, generalise: float = GENERALISE,
                    remove: float = REMOVE) -> DataFrame:
    """(ctx, terms): for texts that hold an entity, by the hash of the text,
    the terms (term, removed) that disclose one of its entities."""
    texts = scanned.where("row IS NOT NULL")
    held = texts.where("ctx IS NOT NULL")
    each = materialise(held.groupBy("ctx").agg(F.count(F.lit(1)).alias("copies"), F.first("entities").alias("entities"),
                                               F.first("terms").alias("terms")))
    entity = materialise(each.select(F.explode("entities").alias("entity")).groupBy("entity")
                         .agg(F.count(F.lit(1)).alias("df_entity")))
    more = each.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))).first()[0]
    n = float(max(texts.count() - more, 1))
    most = entity.agg(F.coalesce(F.max("df_entity"), F.lit(0))).first()[0]
    bound = n ** (1 - generalise) * most ** generalise * (1 + 1e-9)
    # how many texts hold a term, copies of a text that holds an entity once
    extra = (each.select("copies", F.explode("terms").alias("term")).groupBy("term")
             .agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("copies") - 1).alias("extra")))
    word = (scanned.where("word IS NOT NULL").groupBy(F.col("word").alias("term"))
            .agg(F.sum("df").alias("df")))
    word = materialise(extra.join(word, "term").select("term", "rows", (F.col("df") - F.col("extra")).alias("df_term")))
    dull = word.where((F.col("df_term") + smoothing > bound) & (F.col("rows") >= DULL)).select("term")
    rare = word.where(F.col("df_term") + smoothing <= bound).select("term", "df_term")
    told = (each.select("ctx", "entities", F.explode("terms").alias("term")).join(_few(dull), "term", "left_anti")
            .join(_few(rare), "term").select("ctx", "term", "df_term", F.explode("entities").alias("entity")))
    told = materialise(told)
    share = (F.log2(F.lit(n) * F.col("co") / (F.col("df_entity") * (F.col("df_term") + smoothing)))
             / F.log2(F.lit(n) / F.col("df_entity")))
    strong = (told.groupBy("entity", "term", "df_term").agg(F.count(F.lit(1)).alias("co"))
              .join(_few(entity), "entity").where(F.col("df_entity") < n).withColumn("share", share)
              .where(F.col("share") >= generalise)
              .select("entity", "term", (F.col("share") >= remove).alias("removed")))
    return materialise(told.join(_few(materialise(strong)), ["entity", "term"])
                       .groupBy("ctx", "term").agg(F.max("removed").alias("removed"))
                       .groupBy("ctx").agg(F.collect_list(F.struct("term", "removed")).alias("terms")))


def find(docs: DataFrame) -> DataFrame:
    """Per row doc_id, the counts per kind, base_sha256 and all spans."""
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    scanned = materialise(scan(rows, with_text=True))
    counts = [f"n_{k}" for k in KINDS]
    held = (scanned.where("ctx IS NOT NULL").drop("terms")
            .join(_few(revealing_terms(scanned), BROADCAST_LISTS), "ctx", "left")
            .select("text", "terms", "doc_id", *counts, "base"))
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base string, told string, n_term long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                found = _found(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[2:], pa.array([listed((TERM, a, z) for a, z, _ in f) for f in found], pa.string()),
                     pa.array([len(f) for f in found], pa.int64())],
                    names=["doc_id", *counts, "base", "told", "n_term"])

    rest = scanned.where("row IS NOT NULL AND ctx IS NULL").select(
        "doc_id", *counts, "base", F.lit("").alias("told"), F.lit(0).cast("bigint").alias("n_term"))
    return (held.mapInArrow(run, schema).unionByName(rest)
            .select("doc_id", *counts, F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"),
                    F.concat_ws(",", *[F.when(F.col(c) != "", F.col(c)) for c in ("base", "told")]).alias("spans"),
                    "n_term"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced in text (and n_chars brought up to
    date): patterns and generalised terms by a placeholder, removed terms by
    nothing."""
    rows = materialise(packed(docs).withColumn("row", F.monotonically_increasing_id()))
    scanned = materialise(scan(rows.select("row", "whole.doc_id", "whole.text")))
    terms = materialise(scanned.where("ctx IS NOT NULL").select(F.col("row").alias("_r"), "ctx")
                        .join(_few(revealing_terms(scanned), BROADCAST_LISTS), "ctx").select("_r", "terms"))
    joined = rows.join(_few(terms, BROADCAST_LISTS), F.col("row") == F.col("_r"), "left").select("whole", "terms")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.RecordBatch.from_arrays([*batch.column(0).flatten(), batch.column(1)], names=[*names, ""])
            for part in text_chunks(whole):
                cols = dict(zip(names, part.columns))
                texts = cols["text"].to_pylist()
                out = [None if t is None else _replace(t, f)
                       for t, f in zip(texts, _found(texts, part.columns[-1].to_pylist()))]
                cols["text"] = pa.array(out, cols["text"].type)
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([None if t is None else len(t) for t in out], cols["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    return joined.mapInArrow(run, docs.schema)


def _replace(text: str, terms: list[tuple[int, int, bool]]) -> str:
    spans = [(a, z, f"[{k.upper()}]") for k, a, z in base_spans(text)]
    spans += [(a, z, "" if removed else f"[{TERM.upper()}]") for a, z, removed in terms]
    spans.sort(key=lambda s: (s[0], -s[1]))
    out, at, upto = [], 0, 0
    for a, z, put in spans:
        if a >= upto:
            out += [text[at:a], put]
            at = upto = z
        elif z > upto:                  # overlaps the span before it
            at = upto = z
    return "".join(out) + text[at:]

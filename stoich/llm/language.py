"""Language identification by cross-parsing.

For every language a suffix automaton of a labelled sample accepts exactly the
strings that occur in the sample.  A text is parsed greedily into the longest
phrases that occur there; the language whose sample needs the fewest phrases,
normalised by ``log2`` of its length (an estimate of the cross entropy per
letter), is predicted.

The sample is bounded: at most ``SAMPLE_ROWS`` rows and ``SAMPLE_LETTERS``
symbols per language, taken from the rows with the smallest hash of doc_id, of
those that the caller allows.  Everything else covers whole texts: a text is
cut into runs of ``RUN`` symbols, all runs of a batch advance through one
transition table together, and their phrase counts add up.

Symbols are lower-case letters; everything between letters counts as one space.
Every letter of the samples is a symbol of its own: transitions by the
``DENSE_SYMBOLS`` most frequent ones are a dense table, those by all others
sorted keys that are searched.
Defined cases: null text, or a text without a letter: ``und`` with score 0;
letters that no sample holds are phrases of their own; equal figures go to the
language first by name; without any usable label every row is ``und``; lang,
source and doc_id of a predicted row play no part; repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stoich.llm.common import bounded_batches, shared
from stoich.llm.words import give_back, text_chunks

SAMPLE_ROWS = 120        # labelled rows per language
SAMPLE_LETTERS = 32_000  # of them, in equal shares of the rows
MAX_LABELS = 200         # languages, those with the most labelled rows
DENSE_SYMBOLS = 60       # letters with a column in the dense table; no bound on letters
RUN = 512
CHUNK = 1 << 20          # bytes of text whose runs advance together
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton (state 0 is the start)."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Automaton(NamedTuple):
    """Suffix automaton of one language's sample as edge arrays; symbols are
    code points of letters, and 0 for whatever lies between words."""

    state: np.ndarray
    symbol: np.ndarray
    to: np.ndarray
    n_states: int
    n_symbols: int


def sample_automaton(texts: list[str], limit: int = SAMPLE_LETTERS) -> Automaton:
    """Automaton of ``limit`` letters, equal shares of all texts (a text that
    is shorter leaves the rest of its share to the longer ones)."""
    left, parts = limit, []
    for i, t in enumerate(sorted(texts, key=len)):
        parts.append(t[:max(1, left // (len(texts) - i))].lower())
        left -= len(parts[-1])
    points = code_points(" ".join(parts))
    sym = squeezed(np.where(_letters()[points], points, 0))[:limit]
    step = suffix_automaton([0, *sym.tolist(), 0])
    size = np.array([len(m) for m in step])
    return Automaton(np.repeat(np.arange(len(step), dtype=np.int32), size),
                     np.fromiter((c for m in step for c in m), np.uint32, size.sum()),
                     np.fromiter((to for m in step for to in m.values()), np.int32, size.sum()), len(step), len(sym))


def squeezed(sym: np.ndarray) -> np.ndarray:
    """Runs of spaces become one."""
    if not len(sym):
        return sym
    return sym[np.concatenate(([True], (sym[1:] != 0) | (sym[:-1] != 0)))]


class CrossParser:
    """Automata of several languages in one table.

    ``table[row + symbol]`` holds ``2 * next row + 1`` where a phrase ends
    before the symbol, else ``2 * next row``.  For symbols from ``width`` on,
    ``values`` holds the same at the place of ``row * others + symbol - width``
    in ``keys``; where there is no such key a phrase ends, and ``root`` tells
    the next row.
    """

    def __init__(self, samples: dict[str, list[str] | Automaton], limit: int = SAMPLE_LETTERS):
        self.names = sorted(samples)
        automata = [s if isinstance(s, Automaton) else sample_automaton(s, limit)
                    for s in (samples[name] for name in self.names)]
        every = np.concatenate([a.symbol for a in automata]) if automata else np.zeros(0, np.uint32)
        seen, n = np.unique(every[every > 0], return_counts=True)
        often = np.zeros(len(seen), dtype=bool)
        often[np.argsort(-n, kind="stable")[:DENSE_SYMBOLS]] = True
        letters = np.concatenate([seen[often], seen[~often]])
        self.width = width = int(often.sum()) + 2
        others = len(letters) + 2 - width
        #: 0 space, 1 letter that no sample holds, 2.. the letters of the samples
        self.symbol = _letters().astype(np.min_scalar_type(len(letters) + 2))
        self.symbol[letters] = np.arange(2, len(letters) + 2)
        self.root = np.zeros((len(self.names), others), np.int32)
        self.known = np.zeros((len(self.names), others), dtype=bool)
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        tables, self.start, self.bits = [], [], []
        base = 0
        for nth, a in enumerate(automata):
            c = self.symbol[a.symbol].astype(np.int64)
            # the last row follows a symbol that the sample lacks, and starts a
            # text: whatever comes begins a phrase
            t = np.full((a.n_states + 1, width), -1, np.int32)
            dense = c < width
            t[a.state[dense], c[dense]] = a.to[dense]
            keys.append((base + a.state[~dense].astype(np.int64)) * width * others + c[~dense] - width)
            values.append((base + a.to[~dense].astype(np.int64)) * width * 2)
            self.root[nth] = (base + a.n_states) * width * 2 + 1
            first = ~dense & (a.state == 0)
            self.root[nth, c[first] - width] = (base + a.to[first]) * width * 2 + 1
            self.known[nth, c[first] - width] = True
            miss = t < 0
            root = np.where(t[0] < 0, a.n_states, t[0])
            t = np.where(miss, root[None, :], t)
            if (base + a.n_states + 1) * width * 2 >= 1 << 31:
                raise ValueError("the samples of all languages together are too large for one table")
            tables.append(((base + t) * width * 2 + miss).ravel().astype(np.int32))
            self.start.append((base + a.n_states) * width)
            self.bits.append(np.log2(a.n_symbols + 2))
            base += a.n_states + 1
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.int32)

    def searched(self, row: np.ndarray, other: np.ndarray) -> np.ndarray:
        """What ``table`` would hold for the symbols ``width + other``."""
        v = self.root[:, other]
        at = np.nonzero(self.known[:, other])       # elsewhere the letter is a phrase of its own
        key = row[at].astype(np.int64) * self.root.shape[1] + other[at[1]]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[place] == key
        v[at[0][hit], at[1][hit]] = self.values[place[hit]]
        return v

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrase counts (languages x texts) and whether each text has a letter."""
        low = [t.lower() for t in texts]
        size = np.array([len(t) for t in low], np.int64)
        sym = self.symbol[code_points("".join(low))]
        doc = np.repeat(np.arange(len(low), dtype=np.int32), size)
        keep = np.ones(len(sym), dtype=bool)
        keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0) | (doc[1:] != doc[:-1])
        sym, doc = sym[keep], doc[keep]
        has = np.zeros(len(low), dtype=bool)
        has[doc[sym != 0]] = True
        n = np.bincount(doc, minlength=len(low))
        at = np.cumsum(n) - n
        runs = -(-n // RUN)
        owner = np.repeat(np.arange(len(low)), runs)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        begin = at[owner] + nth * RUN
        length = np.minimum(RUN, n[owner] - nth * RUN)
        order = np.argsort(-length, kind="stable")
        begin, length, owner = begin[order], length[order], owner[order]
        live = np.searchsorted(-length, -np.arange(RUN), side="left")
        row = np.repeat(np.array(self.start, np.int32)[:, None], len(begin), 1)
        count = np.zeros(row.shape, np.int32)
        for t in range(int(length[0]) if len(length) else 0):
            k = int(live[t])
            c = sym[begin[:k] + t]
            rare = np.flatnonzero(c >= self.width)
            if len(rare):
                other = c[rare].astype(np.int64) - self.width
                c[rare] = 1
            v = self.table[row[:, :k] + c]
            if len(rare):
                v[:, rare] = self.searched(row[:, rare], other)
            count[:, :k] += v & 1
            row[:, :k] = v >> 1
        total = np.zeros((len(self.names), len(low)))
        for i in range(len(self.names)):
            total[i] = np.bincount(owner, count[i], minlength=len(low))
        return total, has

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, score) per text; the score is the runner-up's share of
        the two best figures (1 if there is one language only)."""
        if not self.names or not texts:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        total, has = self.phrases(texts)
        cost = total * np.array(self.bits)[:, None]
        best = cost.argmin(axis=0)
        if len(self.names) == 1:
            score = np.ones(len(texts))
        else:
            two = np.partition(cost, 1, axis=0)[:2]
            score = two[1] / np.maximum(two.sum(axis=0), 1e-300)
        return ([self.names[b] if h else UNDETERMINED for b, h in zip(best, has)], np.where(has, score, 0.0))


def labelled_sample(rows: DataFrame, n_rows: int = SAMPLE_ROWS, longest: int = 20_000,
                    n_labels: int = MAX_LABELS) -> DataFrame:
    """(lang, text) for the automata: ``n_rows`` rows of each of the
    ``n_labels`` most frequent languages by hash of doc_id, those of at most
    ``longest`` characters first.  Two passes: row counts per language, then
    the rows below a hash bound."""
    base = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "doc_id", "lang", "text", (F.length("text") > longest).alias("_long"),
        (F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)).alias("_u"))
    counts = {r["lang"]: (r["short"], r["long"]) for r in base.groupBy("lang").agg(
        F.sum((~F.col("_long")).cast("long")).alias("short"), F.sum(F.col("_long").cast("long")).alias("long"))
        .orderBy((-F.col("short") - F.col("long")), "lang").limit(n_labels).collect()}
    wanted = F.lit(False)
    for lang, (short, long) in counts.items():
        for n, is_long in ((short, False), (long, True)):
            if n and not (is_long and short >= n_rows):
                share = min(1.0, 4.0 * n_rows / n) if n > 4 * n_rows else 1.0
                wanted = wanted | ((F.col("lang") == lang) & (F.col("_long") == is_long) & (F.col("_u") < share))
    first = Window.partitionBy("lang").orderBy("_long", "_u", "doc_id", "text")
    return (base.where(wanted).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n_rows)
            .select("lang", "text"))


def _parser(docs: DataFrame, may_learn: Column):
    """The automata of all learned languages, each built in a task, sent to
    every worker as one table."""
    bounded_batches(docs.sparkSession)
    learn = docs.where(may_learn).select("doc_id", F.col("lang").cast("string"), F.col("text").cast("string"))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a = sample_automaton(rows["text"].tolist())
        give_back()
        return pd.DataFrame([[key[0], a.state.tobytes(), a.symbol.tobytes(), a.to.tobytes(), a.n_states, a.n_symbols]],
                            columns=["lang", "state", "symbol", "to", "states", "symbols"])

    built = (labelled_sample(learn).groupBy("lang").applyInPandas(
        build, "lang string, state binary, symbol binary, to binary, states long, symbols long"))
    automata = {r["lang"]: Automaton(
        np.frombuffer(r["state"], np.int32), np.frombuffer(r["symbol"], np.uint32), np.frombuffer(r["to"], np.int32),
        r["states"], r["symbols"]) for r in built.toLocalIterator()}
    return shared(docs.sparkSession, CrossParser(automata))


def identify(docs: DataFrame, may_learn: Column) -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are
    replaced); samples come only from rows where ``may_learn`` holds."""
    parser = _parser(docs, may_learn)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    plain = docs.select([F.col(f"`{c}`") for c in names])
    at = names.index("text")
    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, limit=CHUNK):
                lang, score = parser.value.predict([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return plain.mapInArrow(run, schema)


def reject_undetermined(docs: DataFrame, may_learn: Column) -> DataFrame:
    """Documents whose language was determined, with that language in lang."""
    parser = _parser(docs, may_learn)
    at, lang_at = docs.columns.index("text"), docs.columns.index("lang")
    schema = T.StructType([T.StructField("lang", T.StringType()) if f.name == "lang" else f for f in docs.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, limit=CHUNK):
                lang, _ = parser.value.predict([t or "" for t in part.column(at).to_pylist()])
                cols = list(part.columns)
                cols[lang_at] = pa.array(lang, pa.string())
                found = pa.array([x != UNDETERMINED for x in lang], pa.bool_())
                yield pa.RecordBatch.from_arrays(cols, names=schema.names).filter(found)

    return docs.mapInArrow(run, schema)

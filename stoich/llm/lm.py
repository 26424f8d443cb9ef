"""Log-bilinear language model trained by noise-contrastive estimation.

Tokens are the words of a text (A-Z lowered) and one end mark.  The model
predicts a token in two log-bilinear steps from the two tokens before it: its
class, then the word within the class.  The context vector of a step is
``C1 r(w1) + C2 r(w2)``, the score of a class or word is its inner product with
``q(w)`` plus a bias.

* **Classes.** The end mark and the most frequent words are classes of their
  own; the next words, the vocabulary, are dealt in equal parts to VOCAB_CLASSES
  classes; all other words share ENDINGS classes by their last byte.  Classes are
  predicted from classes.
* **Words.** Every word of the vocabulary has vectors.  Their number grows with
  the training words (:func:`vocabulary_size`).  They are predicted from words.
* **Other words.** Within one of the last classes a word has its smoothed share of
  the class's training tokens, with half a token set aside for words never seen;
  so the log-probabilities of all words, seen and unseen together, sum to one.

What the class step learns from is counted over every training text: tokens per
word (one row per word and task, summed by word) and class triples (one row per
triple and task, summed by triple).  Each task takes its contexts as rows of one
matrix and follows the NCE gradient (data against ``NOISE`` noise classes per
token, the noise expectation taken over the whole class distribution by a matrix
product); the driver averages the parameters, whose size is fixed.  Afterwards
every context's scores are normalised by a batched matrix product, once, for all
(c1, c2).

The word step reads every training text: a task walks through its texts in
batches of BATCH targets, grouped by class; each group meets noise words drawn
from the class in one matrix product.  The parameters of all tasks are averaged
by weight, in two steps, after every pass.  Scores are normalised by a matrix
product of the contexts and all words of the class.

Scoring needs each word's count.  The ``HOT_WORDS`` most frequent words travel
as a table of that size; all other words of a text go, once per text, into a
join with the counts, so nothing unbounded is broadcast and no key is hot.

Defined cases: a null or blank text is just the end mark; without training rows
all counts are 0 and N is 0; repeated rows count and are scored each; other
columns are ignored.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoich.llm.common import bounded_batches, materialise, shared
from stoich.llm.words import Words, text_chunks

CLASSES = 160
ENDINGS = 32             # classes shared by the words that have no vector
VOCAB_CLASSES = 32       # classes of the words that have one
HOT_WORDS = 1 << 19
DIM = 24
NOISE = 10.0
ROUNDS = 6
STEPS = 30
RATE = 0.5
SEED = 20240229
END_CLASS = 0
WORD_DIM = 16
WORD_NOISE, NOISE_WORDS = 16.0, 32
WORD_ROUNDS = 1
WORD_RATE = 0.1
BATCH = 4_096
MIN_VOCABULARY, MAX_VOCABULARY = 1 << 10, 1 << 16
TREE_WIDTH = 64


# -- tokens -------------------------------------------------------------------------

def _with_ends(cls: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class sequence with an end mark after every text, and the text of each
    token.  The two tokens before a text's first count as end marks."""
    n = np.diff(first) + 1
    doc = np.repeat(np.arange(len(n)), n)
    seq = np.full(len(doc), END_CLASS, np.int64)
    ends = np.cumsum(n) - 1
    inside = np.ones(len(doc), dtype=bool)
    inside[ends] = False
    seq[inside] = cls
    return seq, doc


def _contexts(seq: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two tokens back, end marks before the text starts."""
    one = np.full(len(seq), END_CLASS, np.int64)
    two = one.copy()
    if len(seq) > 1:
        one[1:] = np.where(doc[1:] == doc[:-1], seq[:-1], END_CLASS)
    if len(seq) > 2:
        two[2:] = np.where(doc[2:] == doc[:-2], seq[:-2], END_CLASS)
    return one, two


# -- counts -------------------------------------------------------------------------

def word_counts(texts: DataFrame) -> DataFrame:
    """(h, ending, c): tokens per word, and the class that its last byte gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def total() -> pa.RecordBatch:
            h = np.concatenate([x[0] for x in held])
            u, first, inv = np.unique(h, return_index=True, return_inverse=True)
            c = np.bincount(inv, np.concatenate([x[2] for x in held]), minlength=len(u)).astype(np.int64)
            e = np.concatenate([x[1] for x in held])[first]
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(e), pa.array(c)],
                                              names=["h", "ending", "c"])

        size = 0
        for batch in batches:
            for part in text_chunks(batch):
                w = Words(part.column(0))
                u, first, c = np.unique(w.hashes(), return_index=True, return_counts=True)
                ending = (CLASSES - ENDINGS + (w.data[w.end - 1] % ENDINGS).astype(np.int64))[first]
                held.append((u, ending, c))
                size += len(u)
                if size > 1 << 20:
                    yield total()
                    held, size = [], 0
        if held:
            yield total()

    return (texts.select("text").mapInArrow(run, "h long, ending long, c long")
            .groupBy("h").agg(F.first("ending").alias("ending"), F.sum("c").alias("c")))


def _triples(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(ctx, w, c): how often class w follows the context c2 * CLASSES + c1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CLASSES ** 3, np.int64)
        for batch in batches:
            for part in text_chunks(batch):
                words = Words(part.column(0))
                seq, doc = _with_ends(lexicon.find(words, words.hashes())[0], words.first)
                one, two = _contexts(seq, doc)
                keys, n = np.unique((two * CLASSES + one) * CLASSES + seq, return_counts=True)
                table[keys] += n
        some = np.flatnonzero(table)
        for a in range(0, len(some), 1 << 18):
            k = some[a:a + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(table[k])], names=["k", "c"])

    return (texts.select("text").mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))
            .select(F.floor(F.col("k") / CLASSES).cast("long").alias("ctx"),
                    F.pmod("k", F.lit(CLASSES)).alias("w"), "c"))


# -- training -----------------------------------------------------------------------

class LogBilinear:
    """Parameters, NCE steps, and the normalised table of log-probabilities."""

    def __init__(self, noise: np.ndarray, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.noise = noise
        self.r = rng.normal(0, 0.1, (CLASSES, DIM))
        self.q = rng.normal(0, 0.1, (CLASSES, DIM))
        self.c1 = np.eye(DIM)
        self.c2 = 0.5 * np.eye(DIM)
        self.b = np.log(noise)

    def parameters(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.c1, self.c2, self.b)])

    def set(self, flat: np.ndarray) -> None:
        at = 0
        for name in ("r", "q", "c1", "c2", "b"):
            shape = getattr(self, name).shape
            size = int(np.prod(shape))
            setattr(self, name, flat[at:at + size].reshape(shape).copy())
            at += size

    def train(self, ctx: np.ndarray, counts: np.ndarray, steps: int = STEPS, rate: float = RATE) -> float:
        """AdaGrad on the NCE objective of ``counts`` (contexts x classes);
        returns the last objective per token."""
        two, one = ctx // CLASSES, ctx % CLASSES
        n = counts.sum(axis=1, keepdims=True)
        total = n.sum()
        shift = np.log(NOISE * self.noise)
        seen = [np.full_like(x, 1e-8) for x in (self.r, self.q, self.c1, self.c2, self.b)]
        value = 0.0
        for _ in range(steps):
            r1, r2 = self.r[one], self.r[two]
            hidden = r1 @ self.c1 + r2 @ self.c2
            z = hidden @ self.q.T + self.b - shift
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            expect = n * (NOISE * self.noise)
            g = (counts * (1 - p) - expect * p) / total
            value = float((counts * np.log(p + 1e-30)).sum() + (expect * np.log(1 - p + 1e-30)).sum()) / total
            gh = g @ self.q
            gr = np.zeros_like(self.r)
            np.add.at(gr, one, gh @ self.c1.T)
            np.add.at(gr, two, gh @ self.c2.T)
            grads = (gr, g.T @ hidden, r1.T @ gh, r2.T @ gh, g.sum(axis=0))
            for x, d, s in zip((self.r, self.q, self.c1, self.c2, self.b), grads, seen):
                s += d * d
                x += rate * 0.1 * d / np.sqrt(s)
        return value

    def log10_table(self) -> np.ndarray:
        """log10 p(w | ctx) for every context c2 * CLASSES + c1."""
        first, second = self.r @ self.c1 @ self.q.T, self.r @ self.c2 @ self.q.T
        z = (second[:, None, :] + first[None, :, :] + self.b).reshape(-1, CLASSES)
        top = z.max(axis=1, keepdims=True)
        z -= top + np.log(np.exp(z - top).sum(axis=1, keepdims=True))
        return z / np.log(10)


def _fit(triples: DataFrame, noise: np.ndarray, rounds: int) -> LogBilinear:
    model = LogBilinear(noise)

    for _ in range(rounds):
        start = model.parameters()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cols = [[], [], []]
            for batch in batches:
                for i in range(3):
                    cols[i].append(batch.column(i).to_numpy(zero_copy_only=False))
            if not cols[0]:
                return
            ctx, w, c = (np.concatenate(x) for x in cols)
            own, row = np.unique(ctx, return_inverse=True)
            counts = np.zeros((len(own), CLASSES))
            np.add.at(counts, (row, w), c)
            part = LogBilinear(noise)
            part.set(start)
            part.train(own, counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([float(counts.sum())]), pa.array([part.parameters().tolist()], pa.list_(pa.float64()))],
                names=["n", "p"])

        found = triples.mapInArrow(run, "n double, p array<double>").collect()
        weight = sum(r["n"] for r in found)
        if not weight:
            break
        model.set(sum(np.array(r["p"]) * (r["n"] / weight) for r in sorted(found, key=lambda r: (r["n"], r["p"][:1]))))
    return model


# -- words within a class ---------------------------------------------------------------

def vocabulary_size(n_train: int) -> int:
    """Words with vectors: the power of two below twice the root of the training
    tokens, within bounds that keep the vectors' table small."""
    return int(np.clip(2 << int(np.log2(max(n_train, 1)) / 2), MIN_VOCABULARY, MAX_VOCABULARY))


class Lexicon:
    """The words known by name: sorted hashes with their class and symbol.
    Symbols number the end mark, the own words, the vocabulary (class by class),
    and the endings."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, endings: np.ndarray, n_vocabulary: int):
        n_own = self.n_own = min(len(hashes), CLASSES - ENDINGS - VOCAB_CLASSES - 1)
        v = self.size = min(n_vocabulary, len(hashes) - n_own)
        rest = slice(n_own, n_own + v)
        order = np.lexsort((hashes[rest], endings[rest]))      # words of one ending stay together
        self.counts = counts[rest][order].astype(np.float64)
        self.word_class = np.arange(v) * VOCAB_CLASSES // max(v, 1)
        #: words of class k are first[k]:first[k + 1]
        self.first = np.searchsorted(self.word_class, np.arange(VOCAB_CLASSES + 1))
        h = np.concatenate([hashes[:n_own], hashes[rest][order]])
        cls = np.concatenate([1 + np.arange(n_own), CLASSES - ENDINGS - VOCAB_CLASSES + self.word_class])
        by_hash = np.argsort(h, kind="stable")
        self.hashes, self.classes, self.symbols = h[by_hash], cls[by_hash], 1 + by_hash
        self.n_symbols = 1 + n_own + v + ENDINGS
        share = np.bincount(self.word_class, self.counts, VOCAB_CLASSES)
        self.unigram = self.counts / np.maximum(share[self.word_class], 1)

    def find(self, words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, symbol) of every word."""
        ending = (words.data[words.end - 1] % ENDINGS).astype(np.int64) if len(h) else np.zeros(0, np.int64)
        cls, symbol = CLASSES - ENDINGS + ending, self.n_symbols - ENDINGS + ending
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            cls, symbol = np.where(known, self.classes[at], cls), np.where(known, self.symbols[at], symbol)
        return cls, symbol

    def word(self, symbol: np.ndarray) -> np.ndarray:
        """Place in the vocabulary, -1 for other symbols."""
        at = symbol - 1 - self.n_own
        return np.where((at >= 0) & (at < self.size), at, -1)


def _row_sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by their place ``at``, below ``n``."""
    out = np.empty((n, rows.shape[1]), np.float32)
    for j in range(rows.shape[1]):
        out[:, j] = np.bincount(at, rows[:, j], n)
    return out


class WordModel:
    """Log-bilinear prediction of a word of the vocabulary within its class."""

    NAMES = ("r", "q", "c1", "c2", "b")

    def __init__(self, lexicon: Lexicon, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64([seed, 2]))
        self.lex = lexicon
        f = np.float32
        self.r = rng.normal(0, 0.1, (lexicon.n_symbols, WORD_DIM)).astype(f)
        self.q = np.zeros((lexicon.size, WORD_DIM), f)
        self.c1, self.c2 = np.eye(WORD_DIM, dtype=f), 0.5 * np.eye(WORD_DIM, dtype=f)
        self.b = np.log(np.maximum(lexicon.unigram, 1e-12)).astype(f)
        self.log_noise = np.log(WORD_NOISE * np.maximum(lexicon.unigram, 1e-12)).astype(f)
        # unigram shares up to each word of its class
        whole = np.cumsum(lexicon.unigram)
        begin = lexicon.first[lexicon.word_class]
        self.upto = whole - (whole - lexicon.unigram)[begin] if lexicon.size else whole
        self.seen = None

    def parameters(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def set(self, flat: np.ndarray) -> None:
        at = 0
        for name in self.NAMES:
            old = getattr(self, name)
            setattr(self, name, flat[at:at + old.size].reshape(old.shape).astype(np.float32).copy())
            at += old.size

    def _groups(self, word: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, last word of a class, rows of that class)."""
        order = np.argsort(word, kind="stable")
        cut = np.searchsorted(word[order], self.lex.first)
        for k in range(VOCAB_CLASSES):
            if cut[k + 1] > cut[k]:
                yield int(self.lex.first[k]), int(self.lex.first[k + 1]), order[cut[k]:cut[k + 1]]

    def hidden(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.r[one] @ self.c1 + self.r[two] @ self.c2

    def step(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, rng: np.random.Generator) -> None:
        """One AdaGrad step on the NCE objective of a batch of targets; only
        the vectors that the batch touches move."""
        n = len(word)
        r1, r2 = self.r[one], self.r[two]
        h = r1 @ self.c1 + r2 @ self.c2
        z = (h * self.q[word]).sum(axis=1) + self.b[word] - self.log_noise[word]
        g = (1 / (1 + np.exp(np.clip(z, -30, 30)))).astype(np.float32)
        gh = g[:, None] * self.q[word]
        places, grads, biases = [word], [g[:, None] * h], [g]
        for a, z_, rows in self._groups(word):
            noise = a + np.searchsorted(self.upto[a:z_], rng.random(NOISE_WORDS) * self.upto[z_ - 1])
            noise = np.minimum(noise, z_ - 1)
            hk, qn = h[rows], self.q[noise]
            s = hk @ qn.T + (self.b[noise] - self.log_noise[noise])
            p = np.float32(-WORD_NOISE / NOISE_WORDS) / (1 + np.exp(-np.clip(s, -30, 30)))
            gh[rows] += p @ qn
            places.append(noise)
            grads.append(p.T @ hk)
            biases.append(p.sum(axis=0))
        moved, at = np.unique(np.concatenate(places), return_inverse=True)
        self._move("q", _row_sums(at, np.concatenate(grads), len(moved)), moved)
        self._move("b", np.bincount(at, np.concatenate(biases), len(moved)).astype(np.float32), moved)
        moved, at = np.unique(np.concatenate([one, two]), return_inverse=True)
        self._move("r", _row_sums(at, np.concatenate([gh @ self.c1.T, gh @ self.c2.T]), len(moved)), moved)
        self._move("c1", r1.T @ gh, slice(None))
        self._move("c2", r2.T @ gh, slice(None))

    def _move(self, name: str, grad: np.ndarray, rows) -> None:
        if self.seen is None:
            self.seen = {n: np.full_like(getattr(self, n), 1e-6) for n in self.NAMES}
        self.seen[name][rows] += grad * grad
        getattr(self, name)[rows] += WORD_RATE * grad / np.sqrt(self.seen[name][rows])

    def log10(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 p(word | class of the word, context) per row."""
        h, out = self.hidden(one, two), np.zeros(len(word))
        for a, z, rows in self._groups(word):
            s = h[rows] @ self.q[a:z].T
            s += self.b[a:z]
            s -= s.max(axis=1, keepdims=True)
            own = s[np.arange(len(rows)), word[rows] - a]
            out[rows] = own - np.log(np.exp(s, out=s).sum(axis=1))
        return out / np.log(10)


def _targets(words: Words, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one, two, word): the symbols before every token of the vocabulary."""
    _, symbol = lexicon.find(words, words.hashes())
    seq, doc = _with_ends(symbol, words.first)
    one, two = _contexts(seq, doc)
    word = lexicon.word(seq)
    mine = word >= 0
    return one[mine], two[mine], word[mine]


def _fit_words(training: DataFrame, lexicon: Lexicon, rounds: int) -> WordModel:
    """Parameters after ``rounds`` passes over all training texts."""
    model = WordModel(lexicon)
    if not lexicon.size:
        return model
    spark = training.sparkSession
    schema = "part long, n double, p binary"

    def add(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        order = np.lexsort((n,))
        total = sum(n[i] * np.frombuffer(table.column("p")[int(i)].as_py(), np.float64) for i in order) / n.sum()
        return pa.table({"part": [0], "n": [float(n.sum())], "p": pa.array([total.tobytes()], pa.binary())})

    for turn in range(rounds):
        start = shared(spark, model.parameters())

        def run(batches: Iterator[pa.RecordBatch], turn=turn, start=start) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext
            own, n, k = WordModel(lexicon), 0, 0
            own.set(start.value)
            for batch in batches:
                for part in text_chunks(batch):
                    one, two, word = _targets(Words(part.column(0)), lexicon)
                    for a in range(0, len(word), BATCH):
                        rng = np.random.Generator(np.random.PCG64([SEED, turn, k]))
                        own.step(one[a:a + BATCH], two[a:a + BATCH], word[a:a + BATCH], rng)
                        k += 1
                    n += len(word)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId() % TREE_WIDTH]), pa.array([float(n)]),
                     pa.array([own.parameters().astype(np.float64).tobytes()], pa.binary())], names=["part", "n", "p"])

        found = (training.select("text").mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema)
                 .groupBy("part").applyInArrow(add, schema).collect())
        if not found:
            break
        model.set(np.frombuffer(found[0]["p"], np.float64))
    return model


# -- scoring --------------------------------------------------------------------------

def _hot_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, count and ending of frequent words, most frequent first: all
    words above the lowest step of a logarithmic scale that at most ``most``
    words exceed."""
    step = F.floor(4 * F.log2("c")).cast("int")
    below, total = 1 << 30, 0
    for s, n in sorted((tuple(r) for r in counts.groupBy(step).count().collect()), reverse=True):
        total += n
        if total > most:
            break
        below = s
    hot = counts.where(step >= below).select("h", "c", "ending").toArrow()
    h, c, e = (hot.column(x).to_numpy() for x in ("h", "c", "ending"))
    order = np.lexsort((h, -c))
    return h[order].view(np.uint64), c[order], e[order]


def score(docs: DataFrame, may_learn: Column, hot_words: int = HOT_WORDS, rounds: int = ROUNDS,
          word_rounds: int = WORD_ROUNDS) -> DataFrame:
    """Per row doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    training = docs.where(may_learn).select(F.col("text").cast("string"))
    ends = docs.where(may_learn).count()
    counts = materialise(word_counts(training))
    per_class = counts.groupBy("ending").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("c")).collect()
    vocabulary = sum(r["v"] for r in per_class) + (ends > 0)
    n_train = sum(r["c"] for r in per_class) + ends

    hot_h, hot_c, hot_e = _hot_words(counts, hot_words)
    lexicon = Lexicon(hot_h, hot_c, hot_e, vocabulary_size(n_train))
    n_own, n_known = lexicon.n_own, lexicon.n_own + lexicon.size

    # tokens and words per shared class, without the words that left it
    class_c = np.zeros(CLASSES, np.int64)
    class_v = np.zeros(CLASSES, np.int64)
    for r in per_class:
        class_c[r["ending"]], class_v[r["ending"]] = r["c"], r["v"]
    np.subtract.at(class_c, hot_e[:n_known], hot_c[:n_known])
    np.subtract.at(class_v, hot_e[:n_known], 1)
    noise = class_c.astype(float)
    noise[END_CLASS] = ends
    noise[1:n_own + 1] = hot_c[:n_own]
    low = CLASSES - ENDINGS - VOCAB_CLASSES
    noise[low:low + VOCAB_CLASSES] = np.bincount(lexicon.word_class, lexicon.counts, VOCAB_CLASSES)
    noise = (noise + 0.5) / (noise + 0.5).sum()

    model = _fit(materialise(_triples(training, lexicon).repartition(8, "ctx").sortWithinPartitions("ctx", "w")),
                 noise, rounds if n_train else 0)
    words = _fit_words(training, lexicon, word_rounds if n_train else 0)
    words.seen = None
    order = np.argsort(hot_h, kind="stable")
    table = shared(spark, {
        "h": hot_h[order], "log": np.log10(hot_c[order] + 0.5), "lexicon": lexicon, "words": words,
        "log_p": model.log10_table().astype(np.float32),
        "class_log": np.log10(class_c + 0.5 * (class_v + 1))})
    base_log = float(np.log10(n_train + 0.5 * (vocabulary + 1)))
    end_log = float(np.log10(ends + 0.5))

    rows = materialise(texts.withColumn("row", F.monotonically_increasing_id())
                       .mapInArrow(_scorer(table, base_log, end_log, int(ends > 0)), _SCORED))
    rare = (rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
            .select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("m"))
            .join(counts.select("h", "c"), "h", "left")
            .groupBy("row").agg(
                F.sum(F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("_log"),
                F.sum(F.when(F.col("c").isNotNull(), F.col("m")).otherwise(0)).alias("_known")))
    extra = F.coalesce("_log", F.lit(0.0))
    return rows.drop("rare", "times").join(rare, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(int(n_train)).cast("bigint").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"), (F.col("model") + extra).alias("score"))


_SCORED = ("row long, doc_id long, n_tokens long, known long, base double, model double, "
           "rare array<long>, times array<long>")


def _scorer(table, base_log: float, end_log: float, end_known: int):
    """Per text all that needs no rare word's count; rare words as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for batch in batches:
            for part in text_chunks(batch):
                words = Words(part.column(1))
                h = words.hashes()
                n_docs = part.num_rows
                doc = np.repeat(np.arange(n_docs), words.counts())
                cls, symbol = t["lexicon"].find(words, h)
                seq, owner = _with_ends(cls, words.first)
                one, two = _contexts(seq, owner)
                model = np.bincount(owner, t["log_p"][two * CLASSES + one, seq], minlength=n_docs)
                seq, _ = _with_ends(symbol, words.first)
                one, two = _contexts(seq, owner)
                word = t["lexicon"].word(seq)
                mine = word >= 0
                model += np.bincount(owner[mine], t["words"].log10(one[mine], two[mine], word[mine]), minlength=n_docs)
                if len(t["h"]):
                    at = np.minimum(np.searchsorted(t["h"], h), len(t["h"]) - 1)
                    is_hot = t["h"][at] == h
                    log = np.where(is_hot, t["log"][at], 0.0)
                else:
                    is_hot, log = np.zeros(len(h), dtype=bool), np.zeros(len(h))
                n = words.counts() + 1
                base = np.bincount(doc, log, minlength=n_docs) + end_log - n * base_log
                known = np.bincount(doc, is_hot, minlength=n_docs).astype(np.int64) + end_known
                in_class = cls >= CLASSES - ENDINGS
                # words that are a class of their own have probability 1 in it;
                # the base score's share of them is taken back at the end
                model += np.bincount(doc[in_class], (log - t["class_log"][cls])[in_class], minlength=n_docs)
                order = np.lexsort((h[~is_hot], doc[~is_hot]))
                rh, rd = h[~is_hot][order], doc[~is_hot][order]
                first = np.flatnonzero(np.concatenate(([True], (rh[1:] != rh[:-1]) | (rd[1:] != rd[:-1])))) \
                    if len(rh) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(rh)))
                cut = np.searchsorted(rd[first], np.arange(n_docs + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(2), part.column(0), pa.array(n.astype(np.int64)), pa.array(known), pa.array(base),
                     pa.array(model), pa.ListArray.from_arrays(cut, pa.array(rh[first].view(np.int64))),
                     pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int64)))],
                    names=["row", "doc_id", "n_tokens", "known", "base", "model", "rare", "times"])

    return run

"""Byte-pair encoding and decoding with a given vocabulary file.

A text is cut at the vocabulary's added tokens, each piece into words by the
byte-level pattern, and every distinct word of a batch is encoded once:
the symbols of all new words lie in one flat array, and each round looks up all
neighbouring pairs by binary search in the sorted pair keys, finds every
word's lowest rank, and merges that pair wherever it stands in the word, left
to right.  Rounds end when no word holds a known pair.  Words seen before come
from a cache per task (bounded; emptying it changes no result).

Defined cases: a null text encodes as the empty text (no ids); long words take
more rounds, not more memory than a few numbers per byte; rows are independent,
so repeated rows, ties and other columns have no effect.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoich.llm.common import bounded_batches
from stoich.llm.words import text_chunks

# The byte-level word pattern of the vocabulary, with white
# space spelled as the Unicode property White_Space.
_S = r"\t-\r \x85\xa0  -     　"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _S + r"\p{L}\p{N}]+|[" + _S + r"]+(?![^" + _S
           + r"])|[" + _S + r"]+")
CACHE_WORDS = 250_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level
    vocabularies: printable bytes stand for themselves, the others for the
    code points from 256 on, in byte order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class ByteBPE:
    """Vocabulary, merges and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.size = size
        letters = byte_letters()
        self.of_byte = np.array([vocab[c] for c in letters], np.int64)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.merged = keys[order], np.arange(len(keys))[order], merged[order]
        self.by_rank = np.empty(len(keys), np.int64)
        self.by_rank[self.rank] = np.arange(len(keys))
        byte_of = {c: b for b, c in enumerate(letters)}
        pieces: list[bytes] = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(byte_of[c] for c in token)
        for token, i in self.added.items():
            pieces[i] = token.encode()
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.byte_len = np.array([len(p) for p in pieces], np.int64)
        self.byte_at = np.cumsum(self.byte_len) - self.byte_len
        self.word = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.at = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def _store(self, words: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        """Append encoded words to the cache."""
        base = len(self.known)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while base + len(words) > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.at[base:base + len(words)] = self.used + np.cumsum(n) - n
        self.length[base:base + len(words)] = n
        self.known.update(zip(words, range(base, base + len(words))))
        self.used += len(ids)

    def merge_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and each word's id count."""
        raw = [w.encode("utf-8") for w in words]
        n = np.array([len(r) for r in raw], np.int64)
        sym = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), n)
        done_sym: list[np.ndarray] = []
        done_word: list[np.ndarray] = []
        none = len(self.keys)
        while len(sym):
            rank = np.full(len(sym), none)
            same = word[1:] == word[:-1]
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            hit = same & (self.keys[at] == key)
            rank[:-1][hit] = self.rank[at[hit]]
            first = np.flatnonzero(np.concatenate(([True], ~same)))
            lowest = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(sym)))
            low = np.repeat(lowest, count)
            over = low == none
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                keep = ~over
                sym, word, rank, low = sym[keep], word[keep], rank[keep], low[keep]
                if not len(sym):
                    break
            take = rank == low
            # of a run of overlapping places only the 1st, 3rd, ... merge
            pos = np.flatnonzero(take)
            fresh = np.concatenate(([True], pos[1:] != pos[:-1] + 1))
            group = np.cumsum(fresh) - 1
            pos = pos[(pos - pos[np.flatnonzero(fresh)][group]) % 2 == 0]
            sym[pos] = self.merged[self.by_rank[rank[pos]]]
            stay = np.ones(len(sym), dtype=bool)
            stay[pos + 1] = False
            sym, word = sym[stay], word[stay]
        if not done_sym:
            return np.zeros(0, np.uint32), np.zeros(len(raw), np.int64)
        word = np.concatenate(done_word)
        sym = np.concatenate(done_sym)[np.argsort(word, kind="stable")]
        return sym.astype(np.uint32), np.bincount(word, minlength=len(raw))

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > CACHE_WORDS:
            self._forget()
        self._store(words, *self.merge_rounds(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and each text's id count."""
        found: list[str] = []
        ends = []
        for text in texts:
            if self.cut is None or not any(t in text for t in self.added):
                found += self.word.findall(text)
            else:
                for i, piece in enumerate(self.cut.split(text)):
                    if i % 2:
                        found.append("\x00" + piece)
                    else:
                        found += self.word.findall(piece)
            ends.append(len(found))
        index = [self.known.get(w, -1) for w in found]
        special = {"\x00" + t: i for t, i in self.added.items()}
        if -1 in index:
            new = [w for w in dict.fromkeys(found) if w not in special]
            if len(self.known) + len(new) <= CACHE_WORDS:
                new = [w for w in new if w not in self.known]
            self._learn(new)
            marks = [w for w in special if w not in self.known]
            self._store(marks, np.array([special[w] for w in marks], np.uint32), np.ones(len(marks), np.int64))
            index = [self.known[w] for w in found]
        index = np.array(index, np.int64)
        n = self.length[index]
        ids = self.ids[_ranges(self.at[index], n)]
        total = np.concatenate(([0], np.cumsum(n)))
        return ids, np.diff(total[np.array([0, *ends])])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, added tokens as their own text."""
        return self.bytes[_ranges(self.byte_at[ids], self.byte_len[ids])].tobytes()


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions start, start+1, ... of every range, one after another."""
    total = int(length.sum())
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(total)


_LOADED: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    """The tokenizer of a file, loaded once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Per row doc_id, n_tokens, the ids (array<int>, if ``with_ids``), the
    SHA-256 of the ids as little-endian 32-bit numbers, and the decoded text's
    SHA-256.  The file at ``path`` must exist on every executor."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for part in text_chunks(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, n = bpe.encode(texts)
                to = np.cumsum(n)
                own = [ids[b - k:b] for b, k in zip(to, n)]
                out = [part.column(0), pa.array(n, pa.int64()),
                       pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own]),
                       pa.array([hashlib.sha256(bpe.decode(x).decode("utf-8", "replace").encode()).hexdigest()
                                 for x in own])]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], to)), pa.int32()),
                                                        pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                                                 + ["ids"] * with_ids)
        bpe._forget()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode_ids(ids: list[int], path: str) -> str:
    """Text of a list of ids; bytes that form no character become U+FFFD."""
    return tokenizer(path).decode(np.array(ids, np.int64)).decode("utf-8", "replace")

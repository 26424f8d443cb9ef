"""Vectorised words and word hashes of whole Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Those six
bytes never occur inside a multi-byte UTF-8 character, so segmentation works
on the raw buffer of an Arrow string array: one lookup per byte for the whole
batch, no Python object per word.

Word hashes are 64-bit polynomial hashes over random per-byte values (prefix
sums modulo 2^64), finished with a bit mixer that also takes the length.  Two
different words or shingles share a hash with probability about 2^-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WS = np.zeros(256, dtype=bool)
WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_COEF = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit affects every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of the hash base and of its inverse, grown when a longer buffer arrives."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = n + n // 4
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                p = np.full(size, np.uint64(base))
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up[:n], cls.down[:n]


class Words:
    """Words of one batch of texts.

    ``start``/``end`` are byte positions in ``data``; the words of text ``i``
    are ``first[i]:first[i + 1]``.  Null texts hold no word.
    """

    def __init__(self, texts: pa.Array):
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        texts = texts.fill_null("")
        _, off, buf = texts.buffers()
        off = np.frombuffer(off, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] \
            if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
        self.data = raw[off[0]:off[-1]]
        self.off = off - off[0]
        n = len(self.data)
        ws = WS[self.data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.off] = True
        begin = ~ws
        begin[1:] &= ws[:-1] | cut[1:n]
        stop = ~ws
        stop[:-1] &= ws[1:] | cut[1:n]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, self.off)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """64-bit hash of every word (A-Z folded to a-z when ``lower``)."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = _Powers.get(len(self.data) + 1)
        sums = np.empty(len(self.data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.data] * up[:-1], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * down[self.start]
        return mix64(h + (self.end - self.start).astype(np.uint64) * _COEF[7])


def shingle_sets(words: Words, n: int = 5) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its ``n``-word shingles; a text
    with 1 to n-1 words has its whole sequence as the only shingle."""
    if not 1 <= n <= 6:
        raise ValueError("shingle length must be 1 to 6")
    h = words.hashes()
    total = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        total += h[k:k + len(total)] * _COEF[k]
    total = mix64(total)
    first = words.first
    for i in range(len(first) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= n:
            yield np.unique(total[a:b - n + 1])
        elif b > a:
            part = (h[a:b] * _COEF[:b - a]).sum(dtype=np.uint64, keepdims=True)
            yield mix64(part + _COEF[6:7] * np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and an
    executor's limit counts what they hold back."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` text bytes each (a longer
    single text makes a slice of its own), so working memory is bounded by
    the larger of ``limit`` and the longest text."""
    col = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + n + 1]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    give_back()


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of every text, joined by one space."""
    size = np.where(keep, words.end - words.start, 0)
    owner = np.repeat(np.arange(len(words.first) - 1), words.counts())
    last = np.full(len(words.first) - 1, -1)
    kept = np.flatnonzero(keep)
    last[owner[kept]] = kept
    gap = keep.copy()                   # a kept word is followed by its separator
    gap[last[last >= 0]] = False        # unless it is the last one
    step = np.zeros(len(words.data) + 1, np.int8)
    step[words.start[kept]] += 1
    step[(words.end + gap)[kept]] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    data = np.where(WS[words.data], np.uint8(32), words.data)[inside]
    upto = np.concatenate(([0], np.cumsum(size + gap)))[words.first]
    return pa.LargeStringArray.from_buffers(len(upto) - 1, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(data))

"""Periodic runs, repeated windows and whitening against brute force, and on
awkward rows."""
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stoich.llm import runs, substrings, whitening
from stoich.llm.queries import op11_word_runs, op12_repeated_windows, op13_whitened_embeddings
from stoich.llm.words import Words, joined

WORD = re.compile("[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- runs --------------------------------------------------------------------------

def brute_runs(w):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(12, 2 * q):
                s = w[i:j + q]
                if not any(s[d:] == s[:-d] for d in range(1, q)):
                    out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(w, found):
    gone = {k for start, length, q in found for k in range(start + q, start + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def planted(doc_id, w):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_runs_brute_force():
    rng = np.random.default_rng(11)
    for _ in range(200):
        texts = []
        for _ in range(int(rng.integers(1, 5))):
            n = int(rng.integers(0, 80))
            w = [f"w{x}" for x in rng.integers(0, rng.integers(1, 4), n)]
            if n > 5 and rng.random() < 0.5:
                a = int(rng.integers(0, n))
                p = 1 + int(rng.integers(0, max(1, (n - a) // 3)))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append("  ".join(w))
        words = Words(pa.array(texts))
        found, keep = runs.runs_of(words)
        kept = joined(words, keep).to_pylist()
        for i, t in enumerate(texts):
            want = brute_runs(t.split())
            assert [tuple(r[1:]) for r in found.tolist() if r[0] == i] == want
            assert kept[i] == collapse(t.split(), want)


def test_long_runs():
    fib = ["a", "b"]
    while len(fib[-1]) < 30_000:
        fib.append(fib[-1] + fib[-2])
    for w, least in ((["x"] * 50_000, 1), (list("abcdefg") * 9_000, 1), (list(fib[-1]), 1_000)):
        found, _ = runs.runs_of(Words(pa.array([" ".join(w)])))
        assert len(found) >= least
        for _, start, length, q in found[:200].tolist():
            assert w[start:start + length - q] == w[start + q:start + length]
            assert start == 0 or w[start - 1] != w[start + q - 1]
            assert start + length == len(w) or w[start + length] != w[start + length - q]
    words = Words(pa.array([" ".join(["x"] * 50_000), "", None, "x y"]))
    assert joined(words, runs.runs_of(words)[1]).to_pylist() == ["x", "", "", "x y"]


def run_rows(rows):
    for doc_id, text in rows:
        w = planted(doc_id, WORD.findall(text or ""))
        found = brute_runs(w) if len(w) < 3_000 else None
        if found is not None:
            best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
            yield (doc_id, len(found), *best, best[0] is not None and best[1] * 1000 // best[2] or None,
                   sha("".join("%d,%d,%d\n" % r for r in found)), sha(collapse(w, found)))


def test_run_query(spark, awkward, corpus):
    for docs in (awkward, corpus):
        got = Counter(tuple(r) for r in runs.digests(docs).collect())
        want = Counter(run_rows([(r.doc_id, r.text) for r in docs.collect()]))
        assert not want - got and sum(got.values()) == docs.count()
    assert op11_word_runs(spark, "/root/testdata/sf0.001").columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_run_edges(spark, no_docs):
    assert runs.digests(no_docs).count() == 0
    odd = spark.createDataFrame([(None, None), (None, "a b"), (9, "")], "doc_id long, text string")
    assert {(r.doc_id, r.n_runs, r.length) for r in runs.digests(odd).collect()} == {(None, 0, None), (9, 0, None)}


# -- windows -----------------------------------------------------------------------

def brute_removal(rows, span):
    docs = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + span]) for w in docs for i in range(len(w) - span + 1))
    for (doc_id, _), w in zip(rows, docs):
        gone = {k for i in range(len(w) - span + 1) if seen[tuple(w[i:i + span])] > 1 for k in range(i, i + span)}
        yield doc_id, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("span,gram,frequent,bucket", [(35, 8, 20_000, 16 << 20), (35, 8, 2, 4_000), (6, 2, 5, 900),
                                                       (6, 2, 0, 900), (1, 1, 3, 500), (9, 9, 100, 2_000)])
def test_windows_brute_force(spark, span, gram, frequent, bucket):
    rng = np.random.default_rng(span + frequent)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = [f"w{x}" for x in rng.integers(0, 3 if i % 3 else 500, int(rng.integers(0, 90)))]
        if i % 4 == 0:
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = passage[:int(rng.integers(20, 61))]
        rows.append((i, "\n ".join(w) + " " * (i % 2)))
    rows += rows[:3] + [(500, None), (501, ""), (502, " \t"), (503, "r " * 200), (None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter(tuple(r) for r in substrings.without_repeats(df, span, gram, frequent, bucket).collect())
    assert got == Counter(brute_removal(rows, span))
    few = substrings.repeated_ranges(df, span, gram, frequent, bucket)
    every = substrings.repeated_ranges(df, span, gram, frequent, bucket, bitmap_bytes=1)    # no bitmap
    covered = lambda d: {bytes(r.text_key): {k for x in r.ranges for k in range(x.low, x.high)} for r in d.collect()}
    assert covered(few) == covered(every)


def test_window_query(spark, awkward, no_docs, corpus):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = Counter(tuple(r) for r in substrings.without_repeats(awkward).collect())
    assert got == Counter(brute_removal(rows, 35))
    assert substrings.without_repeats(no_docs).count() == 0
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    got = Counter(tuple(r) for r in op12_repeated_windows(spark, "/root/testdata/sf0.001").collect())
    assert got == Counter((d, n, m, sha(k)) for d, n, m, k in brute_removal(rows, 35))


def test_minimiser_strings():
    """Strings cover every window once, and equal windows share a key."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 4, int(n))) for n in rng.integers(0, 200, 30)]
    words = Words(pa.array(texts))
    found = substrings.Strings(words, 12, 3)
    key = {}
    at = [int(f) + k for f, c in zip(found.first, found.count) for k in range(c)]
    want = [i for a, b in zip(words.first[:-1], words.first[1:]) for i in range(a, b - 11)]
    assert at == want
    for f, c, k in zip(found.first, found.count, found.key):
        for i in range(int(f), int(f) + int(c)):
            assert key.setdefault(found.hashes[i:i + 12].tobytes(), int(k)) == int(k)


# -- whitening ---------------------------------------------------------------------

def spectrum(values, seed=0):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    return q @ np.diag(values) @ q.T, q


@pytest.mark.parametrize("values", [
    np.linspace(1, 50, 50), 2.0 ** -np.arange(30.0), np.r_[np.full(5, 3.0), np.full(4, 1.0), 7.0],
    np.r_[1 + 1e-9 * np.arange(6), 1 + 1e-12, 5 + 1e-7 * np.arange(3), 1e-3], np.ones(8), np.r_[1.0, np.zeros(5)], [4.0]])
def test_eigen(values):
    values = np.asarray(values, float)
    a = spectrum(values)[0]
    a = (a + a.T) / 2
    e, x = whitening.eigen(a)
    want = np.sort(values)[::-1]
    assert np.abs(e - want).max() <= 4e-15 * want[0]
    assert np.abs(x.T @ x - np.eye(len(e))).max() < 4e-15
    assert np.abs(a @ x - x * e).max() <= 4e-15 * want[0]
    assert (np.diff(e) <= 0).all()


def test_eigen_near_ties_are_told_apart():
    """Differences of 1e-9 are resolved as far as double precision allows."""
    values = np.r_[1 + 1e-9 * np.arange(6), 3.0, 0.5]
    a, q = spectrum(values, 5)
    e, x = whitening.eigen((a + a.T) / 2)
    exact = q[:, np.argsort(-values)]
    assert np.abs(np.abs((exact * x).sum(axis=0)) - 1).max() < 1e-10


def brute_whitening(rows, k=16):
    rows = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    fit = np.array(sorted(set(map(tuple, x))))
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    value, vec = np.linalg.eigh(y.T @ y / n)
    value, vec = value[::-1], vec[:, ::-1]
    w = (np.array(x) - s / n) @ vec[:, :k] / np.sqrt(value[:k])
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    return [i for i, _ in rows], n, dev, w, value[:k] / value.sum()


def check_whitening(out, rows):
    ids, n, dev, w, explained = brute_whitening(rows)
    out = sorted(out, key=lambda r: (r.vec_id, r.component))
    k = w.shape[1]
    assert [r.vec_id for r in out] == [i for i in sorted(ids) for _ in range(k)]
    order = np.argsort(ids, kind="stable")
    assert {r.n for r in out} == {n}
    assert [r.deviation for r in out[::k]] == [dev[i] for i in order]
    got = np.array([r.whitened for r in out]).reshape(-1, k)
    sign = np.sign((got * w[order]).sum(axis=0))
    assert np.abs(got - w[order] * sign).max() < 1e-6
    assert np.allclose([r.explained for r in out[:k]], explained, rtol=1e-9)
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-9


def test_whitening_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    out = op13_whitened_embeddings(spark, "/root/testdata/sf0.001").collect()
    check_whitening(out, [(r.vec_id, r.embedding) for r in rows])


def test_whitening_awkward(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(40)]
    rows += [(100, rows[0][1]), (100, rows[0][1])]
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5),
           (204, []), (205, [1.0, 2.0]), (206, [1e30] * 5)]
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame(rows + odd, schema).selectExpr("*", "'y' AS x", "1 AS n", "2 AS component")
    out = whitening.whiten(df).collect()
    check_sorted = [r for r in out if r.vec_id != 100]
    check_whitening(check_sorted, rows[:40])
    assert len([r for r in out if r.vec_id == 100]) == 10
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame(odd[:5], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.whitened is None) for r in flat) == [
        (1, 1, False), (1, 2, True), (2, 1, False), (2, 2, True)]


def test_large_deviations(spark):
    """Exact where the squares pass 2^53, null beyond a long."""
    rows = [(1, [1e6, 3.0]), (2, [-1e6, 4.0]), (3, [5.0, 2.0 ** 39])]
    out = whitening.whiten(spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in out} == {(2 * 64 * 10 ** 6) ** 2 + 64 ** 2}
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r.deviation is None for r in out)

"""Host quality, language, personal data, BPE, mixing and language model
against plain Python versions and on awkward rows."""
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stoich.llm import bpe, host_quality, language, lm, mixing, privacy
from stoich.llm.common import is_crc_fold
from stoich.llm.queries import tokenizer_file

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


# -- host quality -----------------------------------------------------------------

def measured(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    seen = Counter(wins)
    covered = {i + k for i, g in enumerate(wins) if seen[g] > 1 for k in range(5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered))


def test_measures_match_plain_python(awkward, corpus):
    for docs in (awkward, corpus):
        got = Counter(tuple(r) for r in host_quality.measures(docs).select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
        want = Counter((r[0], *measured(r[1])) for r in docs.select("doc_id", "text").collect())
        assert got == want


def test_host_verdict_needs_evidence(spark):
    good = "one two three four five six seven eight nine ten eleven"
    rows = [(i, good if i % 10 else "bad", "good") for i in range(300)]
    rows += [(1000 + i, good if i % 20 == 0 else "bad", "bad") for i in range(300)]
    rows += [(2000, "bad", "tiny"), (2001, good, None), (2002, "bad", None)]
    out = {r.doc_id: r for r in host_quality.judge(
        spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[1].kept and not out[0].kept and not out[0].host_failed
    assert out[1000].host_failed and not out[1000].kept and not out[1000].base_failed
    assert out[2001].kept and not out[2002].kept and out[2001].host_docs == 0


def test_empty_tables(no_docs, spark):
    assert host_quality.judge(no_docs).count() == 0
    assert language.identify(no_docs, F.col("doc_id") >= 0).count() == 0
    assert privacy.find(no_docs).count() == 0 and privacy.sanitised(no_docs).count() == 0
    assert bpe.encode_documents(no_docs, tokenizer_file()).count() == 0
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_texts(no_docs).count() == 0
    assert lm.score(no_docs, F.col("doc_id") >= 0).count() == 0


# -- language ---------------------------------------------------------------------

def test_automaton_accepts_exactly_the_substrings():
    text = [1, 2, 1, 1, 2, 3, 1, 2]
    step = language.suffix_automaton(text)

    def accepts(seq):
        at = 0
        for c in seq:
            if c not in step[at]:
                return False
            at = step[at][c]
        return True

    inside = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    for n in (1, 2, 3, 4):
        for code in range(3 ** n):
            seq = tuple(code // 3 ** k % 3 + 1 for k in range(n))
            assert accepts(seq) == (seq in inside)


def test_phrase_counts_match_greedy_parse():
    samples = {"x": ["abracadabra abra"], "y": ["zyx zyxx yzz"]}
    parser = language.CrossParser(samples)
    texts = ["abra zyx qq cad", "!!", "", "a" * 3000]
    got, has = parser.phrases(texts)
    assert has.tolist() == [True, False, False, True]
    for li, name in enumerate(parser.names):
        pool = " " + samples[name][0] + " "
        known = {c for s in samples.values() for c in s[0]}
        for ti, text in enumerate(texts):
            if not has[ti]:
                continue
            squeezed = re.sub(r"[^a-z]+", " ", text)
            total = 0
            for a in range(0, len(squeezed), language.RUN):
                run, i = squeezed[a:a + language.RUN], 0
                while i < len(run):
                    j = i + 1
                    while j <= len(run) and run[i:j] in pool and all(c in known for c in run[i:j]):
                        j += 1
                    i = max(i + 1, j - 1)
                    total += 1
            assert got[li, ti] == total, (name, text)


def test_languages_of_many_letters():
    rng = np.random.default_rng(7)
    latin, cyrillic = "abcdefghijklmnopqrstuvwxyzäöüßéèñç", "абвгдежзийклмнопрстуфхцчшщьюя"
    pools = {"en": latin, "ru": cyrillic + "ыэъё", "uk": cyrillic + "іїєґ",
             "ja": "".join(chr(0x5E00 + i) for i in range(400)), "zh": "".join(chr(0x5F00 + i) for i in range(400))}
    lexicon = {name: ["".join(rng.choice(list(pool), 3)) for _ in range(300)] for name, pool in pools.items()}
    text = lambda name, n: " ".join(rng.choice(lexicon[name], n))
    samples = {name: [text(name, 2000 if name == "en" else 700)] for name in pools}
    parser = language.CrossParser(samples)
    given = [(name, text(name, 30)) for name in pools for _ in range(20)]
    assert parser.predict([t for _, t in given])[0] == [name for name, _ in given]
    mixed = [" ".join(text(name, 3) for name in pools) + " 한국 " + text("zh", 5) for _ in range(10)]
    got, _ = parser.phrases(mixed)
    for li, name in enumerate(parser.names):
        pool = f" {samples[name][0]} "
        for ti, t in enumerate(mixed):
            i = total = 0
            while i < len(t):
                j = i + 1
                while j <= len(t) and t[i:j] in pool:
                    j += 1
                i, total = max(i + 1, j - 1), total + 1
            assert got[li, ti] == total
    assert (parser.phrases(["한국어"])[0] == 3).all()        # letters that no sample holds


def test_language_of_held_out_rows_and_awkward_rows(corpus, awkward):
    held = is_crc_fold(F.col("doc_id"), 0)
    out = language.identify(corpus, ~held).where(held).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
    rows = language.identify(awkward, F.lit(True)).select("doc_id", "lang_pred", F.col("score").alias("s")).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 13 and {by[i].lang_pred for i in (1, 2, 3, 9)} == {"und"} and by[9].s == 0.0
    assert all(0 <= r.s <= 1 for r in rows) and by[6].lang_pred == "en"


def test_prediction_ignores_labels(corpus):
    held = is_crc_fold(F.col("doc_id"), 0)
    changed = corpus.withColumn("lang", F.when(~held, F.col("lang")).otherwise("zz")).withColumn("source", F.lit("q"))
    pick = lambda d: sorted(map(tuple, language.identify(d, ~held).select("doc_id", "lang_pred", "score").collect()))
    assert pick(corpus) == pick(changed)


# -- personal data ------------------------------------------------------------------

def plain_spans(x):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        check = sum((n * 2 - 9 * (n > 4)) if i % 2 else n for i, n in enumerate(map(int, d[::-1])))
        if 13 <= len(d) <= 19 and check % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_spans_match_the_patterns(corpus):
    rng = np.random.default_rng(3)
    pieces = ["a@b.c", "x.y+z@mail.example.com", "@@", "a@b", "1.2.3.4", "999.1.1.1", "1.2.3.4.5", "4111 1111-1111 1111",
              "4111111111111112", "+1 (366) 555-9807", "+12", "12", " ", ".", "-", "é", "😀", "a@b.c@d.e", "++1 22 333 4444 5"]
    texts = ["".join(rng.choice(pieces, rng.integers(1, 12))) for _ in range(1500)]
    texts += [r.text for r in corpus.select("text").collect()]
    for t in texts:
        assert privacy.base_spans(t) == plain_spans(t), t


def test_long_runs_of_digits():
    zeros, nines = "0" * 5000, "9" * 5000
    assert privacy.base_spans(f"{zeros}.1.1.1") == [("ip", 0, 5006)]
    assert privacy.base_spans(f"{nines}.1.1.1") == [] and privacy.base_spans(f"{zeros}1.2.3.256") == []
    assert privacy.base_spans(f"{zeros}7.{zeros}.0.255 {nines}") == [("ip", 0, 10008)]


def test_revealing_terms_need_different_contexts(spark, awkward):
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore"
    rows = [(i, f"{filler} note {i} about Zanzibarian reach bob@corp.example.com at {w} {filler}")
            for i, w in enumerate(["dawn", "noon", "dusk", "night"])]
    rows += [(100 + i, f"{filler} at about reach dawn noon {i}") for i in range(60)]
    rows += [(200 + i, "unique copy Quetzal call +1 (366) 555-9807 now please") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in privacy.find(docs).collect()}
    assert out[1].n_email == 1 and out[1].n_term >= 1 and out[100].spans == ""
    term = [s for s in out[1].spans.split(",") if s.startswith("term")]
    text = rows[1][1]
    assert "Zanzibarian" in {text[int(a):int(z)] for _, a, z in (s.split(":") for s in term)}
    assert out[200].n_term == 0            # copies of one context are no evidence
    clean = {r.doc_id: r.text for r in privacy.sanitised(docs).collect()}
    assert "bob@" not in clean[1] and "Zanzibarian" not in clean[1] and "[EMAIL]" in clean[1]
    assert clean[100] == rows[4][1] and "[PHONE]" in clean[200] and "Quetzal" in clean[200]
    got = privacy.sanitised(awkward)
    assert got.columns == awkward.columns and got.count() == 13
    assert {r.doc_id: r.text for r in got.collect()}[5] == awkward.where("doc_id = 5").first().text


def test_terms_far_from_the_entity_and_of_rare_entities(spark):
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore"
    rows = [(i, f"Zanzibarian {filler} reach bob@corp.example.com {filler} said (Zanzibarian), and {filler} ZANZIBARIAN.")
            for i in range(2)]
    rows[1] = (1, rows[1][1] + " twice dolor")
    rows += [(2, f"{filler} Quetzal {filler} call +1 (366) 555-9807 {filler} \u00e9t\u00e9 Quetzal!")]
    rows += [(100 + i, f"{filler} reach said and call twice \u00e9t\u00e9 {i}") for i in range(2000)]
    rows += [(5000, "Zanzibarians elsewhere"), (5001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in privacy.find(docs).collect()}
    clean = {r.doc_id: r.text for r in privacy.sanitised(docs).collect()}
    assert len(out) == len(clean) == len(rows) and clean[5001] is None
    for i, name, times in ((0, "Zanzibarian", 3), (1, "Zanzibarian", 3), (2, "Quetzal", 2)):
        text = rows[i][1]
        told = [s.split(":")[1:] for s in out[i].spans.split(",") if s.startswith("term")]
        assert [text[int(a):int(z)].lower() for a, z in told] == [name.lower()] * times and out[i].n_term == times
        want = re.sub(name, "[TERM]", text, flags=re.I).replace("bob@corp.example.com", "[EMAIL]")
        assert clean[i] == want.replace("+1 (366) 555-9807", "[PHONE]")
    assert all(clean[i] == t and out[i].spans == "" for i, t in rows[3:-1])


# -- BPE --------------------------------------------------------------------------

def test_bpe_matches_the_library(awkward, corpus):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(tokenizer_file())
    lib.no_padding()
    lib.no_truncation()
    for docs in (awkward, corpus):
        got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids))
                      for r in bpe.encode_documents(docs, tokenizer_file()).collect())
        want = Counter()
        for doc_id, text in docs.select("doc_id", "text").collect():
            ids = lib.encode(text or "", add_special_tokens=False).ids
            back = lib.decode(ids, skip_special_tokens=False)
            assert bpe.decode_ids(ids, tokenizer_file()) == back
            want[(doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256(back.encode()).hexdigest(), tuple(ids))] += 1
        assert got == want


def test_bpe_random_texts_and_a_full_cache(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(tokenizer_file())
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    own = bpe.ByteBPE(tokenizer_file())
    rng = np.random.default_rng(5)
    letters = list("abAé'ls  \n\t\x0b\x1c\x85  中한😀1²,.!<|>_‍\x00\r") + ["<|endoftext|>", "aaaa"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(600)] + ["a" * 5000]
    for a in range(0, len(texts), 40):
        ids, n = own.encode(texts[a:a + 40])
        at = np.concatenate(([0], np.cumsum(n)))
        for k, text in enumerate(texts[a:a + 40]):
            assert ids[at[k]:at[k + 1]].tolist() == lib.encode(text, add_special_tokens=False).ids


# -- mixing -----------------------------------------------------------------------

def test_targets():
    plan = mixing.targets([("b", 100), (None, 50), ("a", 10)])
    assert [p[0] for p in plan] == ["a", "b", None]
    assert plan[0][2] == 20 and math.isclose(sum(p[2] for p in plan), 240)
    assert all(g <= 2 * n + 1e-9 for _, n, g in plan) and mixing.targets([]) == [] and mixing.targets([("a", 0)])[0][2] == 0


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (0, 99):
            image = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(image.tolist()) == list(range(n))


def test_mix_sizes_targets_and_repeats(corpus, awkward):
    out = mixing.mix(corpus).toPandas()
    text = dict(corpus.select("doc_id", "text").collect())
    assert (out["size"] == out.doc_id.map(lambda i: len(words(text[i])))).all()
    assert (out.taken <= 2 * out["size"]).all()
    by = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"),
                                   told=("source_size", "first"))
    assert (by["size"] == by.told).all() and (abs(by.taken - by.target) <= 0.05 * by.target + 2 * 64).all()
    again = mixing.mix(corpus.repartition(7)).toPandas()
    pd.testing.assert_frame_equal(out.sort_values("doc_id").reset_index(drop=True),
                                  again.sort_values("doc_id").reset_index(drop=True))
    odd = mixing.mix(awkward).toPandas()
    assert len(odd) == 13 and (odd[odd["size"] == 0].taken == 0).all() and odd.source.isna().sum() == 1


def test_small_sources_meet_their_targets(spark):
    """Within two words or two per cent of the target, whatever the size."""
    for sizes in ({"a": 65, "b": 65, "c": 65, "d": 10}, {"a": 1, "b": 10, "c": 130, None: 65},
                  {"a": 5_000, "b": 3, "c": 40_000, "d": 700, "e": 1}):
        rows = [(i, src, " ".join(["w"] * part)) for src, n in sizes.items()
                for i, part in enumerate([n // 3, n - n // 3])]
        df = spark.createDataFrame(rows, "doc_id long, source string, text string")
        for slots in (4096, 16):
            out = mixing.mix(df, shard_slots=slots).toPandas()
            assert (out.taken <= 2 * out["size"]).all()
            for _, g in out.groupby("source", dropna=False):
                assert abs(g.taken.sum() - g.target.iloc[0]) <= max(2, 0.02 * g.target.iloc[0])


def test_mixed_texts_hold_what_was_taken(corpus):
    mixed = mixing.mixed_texts(corpus).toPandas()
    taken = mixing.mix(corpus).toPandas().set_index("doc_id").taken
    got = mixed.assign(n=mixed.text.map(lambda t: len(words(t)))).groupby("doc_id").n.sum()
    assert (got.reindex(taken.index).fillna(0) == taken).all()
    text = dict(corpus.select("doc_id", "text").collect())
    for r in mixed.itertuples():
        assert r.n_chars == len(r.text)
        assert all(part in text[r.doc_id] for part in [r.text] if "\n" not in part)


# -- language model -----------------------------------------------------------------

def test_base_score_and_counts(corpus, awkward):
    for docs, check in ((corpus, True), (awkward, False)):
        learn = ~is_crc_fold(F.col("doc_id"), 1)
        out = lm.score(docs, learn, hot_words=200, rounds=1).collect()
        rows = docs.select("doc_id", "text", learn.alias("learn")).collect()
        tokens = [[w.translate(LOWER) for w in words(r.text)] + [None] for r in rows]
        count = Counter(w for t, r in zip(tokens, rows) if r.learn for w in t)
        total, v = sum(count.values()), len(count)
        want = {}
        for r, t in zip(rows, tokens):
            want.setdefault(r.doc_id, []).append((len(t), sum(count[w] > 0 for w in t), sum(
                math.log10((count[w] + 0.5) / (total + 0.5 * (v + 1))) for w in t)))
        assert len(out) == len(rows)
        for r in out:
            n, known, base = want[r.doc_id][0]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
            assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-6)
            assert r.score < 0 and math.isfinite(r.score)
        if check:
            assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_word_step_is_normalised_and_learns_from_order():
    rng = np.random.default_rng(2)
    hashes = rng.integers(1, 1 << 62, 600).astype(np.uint64)
    counts = np.sort(rng.integers(5, 900, 600))[::-1]
    lex = lm.Lexicon(hashes, counts, 128 + rng.integers(0, 32, 600), 256)
    assert lex.size == 256 and lex.n_own == 95 and lex.first[-1] == 256 and (np.diff(lex.first) == 8).all()
    assert np.allclose(np.bincount(lex.word_class, lex.unigram), 1)
    model = lm.WordModel(lex)
    vocab = 1 + lex.n_own + np.arange(256)
    every = lambda m, one, two: np.stack([m.log10(np.full(256, one), np.full(256, two), np.arange(256))])[0]
    flat = lm.WordModel(lex)
    for n in range(30):
        word = rng.integers(0, 256, 800)            # the word before decides: same place in its class
        one = vocab[(word + 8 * rng.integers(0, 32, 800)) % 256]
        model.step(one, vocab[rng.integers(0, 256, 800)], word, np.random.Generator(np.random.PCG64(n)))
    for one, two in ((0, 0), (3, 200), (300, 1)):
        p = 10.0 ** every(model, one, two)
        assert np.allclose(np.bincount(lex.word_class, p), 1, atol=1e-4)
    word = rng.integers(0, 256, 2000)
    one, two = vocab[(word + 8 * rng.integers(0, 32, 2000)) % 256], vocab[rng.integers(0, 256, 2000)]
    assert model.log10(one, two, word).mean() > flat.log10(one, two, word).mean() + 0.05
    again = lm.WordModel(lex)
    again.set(model.parameters())
    assert np.allclose(again.log10(one, two, word), model.log10(one, two, word))


def test_vocabulary_grows_and_pays(spark):
    assert lm.vocabulary_size(0) == 1 << 10 and lm.vocabulary_size(10 ** 8) == 1 << 14 and lm.vocabulary_size(10 ** 14) == 1 << 16
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    learn = ~is_crc_fold(F.col("doc_id"), 1)
    held = {r: [s.score for s in lm.score(docs, learn, word_rounds=r).where(is_crc_fold(F.col("doc_id"), 1))
                .orderBy("doc_id").collect()] for r in (0, 2)}
    assert sum(held[2]) > sum(held[0]) + 0.01 * abs(sum(held[0]))


def test_model_is_normalised_and_nce_improves():
    rng = np.random.default_rng(1)
    noise = rng.random(lm.CLASSES) + 0.1
    noise /= noise.sum()
    model = lm.LogBilinear(noise)
    table = model.log10_table()
    assert np.allclose((10 ** table).sum(axis=1), 1)
    ctx = np.arange(50)
    counts = rng.poisson(3 * (np.arange(lm.CLASSES)[None, :] % 7 == ctx[:, None] % 7), (50, lm.CLASSES)).astype(float)
    first = model.train(ctx, counts, steps=1)
    assert model.train(ctx, counts, steps=60) > first
    better = model.log10_table()
    assert (counts * better[ctx]).sum() > (counts * table[ctx]).sum()



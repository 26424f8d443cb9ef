"""N-gram join, components, embeddings, archives, pages and the pipeline
against brute force, and on awkward rows."""
import gzip
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stoich.llm import bpe, embedding_dups, html, ngram_join, privacy, warc
from stoich.llm.common import materialise
from stoich.llm.components import connected_components
from stoich.llm.queries import tokenizer_file

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def roots(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


# -- components -------------------------------------------------------------------

def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 301), (301, 300)]
    edges += [(int(a) + 1000, int(b) + 1000) for a, b in rng.integers(0, 80, (60, 2))]
    out = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = roots(2000, edges)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.root for r in out} == {x: want[x] for x in touched}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- n-gram join --------------------------------------------------------------------

def shingles(text):
    w = [x.translate(LOWER) for x in WORD.findall(text or "")]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(sets)) for j in range(i)
             if sets[i] and 4 * len(sets[i]) >= 3 * len(sets[j]) and 4 * len(sets[j]) >= 3 * len(sets[i])
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = roots(len(rows), links)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root[i]] = min(least.get(root[i], doc_id), doc_id)
    return Counter((rows[i][0], len(sets[i]), least[root[i]]) for i in range(len(rows)))


def varied_copies(n, seed, most=6):
    """Copies of one text with up to ``most`` words replaced, chains of edits,
    and unrelated texts that share a passage."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = [str(w) for w in rng.choice(vocabulary, 120)]
    passage = " ".join(str(w) for w in rng.choice(vocabulary, 60))
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.integers(0, most)):
            w[rng.integers(0, len(w))] = f"e{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    for i in range(n, 2 * n):
        rows.append((i, " ".join(str(w) for w in rng.choice(vocabulary, 80)) + " " + passage))
    chain = [str(w) for w in rng.choice(vocabulary, 100)]
    for i in range(2 * n, 2 * n + 12):
        chain[(i * 7) % 100] = f"c{i}"
        rows.append((i, " ".join(chain)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_matches_brute_force(spark, seed):
    rows = varied_copies(60, seed)
    rows += [(r[0], r[1].upper().replace("V", "v").replace("E", "e").replace("C", "c")) for r in rows[:5]]
    out = ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert Counter(map(tuple, out.select("doc_id", "n_shingles", "component_id").collect())) == brute_components(rows)


def test_join_on_the_corpus_and_awkward_rows(corpus, awkward, no_docs):
    for docs in (corpus, awkward):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = ngram_join.near_copies(docs).select("doc_id", "n_shingles", "component_id")
        assert Counter(map(tuple, out.collect())) == brute_components(rows)
    assert ngram_join.near_copies(no_docs).count() == 0


def test_divide_skip_finds_every_member():
    rng = np.random.default_rng(4)
    for size in (1, 8, 80):
        base = rng.choice(10**6, size, replace=False)
        members = []
        for _ in range(40):
            own = base[rng.random(size) < rng.choice([0.5, 0.8, 0.95, 1.0])]
            extra = rng.choice(10**6, rng.integers(0, max(2, size // 4)), replace=False) + 10**6
            members.append(np.unique(np.concatenate([own, extra])).astype(np.uint64))
        members = [m for m in members if len(m)]
        lists = ngram_join.InvertedLists(members)
        for q in members:
            want = {(i, len(np.intersect1d(q, m))) for i, m in enumerate(members)
                    if 7 * len(np.intersect1d(q, m)) >= 3 * (len(q) + len(m))}
            assert set(lists.search(q)) == want


def test_one_of_each_keeps_other_columns_and_repeated_ids(spark, awkward):
    kept = ngram_join.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 6, 9, 10, 11, 12])
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (1, text), (1, "quite another text of some seven words"), (2, text), (3, None), (3, text), (3, None)]
    left = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, left)) == Counter([(1, text), (1, rows[2][1]), (3, None), (3, None)])


# -- embeddings ----------------------------------------------------------------------

def brute_vectors(rows, threshold=0.98):
    ok = [label is not None and v is not None and len(v) > 0 and None not in v and np.isfinite(v).all()
          and np.any(np.array(v, float)) for _, v, label in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float) / max(map(abs, v))) / max(map(abs, v)) if k else None
            for (_, v, _), k in zip(rows, ok)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and rows[i][2] == rows[j][2]
             and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
    degree = Counter(x for link in links for x in link)
    root = roots(len(rows), links)
    least = {}
    for i, r in enumerate(rows):
        least[root[i]] = min(least.get(root[i], r[0]), r[0])
    return Counter((r[0], degree[i], least[root[i]], r[0] == least[root[i]]) for i, r in enumerate(rows))


def test_vectors_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(25):
        centre = rng.normal(size=24)
        for _ in range(rng.integers(1, 14)):
            v = centre + rng.normal(size=24) * rng.choice([0.02, 0.1, 0.14])
            rows.append((len(rows), [float(x) for x in v * rng.choice([1, 5])], int(rng.integers(0, 3))))
    rows += [(1000, rows[0][1], rows[0][2]), (1001, rows[0][1], rows[0][2]), (1002, rows[0][1], None), (5, rows[0][1], rows[0][2])]
    rows += [(1100, None, 1), (1101, [], 1), (1102, [0.0] * 24, 1), (1103, [None] + [1.0] * 23, 1),
             (1104, [float("nan")] * 24, 1), (1105, [float("inf")] * 24, 1), (1106, [1.0, 2.0], 1), (1107, [2.0, 4.0], 1)]
    rows += [(2000 + i, [float(x) for x in 1e-160 * (np.ones(24) + 0.01 * rng.normal(size=24))], 7) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("row", F.lit("x"))
    monkeypatch.setattr(embedding_dups, "BLOCK", 8)     # buckets dealt in several blocks
    out = embedding_dups.near_copies(df).select("vec_id", "n_links", "component_id", "kept").collect()
    assert Counter(map(tuple, out)) == brute_vectors(rows)
    assert embedding_dups.near_copies(df.limit(0)).count() == 0


def test_bounds_hold_and_rotation_is_orthogonal():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 64))
    x[150:] = x[:150] + 0.1 * rng.normal(size=(150, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert np.allclose(embedding_dups.rotation(64) @ embedding_dups.rotation(64).T, np.eye(64))
    codes = embedding_dups.Codes(x)
    bounds = codes.upper_bounds(codes)
    assert (bounds >= x @ x.T).mean() > 0.9999
    assert (bounds < 0.98).mean() > 0.95       # nearly all pairs need no exact product


# -- archives -----------------------------------------------------------------------

def test_archives_round_trip(spark, tmp_path):
    big = "x" * 300_000 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"
    htmls = [None, "", "short", "short", "<p>" + "é\r\n\r\n" * 60, "<p>" + "é\r\n\r\n" * 60, big, big, "y" * 99, "y" * 99,
             "z" * 100 + "\r\n", "z" * 100 + "\r\n\r\n", "\r\n" * 80, "\r\n" * 80, "\r\r\n\r\n\n" * 40]
    rows = [(i * 3, None if i == 4 else f" http://h/{i} a\tb\n", h) for i, h in enumerate(htmls)] + [(18, "u", big), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    out = warc.archive_round_trip(pages.repartition(3)).collect()
    want, first = Counter(), {}
    for page, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 100 and page is not None:
            first[p] = min(first.get(p, page), page)
    for page, _, h in rows:
        p = (h or "").encode()
        again = len(p) >= 100 and first[p] != page
        want[(page, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response",
              first[p] if again else None, None if again else p)] += 1
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                   None if r.payload is None else bytes(r.payload)) for r in out)
    assert got == want and all(" " not in r.url and r.captured.endswith("Z") for r in out)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_legacy_files_of_both_versions(spark, tmp_path):
    for version in (1, 2):
        data = warc.arc_version_block(version)
        for i in range(3):
            data += warc.arc_record(version, f"http://h/{version}/{i}", "20010203040506",
                                    warc.http_block(f"body {i}\n\n".encode() * i))
        (tmp_path / f"{version}.arc").write_bytes(data)
        (tmp_path / f"{version}.arc.gz").write_bytes(gzip.compress(data))
    out = Counter((r.url, r.captured, bytes(r.payload)) for r in warc.read_arc_files(spark, str(tmp_path)).collect())
    assert out == Counter({(f"http://h/{v}/{i}", "2001-02-03T04:05:06Z", f"body {i}\n\n".encode() * i): 2
                           for v in (1, 2) for i in range(3)})
    with pytest.raises(ValueError):
        warc.parse_arc_record(b"http://h 0.0.0.0 20010101000000 text/html 50\nshort", 1)
    with pytest.raises(ValueError):
        warc.parse_arc_line(b"http://h only", warc.ARC_FIELDS[2])


# -- pages -----------------------------------------------------------------------------

PAGES = [
    (None, ""), ("", ""), ("just text &amp; more", "just text & more"), ("<nav>menu</nav>", ""),
    ("<p>a<p>b<br>c<i>d</i>e", "a b cde"), ("a < b <!-- never closed", "a < b"),
    ("<div class='content'><h2>Head</h2><p>Some <b>bold</b> text,&nbsp;with words. And more.</p><ul><li>one</li></ul>"
     "<p>x &lt; y</p></div><div class='sidebar'><p>Side text, not wanted.</p></div><form>f</form><footer>foot</footer>",
     "Head Some bold text, with words. And more. one x < y"),
    ("<header>Site</header><article><header><h1>T</h1></header><p>Body, text.</p><div id='ad-3'>Buy</div>"
     "<section class='comments'><p>I like this, very much so!</p></section></article><aside>x</aside>", "T Body, text."),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><main><p>Yes</p></main>", "Yes"),
    ("<p title='a>b'>q</p><p title=\"open>r</p>", "q r"),
    ("<article>" + "<p>word, word.</p>" * 5000 + "</article>", "word, word. " * 4999 + "word, word."),
]


def test_pages(spark):
    rows = [(i, "u", h) for i, (h, _) in enumerate(PAGES)] + [(2, "u", PAGES[2][0]), (None, None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html.extract(df).collect()
    assert Counter((r.page_id, r.text, r.n_chars) for r in out) == Counter(
        [(i, t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(2, PAGES[2][1], len(PAGES[2][1])), (None, "x", 1)])
    assert html.extract(df.limit(0)).count() == 0


def test_articles_of_the_pages_table(spark):
    import html as lib
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = dict(pages.select("page_id", "html").collect())
    for r in html.extract(pages).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", source[r.page_id], re.S)[1]
        plain = re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", inner))
        assert r.text == " ".join(lib.unescape(plain).split())


BODY = "<p>" + "A long sentence of the article, with commas, and more words. " * 6 + "</p>"
ITEM = "<li>" + "An item of the list that holds most of the text, item by item. " * 3 + "</li>"
LINKED = "<ul>" + "<li><a href='/x'>Another page</a></li>" * 9 + "</ul>"
LAYOUTS = [
    # a title outside the body, within an article or not
    f"<article><h1>Title</h1><div class=body>{BODY * 12}</div></article>",
    f"<div class=page>{LINKED}<h2>Title</h2><p class=by>By me</p><div class=entry>{BODY * 12}</div></div>",
    # lead, parts with headings and a conclusion in elements of their own
    f"<div class=lead><p>A lead, in short.</p></div><div class=body>{BODY * 20}</div><div class=end><p>So it ends.</p></div>",
    f"<section class=a><h2>One</h2>{BODY * 30}</section><section class=b><h2>Two</h2>{BODY}</section>",
    f"<h2>One</h2><div class=part>{BODY * 9}</div><h2>Two</h2><div class=part>{BODY * 9}</div>",
    # a long list between paragraphs
    f"<div><p>Before the list.</p><ul>{ITEM * 60}</ul><p>After it.</p></div>",
    # a list of links amid the article, and a linked word, heading and item that stay
    f"<div>{BODY * 4}{LINKED}{BODY * 4}<h2><a href='#s'>Part</a></h2><ul><li>one</li><li><a href='/y'>two</a></li>"
    f"<li>three and four</li></ul>{BODY * 4}</div>",
]


@pytest.mark.parametrize("k", range(len(LAYOUTS)))
def test_whole_article_of_usual_layouts(k):
    page = f"<html><body><nav>Home</nav>{LAYOUTS[k]}<footer>foot</footer></body></html>"
    plain = re.sub("<[^>]+>", " ", LAYOUTS[k].replace(LINKED, " "))
    assert html.main_text(page) == " ".join(plain.split())


def test_deep_and_odd_pages_take_linear_time():
    import time
    start = time.time()
    assert html.main_text("<div>" * 50_000 + "deep text, here." + "</section>" * 50_000) == "deep text, here."
    assert html.main_text("<p " + "x" * 200_000 + ">word, word.</p>") == "word, word."
    assert html.main_text("<b>" * 50_000 + "bold, text." + "</i>" * 50_000) == "bold, text."
    assert time.time() - start < 20


# -- pipeline ----------------------------------------------------------------------------

def test_pipeline_against_plain_steps(spark, corpus):
    docs = corpus
    stages = dict(corpus_pipeline.STAGES)
    spoken = materialise(stages["language"](spark, docs, ""))
    assert spoken.columns == docs.columns
    assert {r.doc_id for r in spoken.collect()} == {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}
    single = materialise(stages["near_copies"](spark, spoken, ""))
    rows = [(r.doc_id, r.text) for r in spoken.collect()]
    assert Counter(r.doc_id for r in single.collect()) == Counter(
        {d: 1 for (d, n, c), k in brute_components(rows).items() if n == 0 or d == c})
    clean = materialise(stages["privacy"](spark, single, ""))
    text = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        assert not privacy.base_spans(r.text) and r.n_chars == len(r.text)
        if not privacy.base_spans(text[r.doc_id]):
            assert r.text == text[r.doc_id]
    mixed = materialise(stages["mix"](spark, clean, ""))
    assert mixed.columns == docs.columns
    ids = stages["encode"](spark, mixed, "").collect()
    want = Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect())
    assert Counter((r.doc_id, r.decoded_sha256) for r in ids) == want
    assert all(bpe.decode_ids(r.ids, tokenizer_file()) for r in ids[:5] if r.n_tokens)


def test_pipeline_stages_on_awkward_and_empty_tables(spark, awkward, no_docs):
    for docs, rows in ((awkward, 6), (no_docs, 0)):
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            now = materialise(stage(spark, now, ""))
            if name != "encode":
                assert now.columns == docs.columns
            if name == "near_copies":
                assert now.count() == rows
        assert (now.count() > 0) == (rows > 0)


def test_pipeline_run_deletes_working_tables(spark):
    from stoich.session import written_tables
    before = set(written_tables())
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    left = [p for p in written_tables() if p not in before]
    assert rows > 0 and len(left) == 4          # the four stages' results
    assert not set(corpus_pipeline._working) & set(left)

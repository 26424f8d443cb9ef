"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoich.llm import (bpe, embedding_dups, host_quality, html, language, lm, mixing, ngram_join, privacy, runs,
                        substrings, warc, whitening)
from stoich.llm.common import is_crc_fold
from stoich.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def tokenizer_file() -> str:
    """Place of the public vocabulary file, installed on every machine."""
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base rules and host verdict of every document."""
    return host_quality.judge(_docs(spark, sf_dir))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
wins AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1),
rep AS (
  SELECT doc_id, count(*) AS r FROM (
    SELECT DISTINCT doc_id, i + k AS p FROM dup CROSS JOIN (SELECT unnest(range(0, 5)) AS k)) GROUP BY 1),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (
  SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.r, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
hosts AS (
  SELECT source AS host, count(*) AS host_docs, CAST(sum(CAST(base_failed AS BIGINT)) AS BIGINT) AS host_failures
  FROM b WHERE source IS NOT NULL GROUP BY 1),
fit AS (
  SELECT sum(host_failures) / sum(host_docs) AS mu, var_pop(host_failures / host_docs) AS v FROM hosts),
prior AS (
  SELECT mu, CASE WHEN v > 0 THEN greatest(1.0, mu * (1 - mu) / v - 1) ELSE 1.0 END AS strength FROM fit),
verdict AS (
  SELECT hosts.*, (host_failures + mu * strength) / (host_docs + strength) > 0.5 AS bad FROM hosts, prior)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(bad, false) AS kept, coalesce(bad, false) AS host_failed,
       coalesce(host_docs, 0) AS host_docs, coalesce(host_failures, 0) AS host_failures
FROM b LEFT JOIN verdict ON b.source = verdict.host"""


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    docs = _docs(spark, sf_dir).select("doc_id", "lang", "text")
    held_out = is_crc_fold(F.col("doc_id"), 0)
    return language.identify(docs, ~held_out).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it, in every document."""
    return privacy.find(_docs(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document."""
    return bpe.encode_documents(_docs(spark, sf_dir), tokenizer_file(), with_ids=False)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC and WARC and back."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f"""


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy component of every document."""
    return ngram_join.near_copies(_docs(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT r, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
link AS MATERIALIZED (
  SELECT a, b FROM shared JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT r, r AS t FROM d UNION SELECT reach.r, way.b FROM reach JOIN way ON way.a = reach.t)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) JOIN reach USING (r) JOIN d o ON o.r = reach.t GROUP BY d.r, d.doc_id, n.n"""


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, learned outside the held-out fold."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    scored = lm.score(docs, ~is_crc_fold(F.col("doc_id"), 1))
    return scored.select("doc_id", is_crc_fold(F.col("doc_id"), 1).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents at 150 % of their words."""
    return mixing.mix(_docs(spark, sf_dir)).drop("source")


def op10_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy component of every embedding."""
    return embedding_dups.near_copies(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v
      WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND list_dot_product(e, e) > 0),
link AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND a.r < b.r AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT r, r AS t FROM v UNION SELECT reach.r, way.b FROM reach JOIN way ON way.a = reach.t),
least AS (SELECT reach.r, min(o.vec_id) AS component_id FROM reach JOIN v o ON o.r = reach.t GROUP BY 1),
degree AS (SELECT a AS r, count(*) AS n FROM way GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least USING (r) LEFT JOIN degree USING (r)"""


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, its tail planted."""
    return runs.digests(_docs(spark, sf_dir))


def op12_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that start elsewhere too."""
    return substrings.without_repeats(_docs(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
mark AS (
  SELECT word.r, p, x, max(dup.i) OVER (PARTITION BY word.r ORDER BY p ROWS UNBOUNDED PRECEDING) + 34 >= p AS gone
  FROM word LEFT JOIN dup ON dup.r = word.r AND dup.i = word.p),
kept AS (
  SELECT r, count(*) AS n_words, count_if(coalesce(gone, false)) AS n_removed,
         string_agg(x, ' ' ORDER BY p) FILTER (WHERE NOT coalesce(gone, false)) AS t
  FROM mark GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""


def op13_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_host_quality": op1_host_quality,
    "op2_language": op2_language,
    "op3_pii": op3_pii,
    "op4_bpe": op4_bpe,
    "op5_warc": op5_warc,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_lm_score": op7_lm_score,
    "op8_html_text": op8_html_text,
    "op9_mix_sources": op9_mix_sources,
    "op10_embedding_dups": op10_embedding_dups,
    "op11_word_runs": op11_word_runs,
    "op12_repeated_windows": op12_repeated_windows,
    "op13_whitened_embeddings": op13_whitened_embeddings,
}
ORACLES: dict[str, str] = {
    "op1_host_quality": OP1_SQL.strip(), "op5_warc": OP5_SQL.strip(), "op6_ngram_jaccard": OP6_SQL.strip(),
    "op10_embedding_dups": OP10_SQL.strip(), "op12_repeated_windows": OP12_SQL.strip(),
}

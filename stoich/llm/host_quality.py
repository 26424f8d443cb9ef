"""Host-level quality rules, in DataFrame functions only.

Every document is measured and judged by the base rules; the failures are
counted per host, each host's failure rate is shrunk towards a beta prior
fitted to the rates of all hosts (method of moments), and hosts whose shrunk
rate exceeds ``MAX_RATE`` are rejected with all their documents.  A host seen
a few times thus needs far more evidence than a large one.

The documents' ``source`` is taken as the host.  Failures are pre-aggregated
per task, so a host with a third of all rows costs no more than others; the
verdicts come back by a broadcast join while there are few hosts, and by a
salted join beyond that.

Repeated five-word windows are found per document from sorted 64-bit window
hashes.  Defined cases: a null or blank text has no word and fails; documents
with a null source are judged by their own rules only; repeated rows count
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoich.llm.common import SPACE_CLASS, SPACES, materialise

MAX_RATE = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
BROADCAST_HOSTS = 100_000
SALTS = 32


def measures(docs: DataFrame) -> DataFrame:
    """Per row doc_id, source, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blank = F.array().cast("array<string>")
    bare = F.btrim(F.col("t"), F.lit(SPACES))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), text.alias("t"))
    rows = rows.select(
        "doc_id", "source",
        F.when(bare == "", blank).otherwise(F.split(bare, SPACE_CLASS)).alias("w"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"))
    rows = rows.select(
        "doc_id", "source", F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _window_hashes(F.col("w")).alias("h"))
    # most texts repeat no window: only the others sort (hash, position) pairs
    rows = rows.withColumn("s", F.when(
        F.size(F.array_distinct("h")) < F.size("h"),
        F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    rows = rows.drop("h").withColumn("p", F.sort_array(F.transform(
        F.filter("s", lambda e, j: (F.coalesce(F.get("s", j - 1)["h"] == e["h"], F.lit(False))
                                    | F.coalesce(F.get("s", j + 1)["h"] == e["h"], F.lit(False)))),
        lambda e: e["i"])))
    covered = F.aggregate(
        F.transform("p", lambda p, j: F.coalesce(F.least(F.lit(WINDOW), F.get("p", j + 1) - p), F.lit(WINDOW))),
        F.lit(0), lambda acc, x: acc + x)
    rows = rows.select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _window_hashes(words: Column) -> Column:
    """Hash of the window that starts at each word; none under six words."""
    every = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)]))
    return F.when(F.size(words) > WINDOW, F.slice(every, F.lit(1), F.size(words) - (WINDOW - 1))) \
        .otherwise(F.array().cast("array<bigint>"))


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, host_docs, host_failures, rate) with the shrunk rate."""
    hosts = materialise(measured.where("source IS NOT NULL").groupBy(F.col("source").alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"),
        F.sum(F.col("base_failed").cast("bigint")).alias("host_failures")))
    raw = F.col("host_failures") / F.col("host_docs")
    fit = hosts.agg((F.sum("host_failures") / F.sum("host_docs")).alias("m"), F.var_pop(raw).alias("v")).first()
    mean, spread = fit["m"] or 0.0, fit["v"] or 0.0
    strength = max(1.0, mean * (1 - mean) / spread - 1) if spread > 0 else 1.0
    return hosts.withColumn("rate", (F.col("host_failures") + mean * strength) / (F.col("host_docs") + strength))


def judge(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """The measures with host_docs, host_failures, host_failed and kept."""
    measured = materialise(measures(docs))
    hosts = host_rates(measured)
    if hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        joined = measured.join(F.broadcast(hosts), F.col("source") == F.col("host"), "left")
    else:
        salted = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = measured.join(salted, (F.col("source") == F.col("host"))
                               & (F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)) == F.col("_salt")), "left")
    failed = F.coalesce(F.col("rate") > max_rate, F.lit(False))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~failed).alias("kept"), failed.alias("host_failed"),
        F.coalesce("host_docs", F.lit(0)).alias("host_docs"),
        F.coalesce("host_failures", F.lit(0)).alias("host_failures"))

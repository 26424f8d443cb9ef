"""Stand-in inputs derived from the driver tables (FIXTURES.md part B).

Each builder reads the given parquet tables, so its work grows with them.
The SQL strings are the DuckDB spellings of the same derivations, used by the
oracle queries as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoich.functions.rng import uniform
from stoich.sources.tables import table

# The three model names and the two feature kinds used to tag
# experiment scores, in natural order.
MODEL_NAMES = ["rf", "gbr", "ridge"]
KINDS = ["empirical", "embedding"]

# Total number of candidate feature indices (embedding dimension).
N_FEATURES = 64


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, element, amount) = quantity per brand per order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        li.join(p, li.l_partkey == p.p_partkey)
        .groupBy(F.col("l_orderkey").alias("sample_id"), F.col("p_brand").alias("element"))
        .agg(F.sum("l_quantity").alias("amount"))
    )


C1_SQL = """composition AS (
  SELECT l_orderkey AS sample_id, p_brand AS element, sum(l_quantity) AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def percent_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 as percent shares rounded to one place, so row sums scatter
    around 100 (feeds the sum-window filter)."""
    c = composition(spark, sf_dir)
    tot = F.sum("amount").over(_by_sample())
    return c.select("sample_id", "element",
                    F.round(F.lit(100.0) * F.col("amount") / tot, 1).alias("amount"))


C1P_SQL = """pcomposition AS (
  SELECT sample_id, element,
         round(100.0 * amount / sum(amount) OVER (PARTITION BY sample_id), 1) AS amount
  FROM composition)"""


def _by_sample():
    from pyspark.sql import Window
    return Window.partitionBy("sample_id")


def embedding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(element, feature_id, value): brand n takes all vectors with
    vec_id % 25 = n - 1, averaged per position.  Components are added as
    integers of 1e-9, so the mean does not depend on the order of rows."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("feature_id", "x"))
    units = F.floor(F.col("x").cast("double") * F.lit(1e9) + F.lit(0.5))
    return (e.groupBy((F.pmod("vec_id", F.lit(25)) + 1).alias("n"), "feature_id")
            .agg((F.sum(units).cast("double") / F.lit(1e9) / F.count(F.lit(1))).alias("value"))
            .select(F.concat(F.lit("Brand#"), F.col("n").cast("string")).alias("element"),
                    F.col("feature_id").cast("bigint").alias("feature_id"), "value"))


C2_SQL = """efeat AS (
  SELECT 'Brand#' || CAST(n AS VARCHAR) AS element, feature_id,
         CAST(sum(CAST(floor(x * 1e9 + 0.5) AS BIGINT)) AS DOUBLE) / 1e9 / count(*) AS value
  FROM (SELECT vec_id % 25 + 1 AS n, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS feature_id,
               CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
  GROUP BY n, feature_id)"""


def empirical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four per-brand statistics of ``part`` as element features."""
    p = table(spark, sf_dir, "part")
    agg = p.groupBy(F.col("p_brand").alias("element")).agg(
        F.avg("p_size").alias("f0"), F.avg("p_retailprice").alias("f1"),
        (F.max("p_retailprice") - F.min("p_retailprice")).alias("f2"),
        F.count(F.lit(1)).cast("double").alias("f3"))
    return agg.select("element", F.expr(
        "stack(4, 0L, f0, 1L, f1, 2L, f2, 3L, f3) AS (feature_id, value)"))


C3_SQL = """pstat AS (
  SELECT p_brand AS element, avg(p_size) AS f0, avg(p_retailprice) AS f1,
         max(p_retailprice) - min(p_retailprice) AS f2, CAST(count(*) AS DOUBLE) AS f3
  FROM part GROUP BY 1),
pfeat AS (
  SELECT element, 0::BIGINT AS feature_id, f0 AS value FROM pstat UNION ALL
  SELECT element, 1::BIGINT, f1 FROM pstat UNION ALL
  SELECT element, 2::BIGINT, f2 FROM pstat UNION ALL
  SELECT element, 3::BIGINT, f3 FROM pstat)"""


def all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of every feature kind with a ``kind`` column."""
    return (empirical_features(spark, sf_dir).withColumn("kind", F.lit("empirical"))
            .unionByName(embedding_features(spark, sf_dir).withColumn("kind", F.lit("embedding"))))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: (sample_id, y, class_label, proc_1, proc_2) from orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_totalprice").alias("y"),
        F.col("o_orderpriority").alias("class_label"),
        F.col("o_orderstatus").alias("proc_1"),
        (F.col("o_custkey") % 12).alias("proc_2"))


C4_SQL = """targets AS (
  SELECT o_orderkey AS sample_id, o_totalprice AS y, o_orderpriority AS class_label,
         o_orderstatus AS proc_1, o_custkey % 12 AS proc_2 FROM orders)"""


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, text) - each document split on newlines."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text")) \
        .select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "text")


C5_SQL = """lines AS (
  SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no,
         unnest(string_split(text, chr(10))) AS text
  FROM documents)"""


def experiment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long experiment scores (D12) from ``events``."""
    ev = table(spark, sf_dir, "events")
    models = F.array(*[F.lit(m) for m in MODEL_NAMES])
    return ev.select(
        F.col("event_id").alias("exp_id"),
        (F.col("user_id") % 3).alias("prop_id"),
        (F.lit(1) + F.col("event_id") % 8).alias("f_n"),
        (F.col("user_id") % 48).alias("traj_id"),
        F.when(F.col("event_type").isin("view", "click"), F.lit("empirical"))
        .otherwise(F.lit("embedding")).alias("kind"),
        F.element_at(models, (F.floor(F.col("event_id") / 8) % 3 + 1).cast("int")).alias("model"),
        F.floor(F.col("event_id") / 24).cast("bigint").alias("seed"),
        F.col("value").alias("score"),
    )


C6_SQL = """scores AS (
  SELECT event_id AS exp_id, user_id % 3 AS prop_id, 1 + event_id % 8 AS f_n,
         user_id % 48 AS traj_id,
         CASE WHEN event_type IN ('view', 'click') THEN 'empirical' ELSE 'embedding' END AS kind,
         (['rf', 'gbr', 'ridge'])[CAST(floor(event_id / 8) % 3 AS BIGINT) + 1] AS model,
         CAST(floor(event_id / 24) AS BIGINT) AS seed, value AS score
  FROM events)"""


def hash_indices(id_col, f_n_col, total: int = N_FEATURES, seed: str = "7"):
    """A random distinct index subset of size f_n per row (G10's draw)."""
    from stoich.operators.sampling import random_subset
    return random_subset(id_col, total, f_n_col, seed)


def sql_hash_indices(id_expr: str, f_n_expr: str, total: int = N_FEATURES, seed: str = "7") -> str:
    from stoich.operators.sampling import sql_random_subset
    return sql_random_subset(id_expr, total, f_n_expr, seed)


def selection_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature-selection records (D13) from ``events``: one per event."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id")
    f_n = F.lit(1) + F.col("event_id") % 8
    return ev.select(
        F.col("event_id").alias("rec_id"),
        (F.col("user_id") % 3).alias("prop_id"),
        f_n.alias("f_n"),
        (F.col("user_id") % 48).alias("traj_id"),
        F.floor(F.col("event_id") / 48).cast("bigint").alias("generation"),
        uniform("fit", F.col("event_id")).alias("fitness"),
        hash_indices(F.col("event_id"), f_n).alias("indices"),
    )


def c8_sql(with_indices: bool = True) -> str:
    from stoich.functions.rng import sql_uniform
    idx = (", " + sql_hash_indices("event_id", "1 + event_id % 8") + " AS indices") if with_indices else ""
    return f"""records AS (
  SELECT event_id AS rec_id, user_id % 3 AS prop_id, 1 + event_id % 8 AS f_n,
         user_id % 48 AS traj_id, CAST(floor(event_id / 48) AS BIGINT) AS generation,
         {sql_uniform('fit', 'event_id')} AS fitness{idx}
  FROM events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, features array<double>, label)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"),
                    F.col("label").cast("bigint").alias("label"))

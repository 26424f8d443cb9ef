"""Readers and writers.

Files are the interface between jobs: results are written partitioned by
their keys so that later lookups prune partitions instead of globbing, and
file-name keys are parsed from ``_metadata.file_path`` only for data that
arrives with its keys in the name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_property_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A property table as CSV with a header and an explicit schema (no
    inference pass)."""
    return spark.read.csv(path, header=True, schema=schema)


def read_skipping_unit_row(spark: SparkSession, path: str, numeric: Sequence[str]) -> DataFrame:
    """The row under a file's header holds units.  The first record of the
    input tells the units; rows equal to it in every column are left out if a
    numeric column of it is no number.  All other rows stay: a number that
    does not parse becomes null."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    units = raw.first()
    rows = raw
    if units is not None and any(units[c] is not None and not _is_number(units[c]) for c in numeric):
        is_units = F.lit(True)
        for c in raw.columns:
            is_units = is_units & F.col(f"`{c}`").eqNullSafe(F.lit(units[c]))
        rows = raw.where(~is_units)
    return rows.select([F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) if c in numeric else F.col(f"`{c}`")
                        for c in raw.columns])


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def py_element_name(name: str) -> str:
    """X5 for column headers (driver-side strings, no data)."""
    t = str(name).strip().replace("%", "")
    return t[:1].upper() + t[1:].lower() if t else t


def external_compositions(df: DataFrame, labels: Sequence[str], id_col: str | None = None) -> DataFrame:
    """Normalise column names (X5), absent elements -> 0, each row
    normalised to sum 1, rows summing to 0 dropped.  Returns (row id,
    comp array<double>) aligned with ``labels``."""
    names = {c: py_element_name(c) for c in df.columns if c != id_col}
    cols = []
    for lab in labels:
        src = [c for c, n in names.items() if n == lab]
        cols.append(F.coalesce(F.col(f"`{src[0]}`").cast("double"), F.lit(0.0)) if src else F.lit(0.0))
    rid = F.col(id_col) if id_col else F.monotonically_increasing_id()
    arr = df.select(rid.alias("row_id"), F.array(*cols).alias("_a"))
    tot = F.aggregate("_a", F.lit(0.0), lambda a, x: a + x)
    return arr.where(tot > 0).select("row_id", F.transform("_a", lambda x: x / tot).alias("comp"))


def write_lines(df: DataFrame, path: str, text: str = "text", order: Sequence[str] = ()) -> None:
    """K1: one line per row, UTF-8; with ``order`` the part files in name
    order hold the lines in that order (a range sort, no single task)."""
    d = df.select(*order, text)
    if order:
        d = d.orderBy(*order)
    d.select(text).write.mode("overwrite").text(path)


def write_tokens(blocks: DataFrame, path: str, split: str = "split") -> None:
    """K2: packed sequences, one folder per split."""
    blocks.write.mode("overwrite").partitionBy(split).parquet(path)


def partition_results(df: DataFrame, path: str, keys: Sequence[str] = ("prop_id", "f_n")) -> None:
    """K3: results into key=value folders; an existing partition is replaced
    (dynamic partition overwrite), others are kept."""
    spark = df.sparkSession
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.write.mode("overwrite").partitionBy(*keys).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """K5 (and K4 with sep='\\t'): CSV with a header."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """K6: one JSON record per row (nested structs and arrays kept)."""
    df.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Every result file under ``path``; partition columns come from the
    folder names, and the source file is kept for keys in file names."""
    return spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))


def read_evolution(spark: SparkSession, path: str, prop_id: int, f_n: int, kind: str | None = None) -> DataFrame:
    """The selection history of a property and feature count (and feature
    kind, if the table has one) from key=value folders; an empty match is an
    error.  The best record is A11's argmax over it."""
    rows = lookup(spark.read.parquet(path), prop_id, f_n)
    return rows if kind is None else rows.where(F.col("kind") == kind)


def lookup(results: DataFrame, prop_id: int, f_n: int, traj_id: int | None = None,
           first: bool = False) -> DataFrame:
    """Records of (prop, f_n[, traj]) - filters on partition columns
    are pruned at planning time; an empty match is an error."""
    r = results.where((F.col("prop_id") == prop_id) & (F.col("f_n") == f_n))
    if traj_id is not None:
        r = r.where(F.col("traj_id") == traj_id)
    if r.limit(1).count() == 0:
        raise LookupError(f"no records for prop {prop_id}, f_n {f_n}, traj {traj_id}")
    return r.limit(1) if first else r

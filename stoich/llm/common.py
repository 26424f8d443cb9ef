"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stoich.llm.words import give_back
from stoich.session import cut_lineage

#: Pattern of a separator between words (a word is ``[^\x20\x09-\x0D]+``).
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: The six separator characters themselves, for trimming.
SPACES = " \t\n\x0b\x0c\r"


#: Rows that travel to a Python worker at once, at most: texts may be long.
BATCH_ROWS = 1_000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS if it is larger, so
    that a batch of whole texts stays small beside an executor's memory."""
    now = int(spark.conf.get(_BATCH_CONF))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


_shared: list[Broadcast] = []


def shared(spark: SparkSession, value) -> Broadcast:
    """A broadcast variable that :func:`release` can find again."""
    _shared.append(spark.sparkContext.broadcast(value))
    return _shared[-1]


def shared_values() -> list[Broadcast]:
    """Broadcast variables of :func:`shared` that were not released."""
    return list(_shared)


def release(spark: SparkSession, values: list[Broadcast]) -> None:
    """Destroy broadcast variables that no DataFrame needs any more, and let
    the driver drop plans, broadcast tables and buffers it no longer refers to:
    a long job otherwise keeps them until its heap is full."""
    for b in values:
        if b in _shared:
            _shared.remove(b)
            b.destroy()
    give_back()
    spark._jvm.System.gc()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back."""
    return cut_lineage(df)


def is_crc_fold(id_col: Column, remainder: int, modulus: int = 5) -> Column:
    """Whether crc32 of the id written as text leaves ``remainder``; a null id
    counts as the empty text."""
    text = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % modulus == remainder


def running_offset(df: DataFrame, key: str, order: list[str], value: str, out: str,
                   rows_per_chunk: int = 4_096) -> DataFrame:
    """Exclusive running sum of ``value`` within ``key``, in a fixed order.

    A key may hold a third of all rows, so no window spans a whole key: rows
    are dealt by hash into chunks of about ``rows_per_chunk`` rows, summed
    inside a chunk, and shifted by the totals of the earlier chunks (one row
    per chunk).  ``df`` must be cheap to read twice (a written table).
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).select(
        F.col(key).alias("_k"), F.greatest(F.lit(1), F.ceil(F.col("_n") / rows_per_chunk)).alias("_c"))
    small = sizes.limit(10_001).count() <= 10_000
    parts = (df.join(F.broadcast(sizes) if small else sizes, F.col(key).eqNullSafe(F.col("_k")), "left")
             .withColumn("_chunk", F.pmod(F.xxhash64(*order), F.col("_c"))).drop("_k", "_c"))
    totals = parts.groupBy(key, "_chunk").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(key).alias("_k"), F.col("_chunk").alias("_ch"),
                           F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = (Window.partitionBy(key, "_chunk").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (parts.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(totals, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_chunk") == F.col("_ch")))
            .withColumn(out, F.col("_in") + F.col("_before"))
            .drop("_in", "_before", "_k", "_ch", "_chunk"))


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """All columns of ``df`` in one struct ``whole``, and some beside it, so
    that no name of the input can clash with a name of an operator."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole"),
                     *[F.col(f"`{c}`") for c in columns])


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of the struct again, some of them replaced."""
    return df.select([changed[c].alias(c) if c in changed else F.col("whole").getField(c).alias(c)
                      for c in columns])

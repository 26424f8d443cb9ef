"""Readers and writers as queries: a table is written to the shared
checkpoint folder and read back, so a result row means a round trip."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoich.functions.rng import sql_uniform
from stoich.operators import models as ML
from stoich.plans.catalog import ORACLES, query, with_ctes
from stoich.plans import q_corpus, q_results
from stoich.session import ensure_checkpoint_dir
from stoich.sources import fixtures as FX
from stoich.sources import io as IO
from stoich.sources.tables import table


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("s4_property_csv", with_ctes(FX.C4_SQL) + """
SELECT sample_id, y, class_label, proc_1, proc_2 FROM targets""")
def s4_property_csv(spark, sf_dir):
    """S4 (+ K5): the property table as CSV with a header, read with an
    explicit schema."""
    t = FX.targets(spark, sf_dir)
    path = _folder(spark, "property")
    IO.write_csv(t, path)
    return IO.read_property_csv(spark, path, t.schema)


def _with_unit_row(df: DataFrame, units: dict[str, str]) -> DataFrame:
    """String columns, and the unit row as first record of every partition."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([units[c]], pa.string()) for c in names], names=names)
        yield from batches

    text = df.select([F.col(c).cast("string") for c in names])
    return text.mapInArrow(run, text.schema)


@query("s5_unit_row", """
SELECT CAST(o_orderkey AS DOUBLE) AS sample_id,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS y, o_orderstatus AS proc_1 FROM orders""")
def s5_unit_row(spark, sf_dir):
    """A row of units under the header is left out; rows whose number does
    not parse stay, with a null."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sample_id"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("y"),
        F.col("o_orderstatus").alias("proc_1"))
    path = _folder(spark, "units")
    IO.write_csv(_with_unit_row(o, {"sample_id": "(-)", "y": "MPa", "proc_1": "(-)"}), path)
    return IO.read_skipping_unit_row(spark, path, ["sample_id", "y"])


@query("s11_read_evolution", with_ctes(FX.c8_sql()) + """
SELECT rec_id, traj_id, generation, fitness, array_to_string(indices, ',') AS indices
FROM records WHERE prop_id = 1 AND f_n = 6""")
def s11_read_evolution(spark, sf_dir):
    """The selection history of property 1 with 6 features."""
    path = _folder(spark, "evolution")
    IO.partition_results(FX.selection_records(spark, sf_dir), path)
    return IO.read_evolution(spark, path, 1, 6).select(
        "rec_id", "traj_id", "generation", "fitness", F.array_join("indices", ",").alias("indices"))


@query("k1_write_lines", ORACLES["x4_normalise_text"].replace(
    "SELECT split, doc_id, line_no, text FROM norm", "SELECT text, count(*) AS n FROM norm GROUP BY text"))
def k1_write_lines(spark, sf_dir):
    """K1: the normalised lines as text files, read back."""
    path = _folder(spark, "lines")
    IO.write_lines(q_corpus._norm(spark, sf_dir), path, order=["split", "doc_id", "line_no"])
    return spark.read.text(path).groupBy(F.col("value").alias("text")).agg(F.count(F.lit(1)).alias("n"))


@query("k2_write_tokens", ORACLES["t4_pack_sequences"])
def k2_write_tokens(spark, sf_dir):
    """K2: packed sequences in one folder per split, read back."""
    path = _folder(spark, "tokens")
    IO.write_tokens(q_corpus.t4_pack_sequences(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("k5_csv_table", ORACLES["a6_result_summary"])
def k5_csv_table(spark, sf_dir):
    """K5: the result summary as CSV, read back with its schema."""
    summary = q_results.a6_result_summary(spark, sf_dir)
    path = _folder(spark, "summary")
    IO.write_csv(summary, path)
    return spark.read.csv(path, header=True, schema=summary.schema)


@query("k6_json_records", ORACLES["a11_best_overall"])
def k6_json_records(spark, sf_dir):
    """K6: the best records as JSON lines, read back with their schema."""
    best = q_results.a11_best_overall(spark, sf_dir)
    path = _folder(spark, "best")
    IO.write_json(best, path)
    return spark.read.schema(best.schema).json(path)


TRIALS = {"num_trees": [50, 100, 200], "max_depth": [3, 5, 8, 12, 30], "min_leaf": [1, 2, 4]}


@query("g12_trial_table", "SELECT o_orderkey, " + ", ".join(
    f"CAST({values}[CAST(floor({sql_uniform('trial', 'o_orderkey', repr(name))} * {len(values)}) AS BIGINT) + 1] AS INTEGER) AS {name}"
    for name, values in TRIALS.items()) + " FROM orders")
def g12_trial_table(spark, sf_dir):
    """One hyperparameter trial per order."""
    return ML.trial_table(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", TRIALS)

"""Streaming normaliser and file round trips."""
import os
import tempfile

from pyspark.sql import functions as F

from stoich.functions.text import normalise_text
from stoich.operators import corpus as K
from stoich.sources import io as IO
from stoich.streaming.corpus import normalise_stream


def test_stream_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="stoich-stream-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.txt"), "w", encoding="utf-8") as f:
        f.write("  Éléphant\tvert \n\n中文a\n")
    with open(os.path.join(src, "b.txt"), "w", encoding="utf-8") as f:
        f.write("naïve café\n")
    q = normalise_stream(spark, src, os.path.join(d, "out"), os.path.join(d, "ckpt"))
    q.awaitTermination(120)
    got = sorted(r.text for r in spark.read.parquet(os.path.join(d, "out")).collect())
    batch = spark.createDataFrame([("Éléphant\tvert",), ("中文a",), ("naïve café",)], "t string")
    want = sorted(r.n for r in batch.select(normalise_text(F.col("t")).alias("n")).collect())
    assert got == want


def test_partitioned_results_round_trip(spark):
    d = tempfile.mkdtemp(prefix="stoich-io-")
    df = spark.createDataFrame([(1, 2, 0, 0.5), (1, 3, 1, 0.7), (2, 2, 0, 0.1)],
                               "prop_id int, f_n int, traj_id int, score double")
    IO.partition_results(df, d)
    back = IO.read_results(spark, d)
    assert back.count() == 3
    assert IO.lookup(back, 1, 3).count() == 1
    # replacing one partition keeps the others (dynamic overwrite)
    IO.partition_results(spark.createDataFrame([(1, 3, 5, 0.9)], df.schema), d)
    back = IO.read_results(spark, d)
    assert sorted(r.traj_id for r in back.collect()) == [0, 0, 5]


def test_external_compositions_normalises_headers(spark):
    df = spark.createDataFrame([(1, 2.0, 2.0), (2, 0.0, 0.0)], "id long, ` ti%` double, `AL` double")
    got = IO.external_compositions(df, ["Ti", "Al", "Nb"], id_col="id").collect()
    assert len(got) == 1 and list(got[0].comp) == [0.5, 0.5, 0.0]


def test_write_lines_and_tokens(spark):
    d = tempfile.mkdtemp(prefix="stoich-io-")
    lines = spark.createDataFrame([(0, "b"), (1, "a")], "k long, text string")
    IO.write_lines(lines.coalesce(1), os.path.join(d, "lines"), order=["k"])
    assert [r.value for r in spark.read.text(os.path.join(d, "lines")).collect()] == ["b", "a"]
    blocks = spark.createDataFrame([("train", 0, [1, 2]), ("val", 0, [1, 2])], "split string, block_no long, input_ids array<int>")
    IO.write_tokens(blocks, os.path.join(d, "tok"))
    assert {"split=train", "split=val"} <= set(os.listdir(os.path.join(d, "tok")))
    assert K.MAX_SEQ_LEN == 512

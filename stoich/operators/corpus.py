"""Corpus preparation as Spark jobs: lines, vocabulary, encoding, packing
into fixed-length blocks, and masking (S1-S3, A19, T1-T5, X21).

Order-bearing data always carries an explicit key: a line is identified by
(split, doc_id, line_no) and "the order of the corpus" is the order of that
key.  Packing (T4) depends on a running position over the whole ordered
corpus; it is computed exactly with a two-level prefix scan of
position-transfer functions (see :func:`pack_sequences`), never with one
global window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stoich.functions.rng import uniform
from stoich.functions.text import normalise_text, strip_py, word_tokens
from stoich.operators.ordering import _MID, _PID, _tag_sorted, global_rank
from stoich.session import bounded_broadcast, cut_lineage

# Reserved special token ids.
PAD_ID, CLS_ID, SEP_ID, UNK_ID, MASK_ID = 0, 1, 2, 3, 4
N_SPECIAL = 5
SPECIAL_TOKENS = {"[PAD]": PAD_ID, "[CLS]": CLS_ID, "[SEP]": SEP_ID, "[UNK]": UNK_ID, "[MASK]": MASK_ID}
VOCAB_SIZE = 128_100
MAX_SEQ_LEN = 512
LINE_BREAK = "\r\n|\r|\n"
# Sentences per chunk of the packing scan (bounds the memory of one task).
TREE_WIDTH = 256
PACK_CHUNK_ROWS = 1_000_000


def read_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_blank: bool = True) -> DataFrame:
    """One row per line (universal newlines), stripped as
    str.strip(); blank lines kept (S1) or dropped (S2)."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), LINE_BREAK, -1)).alias("line_no", "text"))
    lines = lines.select(key, F.col("line_no").cast("bigint").alias("line_no"), strip_py(F.col("text")).alias("text"))
    return lines if keep_blank else lines.where(F.length("text") > 0)


def read_lines_files(spark, path: str, keep_blank: bool = True) -> DataFrame:
    """S1 for text files: ``spark.read.text`` with the file as key and the
    line position inside the file (``wholetext`` keeps a file's line order;
    a file is one task, so use many moderate files)."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return read_lines(raw, text="value", key="file", keep_blank=keep_blank)


def normalise_lines(lines: DataFrame, lowercase: bool = False) -> DataFrame:
    """X4 over a line table (blank lines dropped first, as S2 loads them)."""
    return lines.where(F.length("text") > 0).withColumn("text", normalise_text(F.col("text"), lowercase=lowercase))


def vocabulary(train_lines: DataFrame, vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """Word-token counts over the training lines; the top
    ``vocab_size - 5`` by (count desc, token) get ids from 5 on, after the
    reserved special ids.  Counting is a partial aggregate (a frequent token
    is pre-aggregated per task); ranking is an exact distributed rank."""
    counts = (train_lines.select(F.explode(word_tokens(F.col("text"))).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("count")))
    ranked = global_rank(counts, [F.col("count").desc(), F.col("token")], out="_rk")
    return ranked.where(F.col("_rk") < vocab_size - N_SPECIAL).select(
        "token", (F.col("_rk") + N_SPECIAL).alias("id"), "count")


def encode_lines(lines: DataFrame, vocab: DataFrame, keys: Sequence[str] = ("split", "doc_id", "line_no"),
                 vocab_max_rows: int = VOCAB_SIZE) -> DataFrame:
    """Per line the ids of its tokens as one array (keys..., ids); unknown
    tokens get UNK.  The vocabulary is bounded by its size parameter and
    travels as one dictionary, so tokens never become rows."""
    words = vocab.select("token", F.col("id").cast("int")).limit(vocab_max_rows + 1).toArrow().combine_chunks()
    if len(words) > vocab_max_rows:
        raise ValueError(f"the vocabulary has more than {vocab_max_rows} entries")
    known = lines.sparkSession.sparkContext.broadcast(
        tuple(pa.concat_arrays(words.column(i).chunks or [pa.array([], t)])
              for i, t in enumerate((pa.string(), pa.int32()))))
    rows = lines.select(*keys, word_tokens(F.col("text")).alias("_tokens"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ids = known.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            found = ids.take(pc.index_in(lists.flatten(), value_set=tokens)).fill_null(UNK_ID)
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy()))).astype(np.int32)
            out = pa.ListArray.from_arrays(pa.array(ends), found, mask=lists.is_null() if lists.null_count else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=schema.names)

    return rows.mapInArrow(run, schema)


def encode_tokens(lines: DataFrame, vocab: DataFrame, keys: Sequence[str] = ("split", "doc_id", "line_no")) -> DataFrame:
    """Ids per line - tokens, then the trailing SEP (the leading CLS is
    dropped, as the reference pops it)."""
    return encode_lines(lines, vocab, keys).withColumn("ids", F.concat("ids", F.array(F.lit(SEP_ID))))


def coverage(encoded: DataFrame, by: str = "split") -> DataFrame:
    """Known-token share per split (1 - UNK share) of encoded lines."""
    unknown = F.sum(F.size(F.filter("ids", lambda i: i == UNK_ID)))
    return encoded.groupBy(by).agg(F.sum(F.size("ids")).alias("n_tokens"), unknown.alias("n_unknown")) \
        .where("n_tokens > 0").withColumn("known_share", 1 - F.col("n_unknown") / F.col("n_tokens"))


# -- T4: packing ---------------------------------------------------------------

def _advance_table(r: np.ndarray, w: int) -> np.ndarray:
    """For each start residue rho in [0, w): total advance of the running
    position after the sentences with content lengths ``r`` (in order).
    Starts whose positions have met stay together, so only distinct positions
    modulo w are carried on."""
    start = np.arange(w, dtype=np.int64)
    e, of = start.copy(), start.copy()      # position of each group, group of each start
    base = np.zeros(w, np.int64)            # how far each start was ahead of its group
    for i, x in enumerate(r.tolist()):
        e = e + x
        e = e + (e % w != 0)
        if i % 64 == 63 and len(e) > 1:
            _, first, same = np.unique(e % w, return_index=True, return_inverse=True)
            if len(first) < len(e):
                base += (e - e[first][same])[of]
                e, of = e[first], same[of]
    return e[of] + base - start


def _compose(first: np.ndarray, second: np.ndarray, w: int) -> np.ndarray:
    rho = np.arange(w, dtype=np.int64)
    a1 = first
    return a1 + second[(rho + a1) % w]


def pack_sequences(encoded: DataFrame, max_len: int = MAX_SEQ_LEN,
                   keys: Sequence[str] = ("doc_id", "line_no"), split: str = "split",
                   pad_ids: bool = True) -> DataFrame:
    """T4: greedy packing into blocks of ``max_len``: CLS, then sentence
    pieces each followed by SEP; a sentence may span blocks; a block left
    with one free slot gets a filler SEP; a trailing empty block is dropped.

    Restated with W = max_len - 2 content slots per block and a running
    position e (per split, in key order), a sentence of r > 0 content tokens
    puts token j at block (e+j) div W, slot 1 + (e+j) mod W, then e += r and
    e += 1 iff e mod W != 0 (that slot holds the SEP).  The step depends on
    e only through e mod W, so a run of sentences is a function of the start
    residue (a table of W advances).  Exact and parallel:

    1. the sentence-length table is range-sorted by (split, key) and cut into
       chunks of at most PACK_CHUNK_ROWS (partition, position // chunk);
    2. per chunk, the W-entry advance table (Arrow batch, numpy);
    3. chunk tables are composed per partition, then per TREE_WIDTH
       partitions; the driver scans one table per such group, and the start
       offsets are pushed back down: group -> partition -> chunk -> sentence;
    4. every sentence is cut into one slice per block, and the slices of a
       block (<= max_len ids) are put together by a group-by.

    ``encoded``: (split, keys..., ids) with the content ids (no SEP).
    Returns (split, block_no, input_ids, attention_mask).
    """
    keys = list(keys)
    w = max_len - 2
    s = encoded.where(F.size("ids") > 0).select(split, *keys, F.size("ids").cast("bigint").alias("r"))
    tagged = _tag_sorted(s, [F.col(split), *[F.col(k) for k in keys]])
    # slice = (partition, split); position inside the slice from the tag
    sl = tagged.groupBy(_PID, split).agg(F.min(_MID).alias("_min"))
    tagged = tagged.join(bounded_broadcast(sl), [_PID, split]).withColumn(
        "_chunk", F.floor((F.col(_MID) - F.col("_min")) / PACK_CHUNK_ROWS).cast("bigint"))

    adv_schema = T.StructType([T.StructField(_PID, T.IntegerType()), T.StructField(split, T.StringType()),
                               T.StructField("_chunk", T.LongType()),
                               T.StructField("adv", T.ArrayType(T.LongType()))])

    def chunk_fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_MID)
        adv = _advance_table(pdf["r"].to_numpy(), w)
        return pd.DataFrame({_PID: [pdf[_PID].iloc[0]], split: [pdf[split].iloc[0]],
                             "_chunk": [pdf["_chunk"].iloc[0]], "adv": [adv.tolist()]})

    chunks = tagged.select(_PID, split, "_chunk", _MID, "r").groupBy(_PID, split, "_chunk") \
        .applyInPandas(chunk_fn, adv_schema)

    slice_schema = T.StructType([T.StructField(_PID, T.IntegerType()), T.StructField(split, T.StringType()),
                                 T.StructField("adv", T.ArrayType(T.LongType())),
                                 T.StructField("chunk_adv", T.ArrayType(T.ArrayType(T.LongType())))])

    def slice_fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        tabs = [np.asarray(a, dtype=np.int64) for a in pdf["adv"]]
        total = tabs[0]
        for t in tabs[1:]:
            total = _compose(total, t, w)
        return pd.DataFrame({_PID: [pdf[_PID].iloc[0]], split: [pdf[split].iloc[0]],
                             "adv": [total.tolist()], "chunk_adv": [[t.tolist() for t in tabs]]})

    # one row per (partition, split); materialised once, read three times
    slices = cut_lineage(chunks.groupBy(_PID, split).applyInPandas(slice_fn, slice_schema)
                         .withColumn("_grp", F.floor(F.col(_PID) / TREE_WIDTH).cast("bigint")))
    group_schema = T.StructType([T.StructField("_grp", T.LongType()), T.StructField(split, T.StringType()),
                                 T.StructField("adv", T.ArrayType(T.LongType()))])

    def group_fn(pdf: pd.DataFrame) -> pd.DataFrame:
        tabs = [np.asarray(a, dtype=np.int64) for a in pdf.sort_values(_PID)["adv"]]
        total = tabs[0]
        for t in tabs[1:]:
            total = _compose(total, t, w)
        return pd.DataFrame({"_grp": [pdf["_grp"].iloc[0]], split: [pdf[split].iloc[0]], "adv": [total.tolist()]})

    # the driver sees one W-entry table per split and TREE_WIDTH partitions
    rows = slices.select(_PID, split, "adv", "_grp").groupBy("_grp", split) \
        .applyInPandas(group_fn, group_schema).collect()
    spark = encoded.sparkSession
    starts, at = [], {}
    for r in sorted(rows, key=lambda r: r["_grp"]):
        e = at.get(r[split], 0)
        starts.append((r["_grp"], r[split], e))
        at[r[split]] = e + int(r["adv"][e % w])
    group_starts = spark.createDataFrame(starts, T.StructType([
        T.StructField("_grp", T.LongType()), T.StructField(split, T.StringType()),
        T.StructField("_gstart", T.LongType())]))
    start_schema = T.StructType([T.StructField(_PID, T.IntegerType()), T.StructField(split, T.StringType()),
                                 T.StructField("_sstart", T.LongType())])

    def partition_starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_PID)
        e, out = int(pdf["_gstart"].iloc[0]), []
        for adv in pdf["adv"]:
            out.append(e)
            e += int(adv[e % w])
        return pd.DataFrame({_PID: pdf[_PID], split: pdf[split], "_sstart": out})

    start_df = slices.select(_PID, split, "adv", "_grp").join(F.broadcast(group_starts), ["_grp", split]) \
        .groupBy("_grp", split).applyInPandas(partition_starts, start_schema)

    chunk_start_schema = T.StructType([T.StructField(_PID, T.IntegerType()), T.StructField(split, T.StringType()),
                                       T.StructField("_chunk", T.LongType()), T.StructField("_cstart", T.LongType())])

    def chunk_starts(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        e = int(row["_sstart"])
        out = []
        for i, tab in enumerate(row["chunk_adv"]):
            out.append((int(row[_PID]), row[split], i, e))
            e += int(tab[e % w])
        return pd.DataFrame(out, columns=[_PID, split, "_chunk", "_cstart"])

    cstarts = slices.join(start_df, [_PID, split]).select(_PID, split, "_sstart", "chunk_adv") \
        .groupBy(_PID, split).applyInPandas(chunk_starts, chunk_start_schema)

    sent_schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in s.schema.fields if f.name != "r"],
                                T.StructField("e", T.LongType()), T.StructField("r", T.LongType())])
    names = [f.name for f in sent_schema.fields]

    def sentence_starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_MID)
        e = int(pdf["_cstart"].iloc[0])
        r = pdf["r"].to_numpy(dtype=np.int64)
        es = np.empty(len(r), dtype=np.int64)
        for i, x in enumerate(r):
            es[i] = e
            e += int(x)
            if e % w:
                e += 1
        pdf = pdf.assign(e=es)
        return pdf[names]

    sent = tagged.join(cstarts, [_PID, split, "_chunk"]) \
        .groupBy(_PID, split, "_chunk").applyInPandas(sentence_starts, sent_schema)

    # one piece per (sentence, block), SEP behind it
    b, e = F.col("block_no"), F.col("e")
    lo = F.greatest(F.lit(0), b * w - e)
    hi = F.least(F.col("r"), (b + 1) * w - e)
    pieces = (encoded.join(sent.select(split, *keys, "e", "r"), [split, *keys])
              .withColumn("block_no", F.explode(F.sequence(F.floor(e / w), F.floor((e + F.col("r") - 1) / w))))
              .select(split, "block_no", (1 + (e + lo) % w).alias("slot"),
                      F.concat(F.slice("ids", (lo + 1).cast("int"), (hi - lo).cast("int")),
                               F.array(F.lit(SEP_ID))).alias("piece")))
    blocks = pieces.groupBy(split, "block_no").agg(
        F.array_sort(F.collect_list(F.struct("slot", "piece"))).alias("_items"))
    last = blocks.groupBy(split).agg(F.max("block_no").alias("_last"))
    blocks = blocks.join(F.broadcast(last), split)
    body = F.flatten(F.transform("_items", lambda it: it["piece"]))
    # a block before the last is full: one free slot gets a filler SEP
    filler = (F.col("block_no") < F.col("_last")) & (F.size(body) < w + 1)
    ids = F.concat(F.array(F.lit(CLS_ID)), body,
                   F.when(filler, F.array(F.lit(SEP_ID))).otherwise(F.array().cast("array<int>")))
    blocks = blocks.select(split, "block_no", ids.alias("input_ids"))
    blocks = blocks.withColumn("attention_mask", attention_mask(F.size("input_ids"), max_len))
    if pad_ids:
        blocks = blocks.withColumn("input_ids", F.concat("input_ids", F.array_repeat(
            F.lit(PAD_ID), F.lit(max_len) - F.size("input_ids"))))
    return blocks


def attention_mask(n, max_len: int = MAX_SEQ_LEN):
    """N ones then zeros up to max_len."""
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n))


def mlm_mask(blocks: DataFrame, vocab_size: int, seed="mlm", prob: float = 0.15,
             split: str = "split") -> DataFrame:
    """T5 (``vocab_size``: ids in use, special ones included): each non-special token chosen with probability 0.15; of those 80 %
    become MASK, 10 % a random id, 10 % stay; labels are the original id
    where chosen, -100 elsewhere.  Hash randomness per (split, block, slot)."""
    def draw(tag, i):
        return uniform(f"{seed}-{tag}", F.col(split), F.col("block_no"), i)

    special = F.array(F.lit(PAD_ID), F.lit(CLS_ID), F.lit(SEP_ID))
    chosen = lambda x, i: (~F.array_contains(special, x)) & (draw("p", i) < F.lit(prob))
    masked = F.transform("input_ids", lambda x, i: F.when(
        chosen(x, i), F.when(draw("k", i) < 0.8, F.lit(MASK_ID))
        .when(draw("k", i) < 0.9, F.floor(draw("r", i) * vocab_size).cast("int")).otherwise(x)).otherwise(x))
    labels = F.transform("input_ids", lambda x, i: F.when(chosen(x, i), x).otherwise(F.lit(-100)))
    return blocks.withColumn("masked_ids", masked).withColumn("labels", labels)


"""Corpus queries (section 3.1 flow): S1-S3, X1-X5, G1 tagging, A19, T1,
T3, T4 (+X21), T5.

Flow: documents -> lines (S1) -> train/val split on all lines (G1, S3) ->
blank lines dropped (S2) -> normalise (X4) -> vocabulary from the train
split (A19) -> encode (T1) -> pack (T4) -> mask (T5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoich.functions import text as X
from stoich.functions.rng import sql_uniform
from stoich.operators import corpus as K
from stoich.operators import sampling as S
from stoich.plans.catalog import query
from stoich.session import cut_lineage, spread
from stoich.sources.tables import table

LINES_SQL = f"""raw AS (
  SELECT doc_id, CAST(generate_subscripts(string_split_regex(text, '{K.LINE_BREAK}'), 1) - 1 AS BIGINT) AS line_no,
         unnest(string_split_regex(text, '{K.LINE_BREAK}')) AS text FROM documents),
lines1 AS (SELECT doc_id, line_no,
  regexp_replace(text, '^{X.PY_SPACE_CLASS}+|{X.PY_SPACE_CLASS}+$', '', 'g') AS text FROM raw)"""

TAG_SQL = f"""tr AS (SELECT *, row_number() OVER (ORDER BY {sql_uniform('split', 'doc_id', 'line_no')}, doc_id, line_no) - 1 AS rk,
  count(*) OVER () AS n FROM lines1),
tagged AS (SELECT CASE WHEN rk < round_even(n * 0.1, 0) THEN 'val' ELSE 'train' END AS split, doc_id, line_no, text FROM tr)"""


def _norm_sql(col: str) -> str:
    c = f"regexp_replace(regexp_replace({col}, '{X.WS_CLASS}', ' ', 'g'), '{X.DROP_CLASS}', '', 'g')"
    c = f"regexp_replace({c}, '{X.CJK_CLASS}', ' \\0 ', 'g')"
    return f"strip_accents({c})"


NORM_SQL = f"""norm AS (SELECT split, doc_id, line_no, {_norm_sql('text')} AS text FROM tagged WHERE length(text) > 0)"""

TOK_SQL = f"""tok AS (SELECT split, doc_id, line_no,
    CAST(generate_subscripts(regexp_extract_all(text, '{X.TOKEN_PATTERN}'), 1) - 1 AS BIGINT) AS pos,
    unnest(regexp_extract_all(text, '{X.TOKEN_PATTERN}')) AS token FROM norm),
cnt AS (SELECT token, count(*) AS count FROM tok WHERE split = 'train' GROUP BY token),
vocab AS (SELECT * FROM (SELECT token, CAST(row_number() OVER (ORDER BY count DESC, token) - 1 + {K.N_SPECIAL} AS BIGINT) AS id, count FROM cnt)
          WHERE id < {K.VOCAB_SIZE}),
ids AS (SELECT t.split, t.doc_id, t.line_no, t.pos, CAST(coalesce(v.id, {K.UNK_ID}) AS INTEGER) AS id
        FROM tok t LEFT JOIN vocab v ON t.token = v.token)"""


def _lines(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return K.read_lines(docs)


def _tagged(spark, sf_dir):
    # the split reads the lines three times
    lines = cut_lineage(_lines(spark, sf_dir))
    t = S.train_eval_split(lines, "split", ["doc_id", "line_no"])
    return t.withColumn("split", F.when(F.col("split") == "eval", F.lit("val")).otherwise(F.lit("train")))


def _norm(spark, sf_dir):
    return K.normalise_lines(_tagged(spark, sf_dir)).select("split", "doc_id", "line_no", "text")


def _vocab(spark, sf_dir):
    return K.vocabulary(_norm(spark, sf_dir).where(F.col("split") == "train"))


def _encoded(spark, sf_dir):
    """(encoded lines, number of ids in use); the normalised lines and the
    vocabulary are materialised once, both are read several times."""
    n = cut_lineage(_norm(spark, sf_dir))
    vocab = cut_lineage(K.vocabulary(n.where(F.col("split") == "train")))
    return K.encode_lines(n, vocab), vocab.count() + K.N_SPECIAL


@query("s1_read_lines", f"WITH {LINES_SQL}\nSELECT doc_id, line_no, text FROM lines1")
def s1_read_lines(spark, sf_dir):
    """Every line (blank ones kept), stripped like str.strip()."""
    return _lines(spark, sf_dir)


@query("s2_read_corpus", f"WITH {LINES_SQL}\nSELECT doc_id, line_no, text FROM lines1 WHERE length(text) > 0")
def s2_read_corpus(spark, sf_dir):
    """As S1 with blank lines dropped."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return K.read_lines(docs, keep_blank=False)


@query("s3_tagged_corpus", f"WITH {LINES_SQL},\n{TAG_SQL}\nSELECT split, doc_id, line_no FROM tagged")
def s3_tagged_corpus(spark, sf_dir):
    """S3 (+G1): the train and validation lines as one table with a split
    name; exactly round_half_even(n / 10) validation lines."""
    return _tagged(spark, sf_dir).select("split", "doc_id", "line_no")


@query("x1_clean_text", f"""WITH {LINES_SQL}
SELECT doc_id, line_no, regexp_replace(regexp_replace(text, '{X.WS_CLASS}', ' ', 'g'), '{X.DROP_CLASS}', '', 'g') AS text
FROM lines1""")
def x1_clean_text(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", X.clean_text(F.col("text")).alias("text"))


@query("x2_pad_cjk", f"""WITH {LINES_SQL}
SELECT doc_id, line_no, regexp_replace(text, '{X.CJK_CLASS}', ' \\0 ', 'g') AS text FROM lines1""")
def x2_pad_cjk(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", X.pad_cjk(F.col("text")).alias("text"))


@query("x3_strip_accents", f"WITH {LINES_SQL}\nSELECT doc_id, line_no, strip_accents(text) AS text FROM lines1")
def x3_strip_accents(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", X.strip_accents(F.col("text")).alias("text"))


@query("x4_normalise_text", f"WITH {LINES_SQL},\n{TAG_SQL},\n{NORM_SQL}\nSELECT split, doc_id, line_no, text FROM norm")
def x4_normalise_text(spark, sf_dir):
    """X1 -> X2 -> X3 on the non-blank lines of both splits."""
    return _norm(spark, sf_dir)


@query("x5_element_name", f"""
SELECT p_partkey, concat(upper(substr(t, 1, 1)), lower(substr(t, 2))) AS name
FROM (SELECT p_partkey, replace(regexp_replace(p_type || '% ', '^{X.PY_SPACE_CLASS}+|{X.PY_SPACE_CLASS}+$', '', 'g'), '%', '') AS t
      FROM part)""")
def x5_element_name(spark, sf_dir):
    """X5 on every part type (with a trailing '% ' to exercise strip and
    '%' removal): first letter upper, rest lower."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", X.element_name(F.concat(F.col("p_type"), F.lit("% "))).alias("name"))


@query("a19_vocabulary", f"WITH {LINES_SQL},\n{TAG_SQL},\n{NORM_SQL},\n{TOK_SQL}\nSELECT token, id, count FROM vocab")
def a19_vocabulary(spark, sf_dir):
    return _vocab(spark, sf_dir)


@query("t1_encode_tokens", f"""WITH {LINES_SQL},\n{TAG_SQL},\n{NORM_SQL},\n{TOK_SQL},
enc AS (SELECT split, doc_id, line_no, list(id ORDER BY pos) AS ids FROM ids GROUP BY 1, 2, 3)
SELECT n.split, n.doc_id, n.line_no, array_to_string(coalesce(e.ids, []) || [{K.SEP_ID}], ' ') AS ids
FROM norm n LEFT JOIN enc e ON n.split = e.split AND n.doc_id = e.doc_id AND n.line_no = e.line_no""")
def t1_encode_tokens(spark, sf_dir):
    """Ids per line with the trailing SEP."""
    n = cut_lineage(_norm(spark, sf_dir))
    enc = K.encode_tokens(n, K.vocabulary(n.where(F.col("split") == "train")))
    return enc.select("split", "doc_id", "line_no", F.array_join("ids", " ").alias("ids"))


@query("t3_coverage", f"""WITH {LINES_SQL},\n{TAG_SQL},\n{NORM_SQL},\n{TOK_SQL}
SELECT split, count(*) AS n_tokens, count_if(id = {K.UNK_ID}) AS n_unknown,
       round(1 - count_if(id = {K.UNK_ID}) / count(*), 6) + 0.0 AS known_share FROM ids GROUP BY split""")
def t3_coverage(spark, sf_dir):
    """Share of known tokens per split (the validation split has words
    never seen in training)."""
    enc, _ = _encoded(spark, sf_dir)
    c = K.coverage(enc)
    return c.select("split", "n_tokens", "n_unknown", (F.round("known_share", 6) + F.lit(0.0)).alias("known_share"))


W = K.MAX_SEQ_LEN - 2

PACK_SQL = f"""sl AS (SELECT n.split, n.doc_id, n.line_no, count(i.pos) AS r
       FROM norm n LEFT JOIN ids i ON n.split = i.split AND n.doc_id = i.doc_id AND n.line_no = i.line_no
       GROUP BY 1, 2, 3),
s AS (SELECT split, doc_id, line_no, r, row_number() OVER (PARTITION BY split ORDER BY doc_id, line_no) AS k
      FROM sl WHERE r > 0),
scan(split, k, e) AS (
  SELECT DISTINCT split, CAST(1 AS BIGINT), CAST(0 AS BIGINT) FROM s
  UNION ALL
  SELECT s.split, scan.k + 1, scan.e + s.r + CASE WHEN (scan.e + s.r) % {W} <> 0 THEN 1 ELSE 0 END
  FROM scan JOIN s ON s.split = scan.split AND s.k = scan.k),
st AS (SELECT s.split, s.doc_id, s.line_no, s.r, scan.e FROM s JOIN scan ON s.split = scan.split AND s.k = scan.k),
items AS (
  SELECT i.split, (st.e + i.pos) // {W} AS block_no, 1 + (st.e + i.pos) % {W} AS slot, i.id
  FROM ids i JOIN st ON i.split = st.split AND i.doc_id = st.doc_id AND i.line_no = st.line_no
  UNION ALL
  SELECT split, CASE WHEN (e + r) % {W} <> 0 THEN (e + r) // {W} ELSE (e + r) // {W} - 1 END,
         CASE WHEN (e + r) % {W} <> 0 THEN 1 + (e + r) % {W} ELSE {W + 1} END, {K.SEP_ID} FROM st),
blk AS (SELECT split, block_no, list(id ORDER BY slot) AS body, max(slot) AS ms FROM items GROUP BY 1, 2),
lst AS (SELECT split, max(block_no) AS last FROM blk GROUP BY 1),
packed AS (SELECT b.split, CAST(b.block_no AS BIGINT) AS block_no,
    [{K.CLS_ID}] || body || CASE WHEN b.block_no < l.last AND ms < {W + 1} THEN [{K.SEP_ID}] ELSE [] END AS ids
  FROM blk b JOIN lst l ON b.split = l.split),
padded AS (SELECT split, block_no, len(ids) AS n_ids, ids || list_transform(range({K.MAX_SEQ_LEN} - len(ids)), lambda x: 0) AS input_ids
  FROM packed)"""


def _packed(spark, sf_dir):
    enc, n_ids = _encoded(spark, sf_dir)
    return K.pack_sequences(cut_lineage(enc)), n_ids


@query("t4_pack_sequences", f"""WITH RECURSIVE {LINES_SQL},\n{TAG_SQL},\n{NORM_SQL},\n{TOK_SQL},\n{PACK_SQL}
SELECT split, block_no, n_ids, array_to_string(input_ids, ' ') AS input_ids FROM padded""")
def t4_pack_sequences(spark, sf_dir):
    """T4 + X21: 512-id blocks per split (ids padded with PAD; n_ids = the
    attention-mask length)."""
    b, _ = _packed(spark, sf_dir)
    return b.select("split", "block_no", F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
                    .cast("bigint").alias("n_ids"), F.array_join("input_ids", " ").alias("input_ids"))


def _mask_sql():
    def u(tag):
        return sql_uniform(f"mlm-{tag}", "split", "block_no", "i - 1")
    chosen = f"(x NOT IN ({K.PAD_ID}, {K.CLS_ID}, {K.SEP_ID}) AND {u('p')} < 0.15)"
    masked = (f"list_transform(input_ids, lambda x, i: CASE WHEN {chosen} THEN "
              f"(CASE WHEN {u('k')} < 0.8 THEN {K.MASK_ID} WHEN {u('k')} < 0.9 "
              f"THEN CAST(floor({u('r')} * n_vocab) AS INTEGER) ELSE x END) ELSE x END)")
    labels = f"list_transform(input_ids, lambda x, i: CASE WHEN {chosen} THEN x ELSE -100 END)"
    return f"""WITH RECURSIVE {LINES_SQL},\n{TAG_SQL},\n{NORM_SQL},\n{TOK_SQL},\n{PACK_SQL}
SELECT split, block_no, array_to_string({masked}, ' ') AS masked_ids, array_to_string({labels}, ' ') AS labels
FROM padded CROSS JOIN (SELECT count(*) + {K.N_SPECIAL} AS n_vocab FROM vocab)"""


@query("t5_mlm_mask", _mask_sql())
def t5_mlm_mask(spark, sf_dir):
    """T5: 15 % of the non-special tokens chosen; 80/10/10 mask/random/keep."""
    m = K.mlm_mask(*_packed(spark, sf_dir))
    return m.select("split", "block_no", F.array_join("masked_ids", " ").alias("masked_ids"),
                    F.array_join("labels", " ").alias("labels"))

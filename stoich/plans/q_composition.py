"""Composition queries: P1, P2, F1-F3, F7, J1, J2, A1-A4, X6, X7, U2."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stoich.operators import composition as C
from stoich.operators.ordering import global_rank
from stoich.plans.catalog import query, with_ctes
from stoich.sources import fixtures as FX
from stoich.sources.tables import table

# The label lists used by the composition queries.
ALL_BRANDS = [f"Brand#{i}" for i in range(1, 26)]
LABELS_11 = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5", "Brand#6",
             "Brand#7", "Brand#8", "Brand#9", "Brand#10", "Brand#11"]
# label list with one label named twice (the duplicate-column case of P1)
LABELS_DUP = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5", "Brand#3"]
UNWANTED = ["Brand#13", "Brand#24"]
ALLOWED = [f"Brand#{i}" for i in range(1, 21)]
BOUNDS = {"Brand#1": (0.0, 0.5), "Brand#2": (0.0, 0.4), "Brand#3": (0.0, 0.9),
          "Brand#4": (0.05, 1.0)}

SHARES_SQL = """shares AS (
  SELECT sample_id, element, amount / sum(amount) OVER (PARTITION BY sample_id) AS share
  FROM composition)"""


def _shares(spark, sf_dir):
    return C.normalise_rows(FX.composition(spark, sf_dir))


def _r6(c):
    return F.round(c, 6) + F.lit(0.0)


# nine places, rounded by the same double arithmetic in both engines
NINE = f"floor(({C.sql_fixed_point_sum('s.share * f.value')}) * 1e9::DOUBLE + 0.5) / 1e9::DOUBLE"


def nine(x):
    return F.floor(x * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)


def nine_of(x: np.ndarray) -> np.ndarray:
    """:func:`nine` on an array."""
    return np.floor(x * 1e9 + 0.5) / 1e9


def weighted_matrix(spark, sf_dir):
    """The weighted features of j1_weighted_features, not yet computed."""
    return C.WeightedMatrix.of(_shares(spark, sf_dir), FX.embedding_features(spark, sf_dir))


@query("j1_weighted_features", with_ctes(FX.C1_SQL, FX.C2_SQL, SHARES_SQL) + f"""
SELECT s.sample_id, f.feature_id, {NINE} AS value
FROM shares s JOIN efeat f ON s.element = f.element
GROUP BY s.sample_id, f.feature_id""")
def j1_weighted_features(spark, sf_dir):
    wf = C.weighted_features(_shares(spark, sf_dir), FX.embedding_features(spark, sf_dir), exact_sum=True)
    return wf.select("sample_id", "feature_id", nine(F.col("value")).alias("value"))


@query("j1_weighted_features_by_kind", with_ctes(FX.C1_SQL, FX.C2_SQL, FX.C3_SQL, SHARES_SQL) + f""",
feats AS (SELECT 'empirical' AS kind, * FROM pfeat UNION ALL SELECT 'embedding', * FROM efeat)
SELECT s.sample_id, f.kind, f.feature_id,
       {NINE} AS value
FROM shares s JOIN feats f ON s.element = f.element
GROUP BY s.sample_id, f.kind, f.feature_id""")
def j1_weighted_features_by_kind(spark, sf_dir):
    """S7 + J1: every feature kind in one job (no loop over kinds)."""
    wf = C.weighted_features(_shares(spark, sf_dir), FX.all_features(spark, sf_dir), by_kind=True,
                             exact_sum=True)
    return wf.select("sample_id", "kind", "feature_id", nine(F.col("value")).alias("value"))


@query("j2_select_features", with_ctes(FX.C1_SQL, FX.C2_SQL, SHARES_SQL) + """,
wf AS (SELECT s.sample_id, f.feature_id, sum(s.share * f.value) AS value
       FROM shares s JOIN efeat f ON s.element = f.element GROUP BY 1, 2),
sel AS (SELECT * FROM (VALUES (0, 17::BIGINT), (1, 3::BIGINT), (2, 42::BIGINT), (3, 0::BIGINT)) t(pos, feature_id))
SELECT wf.sample_id, CAST(sel.pos AS BIGINT) AS pos, wf.feature_id, round(wf.value, 6) + 0.0 AS value
FROM wf JOIN sel ON wf.feature_id = sel.feature_id""")
def j2_select_features(spark, sf_dir):
    """J2 on the array form: chosen indices in chosen order."""
    weighted = weighted_matrix(spark, sf_dir)
    arr = weighted.arrays() if weighted is not None else C.feature_array(
        C.weighted_features(_shares(spark, sf_dir), FX.embedding_features(spark, sf_dir)))
    idx = [17, 3, 42, 0]
    sel = C.select_features(arr, idx)
    return sel.select("sample_id", F.posexplode("selected").alias("pos", "value")).select(
        "sample_id", F.col("pos").cast("bigint").alias("pos"),
        F.element_at(F.array(*[F.lit(i) for i in idx]).cast("array<bigint>"),
                     F.col("pos") + 1).alias("feature_id"),
        _r6(F.col("value")).alias("value"))


@query("p2_normalise_rows", with_ctes(FX.C1_SQL, SHARES_SQL) + """
SELECT sample_id, element, round_even(share, 8) + 0.0 AS share FROM shares""")
def p2_normalise_rows(spark, sf_dir):
    s = C.normalise_rows(FX.composition(spark, sf_dir), places=8)
    return s.select("sample_id", "element", (F.col("share") + F.lit(0.0)).alias("share"))


def _p1_sql(labels, keep_dup):
    seen, cols = {}, []
    for lab in labels:
        seen[lab] = seen.get(lab, 0) + 1
        if seen[lab] > 1 and not keep_dup:
            continue
        name = C.safe_name(lab) + (f"__{seen[lab]}" if seen[lab] > 1 else "")
        cols.append(f"coalesce(sum(CASE WHEN element = '{lab}' THEN amount END), 0.0) AS {name}")
    return with_ctes(FX.C1_SQL) + "SELECT sample_id, " + ", ".join(cols) + \
        " FROM composition GROUP BY sample_id"


@query("p1_select_labels", _p1_sql(LABELS_DUP, True))
def p1_select_labels(spark, sf_dir):
    return C.select_labels(FX.composition(spark, sf_dir), LABELS_DUP, keep_duplicates=True)


@query("p1_select_labels_dedup", _p1_sql(LABELS_DUP, False))
def p1_select_labels_dedup(spark, sf_dir):
    return C.select_labels(FX.composition(spark, sf_dir), LABELS_DUP, keep_duplicates=False)


def _inlist(xs):
    return ", ".join(f"'{x}'" for x in xs)


_C1_ONCE = FX.C1_SQL.replace("composition AS (", "composition AS MATERIALIZED (", 1)


@query("f1_reject_unwanted", with_ctes(_C1_ONCE, f"""bad AS MATERIALIZED (
  SELECT DISTINCT sample_id FROM composition
  WHERE element IN ({_inlist(UNWANTED)}) AND (amount IS NULL OR amount <> 0))""") + """
SELECT sample_id, element, amount FROM composition ANTI JOIN bad USING (sample_id)""")
def f1_reject_unwanted(spark, sf_dir):
    return C.reject_unwanted(FX.composition(spark, sf_dir), UNWANTED).select("sample_id", "element", "amount")


@query("f2_reject_other_columns", with_ctes(FX.C1_SQL, f"""marked AS (
  SELECT *, bool_or(element NOT IN ({_inlist(ALLOWED)}) AND (amount IS NULL OR amount <> 0))
            OVER (PARTITION BY sample_id) AS bad FROM composition)""") + f"""
SELECT sample_id, element, amount FROM marked WHERE NOT bad AND element IN ({_inlist(ALLOWED)})""")
def f2_reject_other_columns(spark, sf_dir):
    return C.reject_other_columns(FX.composition(spark, sf_dir), ALLOWED).select("sample_id", "element", "amount")


@query("f3_sum_window", with_ctes(FX.C1_SQL, FX.C1P_SQL) + """,
t AS (SELECT *, round_even(sum(amount) OVER (PARTITION BY sample_id), 4) AS s FROM pcomposition)
SELECT sample_id, element, amount FROM t
WHERE (s BETWEEN 99.9 AND 100.1) OR (s > 0.998 AND s <= 1.02)""")
def f3_sum_window(spark, sf_dir):
    return C.sum_window(FX.percent_composition(spark, sf_dir)).select("sample_id", "element", "amount")


def _f7_sql():
    conds = " OR ".join(f"(element = '{e}' AND (share < {lo} OR share > {hi}))" for e, (lo, hi) in BOUNDS.items())
    zero_bad = [e for e, (lo, hi) in BOUNDS.items() if not (lo <= 0 <= hi)]
    zb = f"count_if(element IN ({_inlist(zero_bad)}))" if zero_bad else "0"
    return with_ctes(FX.C1_SQL, SHARES_SQL) + f"""
SELECT sample_id, (count_if({conds}) = 0) AND ({zb} = {len(zero_bad)}) AS in_bounds
FROM shares GROUP BY sample_id"""


@query("f7_within_bounds", _f7_sql())
def f7_within_bounds(spark, sf_dir):
    return C.within_bounds(_shares(spark, sf_dir), BOUNDS)


@query("a1_nonzero_counts", with_ctes(FX.C1_SQL) + """
SELECT element, count_if(amount <> 0) AS n_nonzero FROM composition GROUP BY element
HAVING count_if(amount <> 0) > 0""")
def a1_nonzero_counts(spark, sf_dir):
    return C.nonzero_counts(FX.composition(spark, sf_dir))


def _sig_sql(labels):
    parts = ", ".join(
        f"printf('%.8f', coalesce(max(CASE WHEN element = '{lab}' THEN round_even(share, 8) END), 0.0) + 0.0)"
        for lab in labels)
    return f"""sig AS (SELECT sample_id, concat_ws('|', {parts}) AS signature
  FROM shares WHERE element IN ({_inlist(labels)}) GROUP BY sample_id)"""


def _sig(spark, sf_dir):
    return C.signature(_shares(spark, sf_dir), ALL_BRANDS)


@query("x7_signature", with_ctes(FX.C1_SQL, SHARES_SQL, _sig_sql(ALL_BRANDS)) + "SELECT sample_id, signature FROM sig")
def x7_signature(spark, sf_dir):
    return _sig(spark, sf_dir)


@query("a2_composition_groups", with_ctes(FX.C1_SQL, SHARES_SQL, _sig_sql(ALL_BRANDS)) + """,
g AS (SELECT signature, min(sample_id) AS first_id FROM sig GROUP BY 1),
r AS (SELECT signature, row_number() OVER (ORDER BY first_id) - 1 AS group_id FROM g)
SELECT s.sample_id, CAST(r.group_id AS BIGINT) AS group_id FROM sig s JOIN r ON s.signature = r.signature""")
def a2_composition_groups(spark, sf_dir):
    """A2: dense group id in first-seen order, via an exact distributed rank
    of the (small) group table - never a global single-task window."""
    sig = _sig(spark, sf_dir)
    groups = sig.groupBy("signature").agg(F.min("sample_id").alias("first_id"))
    ranked = global_rank(groups, [F.col("first_id")], out="group_id")
    return sig.join(ranked.select("signature", "group_id"), "signature").select("sample_id", "group_id")


@query("a3_duplicate_stats", with_ctes(FX.C1_SQL, SHARES_SQL, _sig_sql(ALL_BRANDS)) + """,
g AS (SELECT signature, count(*) AS n FROM sig GROUP BY 1),
top AS (SELECT n FROM g ORDER BY n DESC LIMIT 5),
toprank AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS k FROM top)
SELECT 'n_groups' AS stat, count(*) AS value FROM g
UNION ALL SELECT 'n_dup_groups', count_if(n > 1) FROM g
UNION ALL SELECT 'surplus_rows', CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) FROM g
UNION ALL SELECT 'top_' || CAST(k AS VARCHAR), n FROM toprank""")
def a3_duplicate_stats(spark, sf_dir):
    """A3: groups with count > 1, surplus rows, and the 5 largest counts."""
    g = _sig(spark, sf_dir).groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    stats = g.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n") > 1).alias("n_dup_groups"),
                  F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).cast("bigint").alias("surplus_rows"))
    long = stats.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("stat"), F.col(c).cast("bigint").alias("value"))
        for c in ["n_groups", "n_dup_groups", "surplus_rows"]])).alias("s")).select("s.*")
    top = g.orderBy(F.col("n").desc()).limit(5)
    top = top.agg(F.sort_array(F.collect_list("n"), asc=False).alias("ns")).select(
        F.posexplode("ns").alias("k", "value")).select(
        F.concat(F.lit("top_"), (F.col("k") + 1).cast("string")).alias("stat"), F.col("value").cast("bigint"))
    return long.unionByName(top)


@query("a4_dedup_mean", with_ctes(FX.C1_SQL, SHARES_SQL, _sig_sql(ALL_BRANDS), FX.C4_SQL) + """
SELECT s.signature, count(*) AS n, round(avg(t.y), 6) + 0.0 AS y_mean
FROM sig s JOIN targets t ON s.sample_id = t.sample_id GROUP BY s.signature""")
def a4_dedup_mean(spark, sf_dir):
    """A4: mean target per composition signature (partial aggregation keeps a
    hot signature cheap)."""
    sig = _sig(spark, sf_dir)
    t = FX.targets(spark, sf_dir).select("sample_id", "y")
    return sig.join(t, "sample_id").groupBy("signature").agg(
        F.count(F.lit(1)).alias("n"), _r6(F.avg("y")).alias("y_mean"))


@query("a4_dedup_mean_shares", with_ctes(FX.C1_SQL, SHARES_SQL, _sig_sql(ALL_BRANDS)) + """,
n AS (SELECT signature, count(*) AS n FROM sig GROUP BY 1)
SELECT s.signature, sh.element, round(sum(sh.share) / max(n.n), 6) + 0.0 AS share_mean
FROM sig s JOIN shares sh ON s.sample_id = sh.sample_id JOIN n ON s.signature = n.signature
GROUP BY s.signature, sh.element""")
def a4_dedup_mean_shares(spark, sf_dir):
    """A4: mean composition per signature (absent element counts as 0)."""
    sig = _sig(spark, sf_dir)
    n = sig.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    sh = _shares(spark, sf_dir)
    return (sig.join(sh, "sample_id").groupBy("signature", "element").agg(F.sum("share").alias("s"))
            .join(n, "signature")
            .select("signature", "element", _r6(F.col("s") / F.col("n")).alias("share_mean")))


def _x6_sql():
    vals = ", ".join(f"printf('%.4f', round_even(coalesce(sum(CASE WHEN element = '{lab}' THEN share END), 0.0), 4) + 0.0)"
                     for lab in LABELS_11)
    return with_ctes(FX.C1_SQL, SHARES_SQL) + f""",
k AS (SELECT sample_id, concat_ws('*', {vals}) AS comp_key FROM shares GROUP BY sample_id)
SELECT sample_id, comp_key,
       round(list_sum(list_transform(string_split(comp_key, '*'), lambda x: CAST(x AS DOUBLE))), 4) + 0.0 AS decoded_sum
FROM k"""


@query("x6_composition_key", _x6_sql())
def x6_composition_key(spark, sf_dir):
    wide = C.select_labels(_shares(spark, sf_dir), LABELS_11, value="share")
    arr = F.array(*[F.col(C.safe_name(lab)) for lab in LABELS_11])
    k = wide.select("sample_id", C.composition_key(arr).alias("comp_key"))
    dec = C.decode_key(F.col("comp_key"))
    return k.select("sample_id", "comp_key",
                    (F.round(F.aggregate(dec, F.lit(0.0), lambda a, x: a + x), 4) + F.lit(0.0)).alias("decoded_sum"))


@query("u2_distinct_compositions", with_ctes(FX.C1_SQL, SHARES_SQL, _sig_sql(ALL_BRANDS)) + """
SELECT signature, min(sample_id) AS first_id, count(*) AS n FROM sig GROUP BY signature""")
def u2_distinct_compositions(spark, sf_dir):
    """Distinct compositions by rounded key, first-seen id kept."""
    return _sig(spark, sf_dir).groupBy("signature").agg(
        F.min("sample_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


# -- loaders' filters on the process / target table (F4-F6) -----------------

PROC_SQL = """proc AS (SELECT sample_id, y, proc_1, proc_2, CAST(floor(y) % 3 AS BIGINT) AS proc_3 FROM targets)"""


def _proc(spark, sf_dir):
    return FX.targets(spark, sf_dir).withColumn("proc_3", (F.floor("y") % 3).cast("bigint"))


@query("f4_drop_zero_process", with_ctes(FX.C4_SQL, PROC_SQL) + """
SELECT sample_id FROM proc WHERE NOT (proc_2 = 0 AND proc_3 = 0)""")
def f4_drop_zero_process(spark, sf_dir):
    """drop rows whose process values (after the first) are all zero."""
    p = _proc(spark, sf_dir)
    return p.where(~((F.col("proc_2") == 0) & (F.col("proc_3") == 0))).select("sample_id")


@query("f5_standard_process", with_ctes(FX.C4_SQL, PROC_SQL) + """
SELECT sample_id FROM proc WHERE proc_1 = 'O' AND proc_2 = 3 AND proc_3 = 1""")
def f5_standard_process(spark, sf_dir):
    """the standard process only (three equality tests)."""
    p = _proc(spark, sf_dir)
    return p.where((F.col("proc_1") == "O") & (F.col("proc_2") == 3) & (F.col("proc_3") == 1)).select("sample_id")


@query("f6_modal_process", with_ctes(FX.C4_SQL, PROC_SQL) + """,
c AS (SELECT proc_1, proc_2, count(*) AS n, min(sample_id) AS first_id FROM proc GROUP BY 1, 2),
m AS (SELECT proc_1, proc_2 FROM c ORDER BY n DESC, first_id LIMIT 1)
SELECT p.sample_id, p.proc_1, p.proc_2 FROM proc p JOIN m ON p.proc_1 = m.proc_1 AND p.proc_2 = m.proc_2""")
def f6_modal_process(spark, sf_dir):
    """keep the rows with the most common condition vector (ties: the
    vector seen first).  Counting is a partial aggregate; the modal vector
    is one row, joined back by broadcast."""
    p = _proc(spark, sf_dir)
    c = p.groupBy("proc_1", "proc_2").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first_id"))
    m = c.orderBy(F.col("n").desc(), F.col("first_id")).limit(1).select("proc_1", "proc_2")
    return p.join(F.broadcast(m), ["proc_1", "proc_2"], "left_semi").select("sample_id", "proc_1", "proc_2")


@query("s6_element_features", with_ctes(FX.C2_SQL) + """,
l AS (SELECT element, list(value ORDER BY feature_id) AS v FROM efeat GROUP BY element)
SELECT element, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS pos, unnest(v) AS value FROM l""")
def s6_element_features(spark, sf_dir):
    """Per element, its features as an array in feature order (one
    bounded list per element), exploded back with positions."""
    arr = C.feature_array(FX.embedding_features(spark, sf_dir), key="element")
    return arr.select("element", F.posexplode("features").alias("pos", "value")).select(
        "element", F.col("pos").cast("bigint").alias("pos"), "value")


def _messy_wide(spark, sf_dir):
    """A wide composition table with the headers an external sheet might
    have (spaces, case, '%'), one label (Brand#11) absent."""
    w = C.select_labels(FX.composition(spark, sf_dir), LABELS_11[:10])
    return w.select("sample_id", *[F.col(C.safe_name(lab)).alias(f" {lab.lower()}%") for lab in LABELS_11[:10]])


def _s8_sql():
    tot = " + ".join(f"coalesce(sum(CASE WHEN element = '{lab}' THEN amount END), 0.0)" for lab in LABELS_11[:10])
    parts = ", ".join(
        f"printf('%.4f', round_even(coalesce(sum(CASE WHEN element = '{lab}' THEN amount END), 0.0) / ({tot}), 4) + 0.0)"
        for lab in LABELS_11[:10])
    return with_ctes(FX.C1_SQL) + f"""
SELECT sample_id AS row_id, concat_ws('*', {parts}, '0.0000') AS comp_key FROM composition GROUP BY sample_id
HAVING {tot} > 0"""


@query("s8_external_compositions", _s8_sql())
def s8_external_compositions(spark, sf_dir):
    """Messy headers normalised (X5), an absent element filled with 0,
    rows normalised to sum 1, zero-sum rows dropped."""
    from stoich.sources import io as IO
    e = IO.external_compositions(_messy_wide(spark, sf_dir), LABELS_11, id_col="sample_id")
    return e.select("row_id", C.composition_key(F.col("comp"), 4).alias("comp_key"))


@query("x10_half_even_round", f"""
SELECT l_orderkey, l_linenumber, l_partkey,
  {'{}'.format('(round_even((l_extendedprice * l_discount) * 10000.0, 0) / 10000.0)')} + 0.0 AS r4,
  (round_even((l_extendedprice * l_discount) * 1000.0, 0) / 1000.0) + 0.0 AS r3,
  (round_even((l_quantity / 7.0) * 100000000.0, 0) / 100000000.0) + 0.0 AS r8
FROM lineitem""")
def x10_half_even_round(spark, sf_dir):
    """Half-even rounding of the binary value to 4, 3 and 8 places
    (the semantics of Python's round; ties like 0.0005 are exact here)."""
    from stoich.functions.numeric import round_bin
    li = table(spark, sf_dir, "lineitem")
    v = F.col("l_extendedprice") * F.col("l_discount")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", (round_bin(v, 4) + F.lit(0.0)).alias("r4"),
                     (round_bin(v, 3) + F.lit(0.0)).alias("r3"),
                     (round_bin(F.col("l_quantity") / 7.0, 8) + F.lit(0.0)).alias("r8"))

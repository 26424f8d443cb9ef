"""Candidate-search queries: X11, X13, X14, X17-X20, J7, G6, G7, U1, F8,
M20, L4, M22."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stoich.functions.numeric import round_bin, sql_round_bin
from stoich.functions.rng import sql_uniform, uniform
from stoich.operators import candidates as CA
from stoich.operators import composition as C
from stoich.operators import sampling as S
from stoich.operators import search as SE
from stoich.operators.gp import gp_score
from stoich.plans.catalog import query, with_ctes
from stoich.session import cut_lineage
from stoich.sources import fixtures as FX
from stoich.sources.tables import table

# The six elements of the candidate space and their bounds.
ELEMS6 = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5", "Brand#6"]
LO6 = [0.20, 0.20, 0.0, 0.0, 0.0, 0.0]
HI6 = [0.55, 0.55, 0.20, 0.20, 0.10, 0.20]
# Element constraints for the bounds table (one reversed, one
# outside [0, 1]).
CONSTRAINTS = [("Brand#1", 0.20, 0.55), ("Brand#2", 0.20, 0.55), ("Brand#3", 0.0, 0.20),
               ("Brand#7", 0.30, 0.10), ("Brand#8", -0.20, 1.50)]
W_TARGET = [0.9, -0.4, 1.3, 0.2, -1.1, 0.6]   # linear stand-in target over a composition


def _r6(c):
    return F.round(c, 6) + F.lit(0.0)


def _comp6(spark, sf_dir):
    """(sample_id, comp array<double>[6]): the six brands' shares of each
    order, renormalised over those six (orders holding none are dropped)."""
    wide = C.select_labels(FX.composition(spark, sf_dir), ELEMS6)
    cols = [F.col(C.safe_name(e)) for e in ELEMS6]
    tot = sum(cols[1:], cols[0])
    return wide.where(tot > 0).select("sample_id", F.array(*[c / tot for c in cols]).alias("comp"))


COMP6_SQL = with_ctes(FX.C1_SQL) + """,
w6 AS (SELECT sample_id, """ + ", ".join(
    f"coalesce(sum(CASE WHEN element = '{e}' THEN amount END), 0.0) AS e{i}" for i, e in enumerate(ELEMS6)) + """
  FROM composition GROUP BY sample_id),
comp6 AS (SELECT sample_id, [""" + ", ".join(f"e{i} / (e0 + e1 + e2 + e3 + e4 + e5)" for i in range(6)) + """] AS comp
  FROM w6 WHERE e0 + e1 + e2 + e3 + e4 + e5 > 0)"""


def _key(arr):
    return C.composition_key(arr, 4)


def _sql_key(arr):
    return f"array_to_string(list_transform({arr}, lambda v: printf('%.4f', round_even(v, 4) + 0.0)), '*')"


@query("x11_multi_objective", f"""
SELECT l_orderkey, l_linenumber, l_partkey,
  round((l_quantity / 35.0 + (50.0 - abs(l_extendedprice / 100 - l_extendedprice * l_discount)) / 50.0
        + (50.0 - abs(300.0 - (l_extendedprice * l_discount + l_extendedprice / 100) / 2)) / 50.0) / 3.0, 6) + 0.0 AS score
FROM lineitem""")
def x11_multi_objective(spark, sf_dir):
    """X11 with en = quantity, ap = price / 100, mp = price x discount."""
    li = table(spark, sf_dir, "lineitem")
    s = CA.multi_objective(F.col("l_quantity"), F.col("l_extendedprice") / 100,
                           F.col("l_extendedprice") * F.col("l_discount"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", _r6(s).alias("score"))


EI_SQL = """ei_in AS (SELECT o_orderkey, o_orderstatus, o_totalprice / 1e5 AS mean, (o_custkey % 7) / 10.0 AS std FROM orders),
ymax AS (SELECT max(mean) AS y_max FROM ei_in WHERE o_orderstatus = 'F'),
ei_t AS (SELECT o_orderkey, mean, std, mean - y_max AS a, (mean - y_max) / std AS z FROM ei_in, ymax
         WHERE o_orderstatus <> 'F'),
erf_t AS (SELECT *, 1.0 / (1.0 + 0.3275911 * abs(z / sqrt(2.0))) AS t FROM ei_t),
erf_v AS (SELECT *, sign(z) * (1.0 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027
          + t * 1.061405429)))) * exp(-(z / sqrt(2.0)) * (z / sqrt(2.0)))) AS e FROM erf_t)"""


def _ei_input(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") / 1e5).alias("mean"),
                                              ((F.col("o_custkey") % 7) / 10.0).alias("std"))
    ymax = o.where(F.col("o_orderstatus") == "F").agg(F.max("mean").alias("y_max")).withColumn("_k", F.lit(1))
    return o.where(F.col("o_orderstatus") != "F").withColumn("_k", F.lit(1)).join(F.broadcast(ymax), "_k").drop("_k")


@query("x13_expected_improvement", f"""WITH {EI_SQL}
SELECT o_orderkey, round(CASE WHEN std > 1e-6 THEN a * 0.5 * (1.0 + CASE WHEN z >= 0 THEN abs(e) ELSE -abs(e) END)
  + std * exp(-0.5 * z * z) / sqrt(2 * pi()) ELSE 0.0 END, 6) + 0.0 AS ei FROM erf_v""")
def x13_expected_improvement(spark, sf_dir):
    """EI of open orders against the best filled one (std 0 -> 0)."""
    d = _ei_input(spark, sf_dir)
    return d.select("o_orderkey", _r6(CA.expected_improvement(F.col("mean"), F.col("std"), F.col("y_max"))).alias("ei"))


@query("x14_ucb", f"""
SELECT o_orderkey, {sql_round_bin('o_totalprice / 1e5 + 1.92 * ((o_custkey % 7) / 10.0)', 6)} + 0.0 AS ucb FROM orders""")
def x14_ucb(spark, sf_dir):
    """Mean + 1.92 std (values with exact 7-digit decimal ties, so the
    output rounding is done on the binary value in both engines)."""
    o = table(spark, sf_dir, "orders")
    u = CA.ucb(F.col("o_totalprice") / 1e5, (F.col("o_custkey") % 7) / 10.0)
    return o.select("o_orderkey", (round_bin(u, 6) + F.lit(0.0)).alias("ucb"))


def _lit_list(xs):
    """A DOUBLE list literal (a bare [0.1, ...] literal is DECIMAL in DuckDB)."""
    return "CAST([" + ", ".join(repr(float(x)) for x in xs) + "] AS DOUBLE[])"


def _sql_opts():
    return (f"list_transform(comp, lambda c, i: list_sort(list_distinct(["
            f"least(greatest(floor(c / 0.001) * 0.001, {_lit_list(LO6)}[i]), {_lit_list(HI6)}[i]), "
            f"least(greatest(ceil(c / 0.001) * 0.001, {_lit_list(LO6)}[i]), {_lit_list(HI6)}[i])])))")


@query("x17_grid_options", COMP6_SQL + f"""
SELECT sample_id, array_to_string(list_transform({_sql_opts()},
    lambda o: array_to_string(list_transform(o, lambda v: printf('%.4f', round_even(v, 4) + 0.0)), '/')), ' ') AS options
FROM comp6""")
def x17_grid_options(spark, sf_dir):
    """floor/ceil 0.001-grid neighbours of each share, clipped."""
    c = _comp6(spark, sf_dir)
    o = CA.grid_options(F.col("comp"), LO6, HI6)
    return c.select("sample_id", F.array_join(F.transform(o, lambda a: F.array_join(
        F.transform(a, lambda v: F.format_string("%.4f", F.bround(v, 4) + F.lit(0.0))), "/")), " ").alias("options"))


@query("j7_snap_neighbours", COMP6_SQL + f""",
o AS (SELECT sample_id, {_sql_opts()} AS opts FROM comp6),
x AS (SELECT o.sample_id, [a1, a2, a3, a4, a5, a6] AS c FROM o,
      LATERAL (SELECT unnest(o.opts[1]) AS a1) t1, LATERAL (SELECT unnest(o.opts[2]) AS a2) t2,
      LATERAL (SELECT unnest(o.opts[3]) AS a3) t3, LATERAL (SELECT unnest(o.opts[4]) AS a4) t4,
      LATERAL (SELECT unnest(o.opts[5]) AS a5) t5, LATERAL (SELECT unnest(o.opts[6]) AS a6) t6)
SELECT sample_id, {_sql_key('c')} AS comp_key FROM x
WHERE abs(list_reduce(c, lambda a, b: a + b) - 1.0) < 1e-6""")
def j7_snap_neighbours(spark, sf_dir):
    """Grid neighbour combinations summing to 1 (<= 64 per order)."""
    c = _comp6(spark, sf_dir)
    s = c.select("sample_id", F.explode(CA.snap_neighbours(F.col("comp"), LO6, HI6)).alias("c"))
    return s.select("sample_id", _key(F.col("c")).alias("comp_key"))


def _constraints(spark):
    return spark.createDataFrame(CONSTRAINTS, "element string, lo double, hi double")


@query("x18_bounds_table", """
WITH c AS (SELECT * FROM (VALUES """ + ", ".join(f"('{e}', {lo}, {hi})" for e, lo, hi in CONSTRAINTS) + """) t(element, lo, hi)),
l AS (SELECT DISTINCT p_brand AS element FROM part),
b AS (SELECT l.element, least(greatest(coalesce(CAST(c.lo AS DOUBLE), 0.0), 0.0), 1.0) AS lo,
             least(greatest(coalesce(CAST(c.hi AS DOUBLE), 1.0), 0.0), 1.0) AS hi FROM l LEFT JOIN c ON l.element = c.element)
SELECT element, least(lo, hi) AS lo, greatest(lo, hi) AS hi FROM b""")
def x18_bounds_table(spark, sf_dir):
    """Bounds for every element present in ``part``."""
    labels = table(spark, sf_dir, "part").select(F.col("p_brand").alias("element")).distinct()
    return CA.bounds_table(labels, _constraints(spark))


def _perturbed(spark, sf_dir):
    c = _comp6(spark, sf_dir)
    return c.select("sample_id", F.transform("comp", lambda v, i: v + F.lit(0.05) * (
        uniform("perturb", F.col("sample_id"), i) - F.lit(0.5))).alias("x"))


def _x19_sql():
    lo, hi = _lit_list(LO6), _lit_list(HI6)
    at = f"list_transform(x, lambda v, i: least(greatest(v - b, {lo}[i]), {hi}[i]))"
    x = ", ".join(f"comp[{i + 1}] + 0.05::DOUBLE * ({sql_uniform('perturb', 'sample_id', i)} - 0.5)" for i in range(6))
    return COMP6_SQL + f""",
p AS (SELECT sample_id, [{x}] AS x FROM comp6),
k AS (SELECT sample_id, x, unnest(list_concat(list_transform(x, lambda v, i: v - {lo}[i]),
                                               list_transform(x, lambda v, i: v - {hi}[i]))) AS b FROM p),
f AS (SELECT sample_id, x, b, list_sum({at}) AS s FROM k),
o AS (SELECT *, row_number() OVER w AS rn, lead(b) OVER w AS z, lead(s) OVER w AS sz,
        least(greatest(count_if(s >= 1.0) OVER (PARTITION BY sample_id), 1), 11) AS pick
      FROM f WINDOW w AS (PARTITION BY sample_id ORDER BY b, s DESC)),
l AS (SELECT sample_id, x, b + CASE WHEN s > sz THEN least(greatest((s - 1.0) / (s - sz), 0.0), 1.0) ELSE 0.0 END * (z - b) AS b
      FROM o WHERE rn = pick),
r AS (SELECT sample_id, {at} AS proj FROM l)
SELECT sample_id, array_to_string(list_transform(proj, lambda v: printf('%.6f', round_even(v, 6) + 0.0)), '*') AS proj,
       round(list_sum(proj), 6) + 0.0 AS total FROM r"""


@query("x19_project_simplex", _x19_sql())
def x19_project_simplex(spark, sf_dir):
    """Perturbed compositions projected back onto the bounded simplex;
    the sum is 1 and every component within its bounds."""
    p = _perturbed(spark, sf_dir)
    proj = CA.project_capped_simplex(F.col("x"), LO6, HI6)
    return p.select("sample_id", F.array_join(F.transform(proj, lambda v: F.format_string("%.6f", F.bround(v, 6) + F.lit(0.0))), "*").alias("proj"),
                    _r6(F.aggregate(proj, F.lit(0.0), lambda a, v: a + v)).alias("total"))


def _seq_sum(lst):
    """Left-to-right sum (the order the Spark aggregate uses); 0 if empty."""
    return f"(CASE WHEN len({lst}) = 0 THEN 0.0 ELSE list_reduce({lst}, lambda a, b: a + b) END)"


@query("x20_feasible_interval", COMP6_SQL + f""",
l AS (SELECT sample_id, unnest(range(6)) AS i, comp FROM comp6)
SELECT sample_id, CAST(i AS INTEGER) AS i,
  {sql_round_bin(f"greatest({_lit_list(LO6)}[i + 1], 1.0 - {_seq_sum('comp[1:i]')} - {_seq_sum(_lit_list(HI6) + '[i + 2:6]')})", 4)} + 0.0 AS lo,
  {sql_round_bin(f"least({_lit_list(HI6)}[i + 1], 1.0 - {_seq_sum('comp[1:i]')})", 4)} + 0.0 AS hi
FROM l""")
def x20_feasible_interval(spark, sf_dir):
    """The feasible interval of each component given the ones before."""
    c = _comp6(spark, sf_dir)
    iv = CA.feasible_interval(F.col("comp"), LO6, HI6)
    return c.select("sample_id", F.posexplode(iv).alias("i", "iv")).select(
        "sample_id", "i", (F.col("iv.lo") + F.lit(0.0)).alias("lo"), (F.col("iv.hi") + F.lit(0.0)).alias("hi"))


# attempts that the oracles enumerate; rows need a few of them
SQL_ATTEMPTS = 64


def _g6_sql(n=100):
    grids = [CA.grid_values(LO6[i], HI6[i], 0.001) for i in range(5)]
    picks = ", ".join(f"{_lit_list(g)}[CAST(floor({sql_uniform('rej', 'o_orderkey', 'a', i)} * {len(g)}) AS BIGINT) + 1]"
                      for i, g in enumerate(grids))
    return f"""WITH p AS (SELECT o_orderkey, a, [{picks}] AS c
  FROM orders CROSS JOIN (SELECT unnest(range({SQL_ATTEMPTS})) AS a)),
q AS (SELECT o_orderkey, a, c, list_reduce(c, lambda x, y: x + y) AS s FROM p),
acc AS (SELECT o_orderkey, arg_min(list_append(c, round(1.0 - s, 4)), a) AS comp FROM q
        WHERE s <= 1.0 + 1e-6 AND round(1.0 - s, 4) BETWEEN {LO6[-1]} AND {HI6[-1]} GROUP BY o_orderkey),
k AS (SELECT DISTINCT {_sql_key('comp')} AS comp_key FROM acc)
SELECT comp_key FROM k ORDER BY {sql_uniform('g6', 'comp_key')}, comp_key LIMIT {n}"""


@query("g6_reject_sample", _g6_sql())
def g6_reject_sample(spark, sf_dir):
    """One accepted composition per order, distinct keys, the first 100
    in hash order (sampling is the feature)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    acc = CA.reject_sample(o, "o_orderkey", LO6, HI6)
    keys = acc.select(_key(F.col("comp")).alias("comp_key")).distinct()
    return S.exact_sample(keys, 100, "g6", "comp_key")


def _g7_sql():
    n = len(LO6)
    ctes, cols = ["s0 AS (SELECT o_orderkey, 0.0::DOUBLE AS prev0 FROM orders)"], []
    for i in range(n):
        keep = ", ".join(["o_orderkey", *cols, f"prev{i}"])
        if i == n - 1:
            ctes.append(f"s{i + 1} AS (SELECT {keep}, round(1.0 - prev{i}, 4) AS c{i} FROM s{i})")
        else:
            lo = f"round_even(greatest({LO6[i]}::DOUBLE, 1.0 - prev{i} - {float(sum(HI6[i + 1:]))!r}::DOUBLE), 4)"
            hi = f"round_even(least({HI6[i]}::DOUBLE, 1.0 - prev{i}), 4)"
            ctes.append(f"b{i} AS (SELECT {keep}, round({lo} / 0.001::DOUBLE) AS kl, round({hi} / 0.001::DOUBLE) AS kh FROM s{i})")
            ctes.append(f"p{i} AS (SELECT {keep}, round((kl + floor({sql_uniform('feas', 'o_orderkey', i)} * (kh - kl + 1)))"
                        f" * 0.001::DOUBLE, 4) AS c{i} FROM b{i})")
            ctes.append(f"s{i + 1} AS (SELECT {', '.join(['o_orderkey', *cols, f'c{i}'])}, prev{i} + c{i} AS prev{i + 1} FROM p{i})")
        cols.append(f"c{i}")
    comp = "[" + ", ".join(cols) + "]"
    return ("WITH " + ",\n".join(ctes) + f",\nr AS (SELECT o_orderkey, {comp} AS comp FROM s{n})\n"
            f"SELECT o_orderkey, {_sql_key('comp')} AS comp_key, "
            "round(list_reduce(comp, lambda a, b: a + b), 6) + 0.0 AS total FROM r")


@query("g7_feasible_sample", _g7_sql())
def g7_feasible_sample(spark, sf_dir):
    """One always-feasible composition per order (sequential picks in
    the X20 interval); invariants: sum 1, within bounds."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    s = CA.feasible_sample(o, "o_orderkey", LO6, HI6)
    return s.select("o_orderkey", _key(F.col("comp")).alias("comp_key"),
                    _r6(F.aggregate("comp", F.lit(0.0), lambda a, v: a + v)).alias("total"))


def _target(comp):
    return F.aggregate(F.zip_with(comp, F.array(*[F.lit(w) for w in W_TARGET]), lambda a, b: a * b),
                       F.lit(0.0), lambda s, v: s + v)


@query("u1_union_points", COMP6_SQL + f""",
f AS (SELECT sample_id, comp, o_orderstatus AS st FROM comp6 JOIN orders ON sample_id = o_orderkey),
pts AS (SELECT CASE WHEN st = 'F' THEN 'external' ELSE 'local' END AS set, sample_id,
               list_sum(list_transform(comp, lambda v, i: v * {_lit_list(W_TARGET)}[i])) AS pred FROM f)
SELECT set, sample_id, round(pred, 6) + 0.0 AS pred FROM pts WHERE set = 'external' OR pred >= 0.2""")
def u1_union_points(spark, sf_dir):
    """U1 + F8: local points (open orders) and external points (filled
    orders) in one table with a set tag; local points below the threshold
    are dropped, external ones always kept."""
    c = _comp6(spark, sf_dir).join(table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sample_id"), "o_orderstatus"), "sample_id")
    ext = c.where(F.col("o_orderstatus") == "F").select(F.lit("external").alias("set"), "sample_id",
                                                           _target(F.col("comp")).alias("pred"))
    loc = c.where(F.col("o_orderstatus") != "F").select(F.lit("local").alias("set"), "sample_id",
                                                           _target(F.col("comp")).alias("pred"))
    u = ext.unionByName(loc)
    return u.where((F.col("set") == "external") | (F.col("pred") >= 0.2)).select(
        "set", "sample_id", _r6(F.col("pred")).alias("pred"))


def _history(spark, sf_dir, n=40):
    c = _comp6(spark, sf_dir).join(table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sample_id"), "o_orderstatus"), "sample_id")
    h = S.exact_sample(c.where(F.col("o_orderstatus") == "F"), n, "hist", "sample_id")
    return h.select("sample_id", "comp", _target(F.col("comp")).alias("y"))


@query("m20_gp_score")
def m20_gp_score(spark, sf_dir):
    """M20 + X13 + L4: a GP (Matern 5/2) fitted on 40 observed compositions
    scores every feasible candidate (G7, one per order); EI against the best
    observed; the 5 best untried candidates."""
    hist = _history(spark, sf_dir)
    cands = CA.feasible_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", LO6, HI6)
    cands = cands.withColumn("comp_key", _key(F.col("comp")))
    scored = gp_score(cands, hist, "comp", "y", length_scale=0.2)
    y_max = hist.agg(F.max("y").alias("y_max")).withColumn("_k", F.lit(1))
    scored = scored.withColumn("_k", F.lit(1)).join(F.broadcast(y_max), "_k").withColumn(
        "ei", CA.expected_improvement(F.col("mean"), F.col("std"), F.col("y_max")))
    known = hist.select(_key(F.col("comp")).alias("comp_key"))
    top = CA.rank_by_acquisition(scored, known, "comp_key", "ei", 5)
    return top.select("comp_key", _r6(F.col("mean")).alias("mean"), _r6(F.col("std")).alias("std"),
                      _r6(F.col("ei")).alias("ei"))


@query("m22_search_rounds")
def m22_search_rounds(spark, sf_dir):
    """M22 (+M21, J4, J5, W1): 5 rounds of a batch of 2 proposals: GP on the
    history, EI over the candidate table, untried best q (each proposal gets
    its predicted mean as an imagined target before the next), then the
    true targets (a column expression) are registered; best-so-far per
    round.  Only the history (hundreds of rows) crosses rounds."""
    from stoich.operators.gp import propose_batch
    hist = cut_lineage(_history(spark, sf_dir).withColumn("round", F.lit(0)))
    cands = cut_lineage(CA.feasible_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey",
                                           LO6, HI6).withColumn("comp_key", _key(F.col("comp"))))
    for rnd in range(1, 6):
        picks = propose_batch(cands, hist, "comp", "y", q=2, key="comp_key", length_scale=0.2)
        new = picks.select("comp", _target(F.col("comp")).alias("y"), F.lit(rnd).alias("round"))
        hist = cut_lineage(hist.select("comp", "y", "round").unionByName(new))
    w = hist.groupBy("round").agg(F.max("y").alias("round_best"))
    from pyspark.sql import Window
    # rounds are few (a parameter): a window over the per-round table
    return w.select("round", _r6(F.max("round_best").over(Window.orderBy("round").rowsBetween(
        Window.unboundedPreceding, 0))).alias("best_so_far"))



# Sums of the two families of elements stay at or below 0.55.
GROUPS6 = (((1, 2, 4), 0.55), ((0, 3, 5), 0.55))


@query("m22_constrained_search")
def m22_constrained_search(spark, sf_dir):
    """M20-M22 on weighted features: 40 observed compositions and batches of
    5 proposals up to 100 in all; every round draws one start per supplier
    anew (G8), snaps it (J7) and climbs under the element and group limits.
    Every observation with its target."""
    limits = SE.Limits(tuple(LO6), tuple(HI6), GROUPS6)
    rows = {(r["element"], r["feature_id"]): r["value"] for r in FX.empirical_features(spark, sf_dir)
            .where(F.col("element").isin(ELEMS6)).collect()}
    features = np.array([[rows[e, f] for f in range(4)] for e in ELEMS6])
    orders = S.exact_sample(table(spark, sf_dir, "orders").select("o_orderkey"), 40, "hist", "o_orderkey")
    drawn = CA.substitution_sample(orders, "o_orderkey", LO6, HI6, SUB_OF, FIRST_RANGE)
    hist = drawn.select(F.element_at(CA.snap_neighbours(F.col("comp"), LO6, HI6), 1).alias("comp"))
    hist = hist.withColumn("y", _target(F.col("comp"))).orderBy(_key(F.col("comp")))
    starts = table(spark, sf_dir, "supplier").select("s_suppkey")
    out = SE.search_rounds(starts, "s_suppkey", hist, _target, features, limits, SUB_OF, FIRST_RANGE, total=100)
    return out.select("step", "round", "comp_key", _r6(F.col("y")).alias("y"))


# Which base element each further element substitutes (the
# third and fifth of the six take from the first, the others from the
# second) and the range of the first element.
SUB_OF = [0, 1, 1, 0, 1, 0]
FIRST_RANGE = (1.0 - 0.55, 0.55)


def _g8_sql():
    def draw(i, lo, hi):
        return f"round({lo!r}::DOUBLE + {sql_uniform('subst', 'o_orderkey', 'a', i)} * {hi - lo!r}::DOUBLE, 4)"

    first = f"{draw(0, *FIRST_RANGE)} AS x0, " + ", ".join(f"{draw(i, LO6[i], HI6[i])} AS v{i}" for i in range(2, 6))
    ctes, last = [f"d AS (SELECT o_orderkey, a, {first} FROM orders CROSS JOIN (SELECT unnest(range({SQL_ATTEMPTS})) AS a))",
                  "t2 AS (SELECT *, x0 AS e0, round(1.0 - x0, 4) AS e1, true AS ok FROM d)"], "t2"
    for i in range(2, 6):
        b = SUB_OF[i]
        ctes.append(f"u{i} AS (SELECT * REPLACE (round(e{b} - v{i}, 4) AS e{b}) FROM {last})")
        ctes.append(f"t{i + 1} AS (SELECT * REPLACE (ok AND v{i} BETWEEN {LO6[i]} AND {HI6[i]}"
                    f" AND e{b} BETWEEN {LO6[b]} AND {HI6[b]} AS ok) FROM u{i})")
        last = f"t{i + 1}"
    return ("WITH " + ",\n".join(ctes) + f",\nr AS (SELECT o_orderkey, arg_min([e0, e1, v2, v3, v4, v5], a) AS comp "
            f"FROM {last} WHERE ok GROUP BY 1)\nSELECT o_orderkey, {_sql_key('comp')} AS comp_key, "
            "round(list_reduce(comp, lambda a, b: a + b), 6) + 0.0 AS total FROM r")


@query("g8_substitution_sample", _g8_sql())
def g8_substitution_sample(spark, sf_dir):
    """The accepted composition of every order; it sums to 1 (rounding
    aside) and respects the bounds."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    s = CA.substitution_sample(o, "o_orderkey", LO6, HI6, SUB_OF, FIRST_RANGE)
    return s.select("o_orderkey", _key(F.col("comp")).alias("comp_key"),
                    _r6(F.aggregate("comp", F.lit(0.0), lambda a, v: a + v)).alias("total"))


def _walk_points(spark, sf_dir):
    c = _comp6(spark, sf_dir).join(table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sample_id"), "o_orderstatus"), "sample_id")
    return c.where(F.col("o_orderstatus") == "F").select("sample_id", "comp")


def _local_samples(spark, sf_dir, per_point=1000):
    u = CA.local_grid(_walk_points(spark, sf_dir), "sample_id", "comp", LO6, HI6, step=0.01,
                      per_point=per_point, radius=3)
    return u.select(CA.project_capped_simplex(F.transform("units", lambda x: x / 100.0), LO6, HI6).alias("comp"))


@query("g9_local_grid_walk")
def g9_local_grid_walk(spark, sf_dir):
    """G9 + X19: 1000 walks of up to 3 unit moves (step 0.01) around every
    filled order's composition, de-duplicated over all points, projected;
    invariants: sum 1, inside the bounds."""
    s = _local_samples(spark, sf_dir)
    return s.select(_key(F.col("comp")).alias("comp_key"),
                    _r6(F.aggregate("comp", F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query("m19_local_scatter_table")
def m19_local_scatter_table(spark, sf_dir):
    """Local samples (G9) and external points (filled orders) scored by
    a ridge model on weighted features (J1 over the six brands, fitted from
    Gram statistics on all orders), projected to two PCA axes fitted on the
    local samples (M18), local points below the threshold dropped (F8), the
    two sets unioned with a tag (U1)."""
    from stoich.operators import linear as L
    from stoich.operators import models as ML
    feats = FX.embedding_features(spark, sf_dir).where(F.col("element").isin(ELEMS6))
    fmat = [r["f"] for r in feats.groupBy("element").agg(F.array_sort(F.collect_list(
        F.struct("feature_id", "value"))).alias("fv")).select(
        "element", F.transform("fv", lambda s: s["value"]).alias("f")).orderBy(
        F.expr("cast(substring(element, 7) as int)")).collect()]

    fm = np.asarray(fmat, dtype=float)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def wf_udf(s: pd.Series) -> pd.Series:
        # weighted features of six-brand compositions: comp @ F, per Arrow batch
        if s.empty:
            return s
        return pd.Series(list(np.stack(s.to_numpy()).astype(float) @ fm))

    def wf(comp):
        return wf_udf(comp)

    train = _comp6(spark, sf_dir).join(FX.targets(spark, sf_dir).select("sample_id", "y"), "sample_id") \
        .select("sample_id", wf(F.col("comp")).alias("features"), "y")
    st = L.collect_stats(L.gram_stats(train.withColumn("g", F.lit(0)), "features", "y", ["g"], len(fmat[0])),
                         ["g"], len(fmat[0]))[(0,)]
    beta, b0 = L.ridge_fit(st, 1.0, standardise=True)
    coef = F.array(*[F.lit(float(b)) for b in beta])

    def score(df):
        f = wf(F.col("comp"))
        return df.withColumn("features", f).withColumn("pred", F.aggregate(
            F.zip_with("features", coef, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.lit(b0))

    # the walk output feeds the PCA fit and the final union: materialise once
    local = cut_lineage(score(_local_samples(spark, sf_dir)).withColumn("set", F.lit("local")))
    ext = score(_walk_points(spark, sf_dir).select("comp")).withColumn("set", F.lit("external"))
    local_v = ML.as_ml(local, label=None)
    both = ML.as_ml(local.unionByName(ext), label=None)
    pc = ML.pca_2d(both, fit_on=local_v)
    thr = 0.0
    return pc.where((F.col("set") == "external") | (F.col("pred") >= thr)).select(
        "set", _key(F.col("comp")).alias("comp_key"), "pred", "pc1", "pc2")

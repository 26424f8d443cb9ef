"""Connected components of an edge table, without driver-side state.

Each round every node hooks onto its smallest neighbour, hooks are followed
once more (pointer jumping), and the edges are rewritten to the roots; the
edges at least halve their nodes per round, so rounds grow with the logarithm
of the longest chain.  Hubs are reduced by partial aggregation; joins bring one
row per node to edges, which adaptive execution splits where a hub is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoich.llm.common import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, root the component's smallest
    node.  Self-loops, repeats and direction do not matter."""
    now = materialise(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
                      .where("a <> b").distinct())
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    first = True
    while not now.isEmpty():
        ends = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialise(ends.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("up")))
        jump = materialise(hook.join(hook.select(F.col("node").alias("_n"), F.col("up").alias("_u")),
                                     F.col("up") == F.col("_n")).select("node", F.col("_u").alias("up")))
        if first:
            roots, first = jump.select("node", F.col("up").alias("root")), False
        else:
            roots = roots.join(jump.select(F.col("node").alias("_n"), "up"), F.col("root") == F.col("_n"), "left") \
                .select("node", F.coalesce("up", "root").alias("root"))
        left = jump.select(F.col("node").alias("_a"), F.col("up").alias("x"))
        right = jump.select(F.col("node").alias("_b"), F.col("up").alias("y"))
        now = materialise(now.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
                          .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                          .distinct())
    return roots

"""Connected components of an edge table, by repeated hooking to the smallest neighbour and contraction."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from wakeline.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b); nodes of one component share a root.

    Each round every node hooks to its smallest neighbour, pointers are followed twice, and the edges
    are rewritten to the nodes pointed at; self-loops and repeats go. The graph shrinks at least by
    half every other round, so the rounds are logarithmic in its size. No rows reach the driver, and what a
    round has written goes with the next.
    """
    rest = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct().withColumn("root", F.col("node"))
    while not rest.isEmpty():
        both = rest.union(rest.select("b", "a"))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        near = materialise(near.select("node", F.least("node", "to").alias("to")), "hooks")
        two = near.alias("x").join(near.alias("y"), F.col("x.to") == F.col("y.node")).select("x.node", "y.to")
        jump = materialise(two.alias("x").join(near.alias("y"), F.col("x.to") == F.col("y.node")).select("x.node", "y.to"), "jumps")
        a = rest.join(jump, rest.a == jump.node).select(F.col("to").alias("a"), "b")
        b = a.join(jump, a.b == jump.node).select("a", F.col("to").alias("b")).filter("a <> b")
        less = materialise(b.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        new = found.join(jump, found.root == jump.node, "left").select(found.node, F.coalesce("to", "root").alias("root"))
        roots = materialise(new, "roots")
        discard(rest, near, jump, found)
        rest, found = less, roots
    return found

"""Connected components of an edge table, as joins and aggregates.

Alternating large-star and small-star rounds (Kiveris et al., 2014): every round hangs the
neighbours of a node on the least of them, until each component is a star around its least
node.  A round is a few shuffles; the number of rounds grows with the logarithm of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import materialise


def _state(edges: DataFrame) -> tuple:
    """Two equal sets of edges have equal states."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("_m", "u").alias("_m"))
    # A hub's edges all meet here in one key; the adaptive skew join splits them.
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("_m"))
    met = edges.join(least, "u").filter("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return met.union(least.select("u", F.col("_m").alias("v"))).distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node with an edge; a component is named by its least node.

    Null ends, loops and repeated edges add nothing.  An empty table gives an empty one.
    """
    a, b = F.col(left), F.col(right)
    found = materialise(
        edges.filter(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    state = _state(found)
    while state[0]:
        found = materialise(_small_star(_large_star(found)))
        before, state = state, _state(found)
        if state == before:
            break
    roots = found.select(F.col("v").alias("node")).distinct()
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )

"""Connected groups of a graph given as edges: alternating star contractions.

A large star links every larger neighbour of a node to the smallest of its neighbourhood, a small star every smaller
one. Repeated, they turn each group into one star around its smallest node. Every step is a grouped minimum and a join
of tables in the shared folder, so the join's sides are plain scans and Spark can split a node with many edges. The
rounds end when they no longer change the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ranksmith.storage import written


def connected(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of an edge (a, b): the smallest node of its group."""
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = written(clean.distinct(), "edges")
    state = _state(current)
    while state[0]:
        both = current.selectExpr("a as u", "b as v").union(current.selectExpr("b as u", "a as v"))
        least = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = both.join(least, "u").where("v > u and v <> m").selectExpr("v as u", "m as v")
        large = written(large.distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").selectExpr("v as a", "m as b")
        current = written(small.union(least.selectExpr("u as a", "m as b")).distinct(), "edges")
        before, state = state, _state(current)
        if state == before:
            break
    return current.selectExpr("a as node", "b as root").union(
        current.selectExpr("b as node", "b as root").distinct()
    )


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

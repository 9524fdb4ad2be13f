"""Connected components by alternating large-star and small-star rounds, all in joins and aggregates.

Every round finds each node's least neighbour by a group-by (combined before the shuffle), writes
that table, and joins it back. As the least neighbours are read from a table, both sides of the join
are plain exchanges, and adaptive execution can split a hub with a third of all edges; with the
group-by between exchange and join it could not. Rounds end when the edges stop changing: about log^2
of the longest path at most. Each round is written to the shared folder and the round before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.shared import drop, materialise


def large_star(sides: DataFrame, least: DataFrame) -> DataFrame:
    """Each node's larger neighbours, linked to the least of the node and its neighbours. ``least`` is a written table."""
    return sides.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")


def small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and the node itself, linked to the least of them. ``least`` is a written table."""
    down = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return down.filter("u != v")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the least node of the component) for every node that has an edge to another one.

    Nodes may be of any type with an order. Edges with a null end or equal ends say nothing and are passed over.
    """
    both = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    current = materialise(both.filter("_a is not null and _b is not null and u != v").select("u", "v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        sides = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialise(large_star(sides, least).distinct(), "edges")
        lower = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        following = materialise(small_star(large, lower).distinct(), "edges")
        drop(current, least, large, lower)
        current = following
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))

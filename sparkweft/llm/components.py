"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregation and a join of written tables, so a node with very many edges is split by Spark's own
handling of skewed joins, and nothing is collected but one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.staging import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Joins the neighbours of each node to the least of them; ``edges`` has u > v."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = stage(around.groupBy("u").agg(F.min("v").alias("m")))
    if large:  # a node that is itself the least of its neighbourhood keeps its edges
        met = edges.select(F.col("v").alias("u"), F.col("u").alias("far")).join(least, "u")
        moved = met.select(F.col("far").alias("u"), F.least("u", "m").alias("v"))
    else:
        met = edges.join(least, "u").where(F.col("v") > F.col("m"))
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return stage(moved.where(F.col("u") > F.col("v")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for all nodes of ``edges`` (u, v, two longs).

    Direction, repeats, loops and nulls of edges don't matter: loops and edges with a null end join nothing. Nodes without
    a proper edge are not in the result. Ends when a round changes no edge; each round shortens paths at least by half,
    so long chains take a number of rounds of the order of their logarithm.
    """
    proper = edges.where(F.col("u") != F.col("v"))
    known = stage(proper.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        mark = known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        known = _star(_star(known, True), False)
    roots = known.select("v").distinct()
    return known.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )

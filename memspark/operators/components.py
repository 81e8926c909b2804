"""Connected components of any size, by alternating large and small stars.

Every round hangs each neighbourhood onto its least member, first among the
larger and then among the smaller neighbours; after about log(n) rounds each
component is a star around its least node. Neighbourhoods are never collected:
the least neighbour comes from a partial aggregate, and the join that applies
it has one row per node on one side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.tables import cut_observing


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b, distinct. The same components with the edges of one star step."""
    if large:
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # neighbours larger than a hang onto the least of a's neighbourhood
        moved = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select("v", "m")
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.col("b").alias("v"), "m").unionByName(least.select(F.col("a").alias("v"), "m"))
    return moved.filter("v != m").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its least node) for every node of an edge; of no edge, no row.

    Edges may point any way and repeat; loops and those with a null end count for nothing.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b")
    marks = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")]
    at, state = cut_observing(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), *marks)
    mark = None
    while state.get("n") and state != mark:
        mark = state
        at, state = cut_observing(_star(_star(at, True), False), *marks)
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Paths and neighbourhoods over current triples, level by level.

A level joins the distinct nodes of the frontier with the edges and drops what
was visited, so work is bounded by the edges and not by the number of paths.
Each level is written, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.tables import cut, cut_counting


def edges(triples: DataFrame, scope: Column | None = None, relation_types: Sequence[str] | None = None) -> DataFrame:
    """src, dst, triple: current triples between entities, each once."""
    keep = F.col("valid_to").isNull() & F.col("object_id").isNotNull() & F.col("subject_id").isNotNull()
    if relation_types is not None:
        keep = keep & F.col("relation_type").isin(list(relation_types))
    if scope is not None:
        keep = keep & scope
    return triples.filter(keep).select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), F.col("id").alias("triple")).distinct()


def _levels(links: DataFrame, starts: DataFrame, max_depth: int, target: str | None = None) -> DataFrame:
    """start, node, depth, prior, triple: every node reached with its least depth; of equally short ways the least (prior, triple)."""
    seen = cut(starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct().selectExpr("*", "0 AS depth", "CAST(NULL AS STRING) AS prior", "CAST(NULL AS STRING) AS triple"))
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.select("start", F.col("node").alias("src")).join(links, "src")
        step = step.groupBy("start", F.col("dst").alias("node")).agg(F.lit(depth).alias("depth"), F.min(F.struct(F.col("src").alias("prior"), "triple")).alias("by"))
        step = step.select("start", "node", "depth", "by.prior", "by.triple").join(seen, ["start", "node"], "left_anti")
        frontier, n = cut_counting(step, F.lit(True))
        if n == 0:
            break
        seen = seen.unionByName(frontier)
        if target is not None and not frontier.filter(F.col("node") == target).isEmpty():
            break
    return seen


def n_degree(triples: DataFrame, starts: DataFrame, max_depth: int = 2, scope: Column | None = None, relation_types: Sequence[str] | None = None) -> DataFrame:
    """start, node, depth of every node within max_depth of a start (column id), the start left out, each at its least depth."""
    return _levels(edges(triples, scope, relation_types), starts, max_depth).filter("depth > 0").select("start", "node", "depth")


def shortest_path(triples: DataFrame, src: str, dst: str, max_depth: int = 5, scope: Column | None = None, relation_types: Sequence[str] | None = None) -> DataFrame:
    """position, node, triple of a shortest way (the triple leads to the node); of equally short ones that of the least prior nodes.

    No row without a way of max_depth triples at most; from a node to itself the node alone.
    """
    spark = triples.sparkSession
    start = spark.createDataFrame([(src,)], "id string")
    seen = _levels(edges(triples, scope, relation_types), start, 0 if src == dst else max_depth, dst)
    way, at = [], dst
    while at is not None:  # one row a level
        row = seen.filter(F.col("node") == at).first()
        if row is None:
            return spark.createDataFrame([], "position int, node string, triple string")
        way.append((row["depth"], row["node"], row["triple"]))
        at = row["prior"]
    return spark.createDataFrame(sorted(way), "position int, node string, triple string")


def with_names(df: DataFrame, column: str, entities: DataFrame, out: str) -> DataFrame:
    """df with the name of the entity in `column`, the id itself where there is none."""
    names = entities.groupBy(F.col("id").alias("_id")).agg(F.min("name").alias("_name"))
    return df.join(names, F.col(column) == F.col("_id"), "left").withColumn(out, F.coalesce("_name", column)).drop("_id", "_name")

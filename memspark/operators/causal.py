"""Causal chains over predecessor links of triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.operators.hierarchy import hierarchy
from memspark.tables import cut, cut_counting


def _links(triples: DataFrame) -> DataFrame:
    return triples.filter("predecessor_id IS NOT NULL").select("id", F.col("predecessor_id").alias("prior")).distinct()


def trace(triples: DataFrame, start: str, direction: str = "backward", max_depth: int = 20, scope: Column | None = None) -> DataFrame:
    """direction, id, depth: the triples that led to `start` (itself at 0) and those that follow from it (without it).

    Each triple at its least depth, so cycles end. The scope is asked of the
    start only; of a start that isn't there or out of scope, no row.
    """
    if direction not in ("backward", "forward", "both"):
        raise ValueError(f"no direction: {direction!r}")
    wanted = ("backward", "forward") if direction == "both" else (direction,)
    first = triples.filter(F.col("id") == start)
    first = (first if scope is None else first.filter(scope)).select("id", F.lit(0).alias("depth")).distinct()
    seen = frontier = cut(first.withColumn("direction", F.explode(F.array(*map(F.lit, wanted)))).select("direction", "id", "depth"))
    # links whose ends are both there, turned the ways asked for, read once: both directions go one level at a time
    known = triples.select(F.col("id").alias("prior")).distinct()
    links = _links(triples).join(known, "prior", "left_semi")
    turned = {"backward": links.select(F.lit("backward").alias("direction"), F.col("id").alias("at"), F.col("prior").alias("to")), "forward": links.select(F.lit("forward").alias("direction"), F.col("prior").alias("at"), F.col("id").alias("to"))}
    ways = cut(reduce(DataFrame.unionByName, [turned[w] for w in wanted]))
    for depth in range(1, max_depth + 1):
        step = frontier.select("direction", F.col("id").alias("at")).join(ways, ["direction", "at"]).select("direction", F.col("to").alias("id")).distinct()
        frontier, n = cut_counting(step.join(seen, ["direction", "id"], "left_anti").withColumn("depth", F.lit(depth)), F.lit(True))
        if n == 0:
            break
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0 OR direction = 'backward'").select("direction", "id", "depth")


def chains(triples: DataFrame) -> DataFrame:
    """id, root_id, depth of every triple in its causal chain; on or after a cycle `cycle` and -1."""
    return hierarchy(triples, "id", "predecessor_id", with_ranges=False)


def would_cycle(triples: DataFrame, triple: str, predecessor: str, max_depth: int = 100) -> bool:
    """Whether making `predecessor` the predecessor of `triple` closes a cycle; itself counts."""
    if triple == predecessor:
        return True
    return not trace(triples, predecessor, "backward", max_depth).filter(F.col("id") == triple).isEmpty()

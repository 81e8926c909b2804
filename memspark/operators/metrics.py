"""Measures of retrieval: hits, accuracy by kind, nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit_at_k(found: DataFrame, gold: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """by, n, hits, rate: queries (column query, by) of gold (query, key) of which any key is found (query, key, rank) within k.

    Queries without anything found count as misses; those without gold don't count.
    """
    by = by or []
    hit = found.filter(F.col("rank") <= k).select("query", "key").distinct().withColumn("hit", F.lit(1))
    each = gold.join(hit, ["query", "key"], "left").groupBy("query", *by).agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return each.groupBy(*by).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.avg("hit").alias("rate"))


def hits_at(found: DataFrame, gold: DataFrame, cutoffs: list[int], by: list[str] | None = None) -> DataFrame:
    """by, n and hit_<k> for every cutoff: the share of queries with any key found within k, in one pass over the best rank of each."""
    by = by or []
    best = found.groupBy("query", "key").agg(F.min("rank").alias("rank"))
    each = gold.join(best, ["query", "key"], "left").groupBy("query", *by).agg(F.min("rank").alias("rank"))
    return each.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))).alias(f"hit_{k}") for k in cutoffs])


def nearest_rank(column: str, *shares: float) -> list[Column]:
    """Aggregates p<share>: the value at that share of the sorted column, one that occurs (no interpolation)."""
    return [F.expr(f"percentile_disc({s}) WITHIN GROUP (ORDER BY `{column}`)").alias(f"p{round(100 * s)}") for s in shares]

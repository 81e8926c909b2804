"""Reciprocal rank fusion, hybrid search, layered context under a token budget."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K, BUDGET_SHARE = 60, 0.7


def rrf(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """key, score, found_in: 1/(k + rank) summed over the rankings (key, rank, ranking), which are top-k lists.

    Of equal scores the one seen first (in the order of the rankings, then by rank) comes first: column seen.
    """
    each = reduce(DataFrame.unionByName, [r.select("key", "rank", "ranking", F.lit(i).alias("i")) for i, r in enumerate(rankings)])
    fused = each.groupBy("key").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("i", "rank")).alias("seen"), F.array_sort(F.collect_set("ranking")).alias("found_in"))
    return fused.orderBy(F.desc("score"), "seen")


def first_layer(items: DataFrame, key: str, layer_order: Column, within: list[Column]) -> DataFrame:
    """One row per key: that of the first layer, within it the first."""
    w = W.partitionBy(key).orderBy(layer_order, *within)
    return items.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def token_estimate(text: Column) -> Column:
    """A token for four characters, one at least; none for an empty text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("int")


def greedy_fill(items: DataFrame, by: list[str], order: list[str], tokens: str, key: str, budget: int) -> DataFrame:
    """by, keys, used, truncated: in order, each item that still fits 0.7 of the budget; one that doesn't is skipped and truncated set.

    items are the few hundred candidates of one context, a list per group of `by`.
    """
    room = int(budget * BUDGET_SHARE)
    entry = F.struct(*order, F.col(tokens).cast("long").alias("_tokens"), F.col(key).alias("_key"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("keys"), F.lit(False).alias("truncated"))

    def take(at: Column, x: Column) -> Column:
        fits = at["used"] + x["_tokens"] <= room
        return F.struct(
            F.when(fits, at["used"] + x["_tokens"]).otherwise(at["used"]).alias("used"),
            F.when(fits, F.concat(at["keys"], F.array(x["_key"].cast("string")))).otherwise(at["keys"]).alias("keys"),
            (at["truncated"] | ~fits).alias("truncated"),
        )

    lists = items.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("_items"))
    return lists.select(*by, F.aggregate("_items", start, take).alias("at")).select(*by, "at.keys", "at.used", "at.truncated")


def rerank_scale(items: DataFrame, by: list[str], score: str, rank: str, head: int = 50) -> DataFrame:
    """items with `scaled`: of the first `head` of each group the score on [0, 1] (all 1 where they are equal), of the rest min(score, 0)."""
    names = [f"_k{i}" for i in range(len(by))]
    # head rows a group, reduced to one: the rest of a group of any size stays where it is
    ends = items.filter(F.col(rank) <= head).groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)]).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    items = items.join(ends, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)], "left")
    low, high = F.col("_low"), F.col("_high")
    scaled = F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low))
    items = items.withColumn("scaled", F.when(F.col(rank) <= head, scaled).otherwise(F.least(F.col(score), F.lit(0.0))))
    return items.drop("_low", "_high", *names)


def rerank(items: DataFrame, by: list[str], text: str, rank: str, scorer: Callable[[Column], Column], head: int = 50) -> DataFrame:
    """items with `scaled` from any scorer of texts (a column expression or a pandas UDF), which is asked for the first `head` of each group only."""
    first = items.filter(F.col(rank) <= head).withColumn("_score", scorer(F.col(text)).cast("double"))
    rest = items.filter(~(F.col(rank) <= head)).withColumn("_score", F.lit(0.0))
    return rerank_scale(first.unionByName(rest), by, "_score", rank, head).drop("_score")

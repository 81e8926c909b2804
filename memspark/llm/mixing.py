"""Mixing sources to target shares of the total size.

Documents get hash-random keys and are range-sorted by (source, key); the
prefix sums of their sizes, distributed over the ranges, tell for each budget
where its source is cut. A source whose budget exceeds its size goes round
again, at most max_repeats times in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.operators.prefix import prefix_sum
from memspark.tables import cut


def source_key(c: Column) -> Column:
    """The form in which sources compare: trimmed, letter case ignored; null where nothing is left."""
    s = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(s != "", s)


def _plan(sizes: DataFrame, targets: DataFrame, total: DataFrame) -> DataFrame:
    """mix, source, target_share, target_size, max_repeats, available, whole (rounds), rest (of the last, partial round)."""
    weight = F.when((F.col("target_weight") > 0) & (F.col("target_weight") < float("inf")), F.col("target_weight")).otherwise(0.0)
    rows = targets.select(F.col("mix_name").alias("mix"), source_key(F.col("source")).alias("source"), weight.alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"), "size_ratio")
    rows = rows.groupBy("mix", "source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"), F.max("size_ratio").alias("ratio"))
    mixes = rows.groupBy(F.col("mix").alias("_mix")).agg(F.sum("weight").alias("weights"), F.max("ratio").alias("size_ratio"))
    rows = rows.join(mixes, F.col("mix").eqNullSafe(F.col("_mix"))).crossJoin(F.broadcast(total))  # total is one row
    rows = rows.join(sizes, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    rows = rows.withColumn("target_share", F.coalesce(F.try_divide("weight", "weights"), F.lit(0.0)))
    rows = rows.withColumn("target_size", F.col("target_share") * F.greatest(F.coalesce("size_ratio", F.lit(0.0)), F.lit(0.0)) * F.col("total"))
    reach = F.least(F.col("target_size"), F.col("max_repeats") * F.col("available"))
    whole = F.coalesce(F.floor(F.try_divide(reach, F.col("available"))), F.lit(0))
    return rows.withColumn("whole", whole).select("mix", "source", "target_share", "target_size", "max_repeats", "available", "whole", (reach - F.col("whole") * F.col("available")).alias("rest"))


def mix(docs: DataFrame, key: str, source: str, size: str, targets: DataFrame, seed: int = 9) -> tuple[DataFrame, DataFrame]:
    """The selection (mix, key, source, size, copies) and its shares, as two tables.

    targets: mix_name, source, target_weight, max_repeats (null: once),
    size_ratio. A mix is to have size_ratio times the size of all docs, of it
    each source its weight's share of the sum of weights in the mix (null,
    negative and infinite weights are 0; sources compare without case and
    blanks; rows of one mix and source add up). A source gives whole rounds of
    its documents and then, in the order of a hash of the key, as many as
    bring it nearest to its budget: it misses it by half a document at most,
    unless documents or max_repeats don't suffice; that share is then not
    given to others. Documents without size, source or key are in no mix;
    rows of one key are one, of the greatest size. The shares tell per mix
    and source the target, what was available and what was reached.
    """
    rows = docs.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(F.col(size).alias("size"), source_key(F.col(source)).alias("source"))).alias("d"))
    rows = cut(rows.select("_key", "d.*").withColumn("order", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_key").cast("string")))))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    usable = rows.filter("size > 0 AND source IS NOT NULL")
    plan = _plan(usable.groupBy("source").agg(F.sum("size").alias("available")), targets, total)
    placed = prefix_sum(usable, ["source"], ["order", "_key"], "size", "before")
    last = ((F.col("rest") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("rest"))).cast("long")
    taken = placed.join(plan.filter("whole > 0 OR rest > 0"), "source").withColumn("copies", F.col("whole") + last).filter("copies > 0")
    chosen = cut(taken.select("mix", F.col("_key").alias(key), "source", F.col("size").alias(size), "copies"))
    given = chosen.groupBy(F.col("mix").alias("_mix"), F.col("source").alias("_source")).agg(F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"), F.sum(F.col(size) * F.col("copies")).alias("reached"))
    sums = given.groupBy(F.col("_mix").alias("_whole")).agg(F.sum("reached").alias("mix_size"))
    shares = plan.join(given, F.col("mix").eqNullSafe(F.col("_mix")) & (F.col("source") == F.col("_source")), "left").join(sums, F.col("mix").eqNullSafe(F.col("_whole")), "left")
    zero = F.lit(0).cast("long")
    reached = F.coalesce("reached", zero)
    shares = shares.select("mix", "source", "target_share", "target_size", "available", F.coalesce("n_docs", zero).alias("n_docs"), F.coalesce("most_copies", zero).alias("most_copies"), reached.alias("reached_size"), F.coalesce(F.try_divide(reached, F.col("mix_size")), F.lit(0.0)).alias("reached_share"))
    return chosen, shares

"""One surviving record per group of duplicates, whole or field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark.operators.components import components
from memspark.tables import cut


def same_id(c: Column) -> Column:
    """c without case and surrounding blanks; null where nothing is left."""
    s = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(s != "", s)


def same_text(c: Column) -> Column:
    """The letters and digits of c, case ignored; null where there is none."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""), "ß", "ss")
    return F.when(s != "", s)


def grouped(df: DataFrame, key: str, within: list[str], keys: list[Column], keep: list[Column]) -> DataFrame:
    """key, keep and group: records (one per key) that share `within` and one of two keys, also by way of others, have one group.

    Null keys join nothing; nulls in `within` equal one another; records
    without a key column are left out, of rows of one key the greatest counts.
    """
    first, second = [F.when(k.isNotNull(), F.md5(F.to_json(F.struct(*[F.col(c).alias(f"w{i}") for i, c in enumerate(within)], F.lit(n).alias("n"), k.alias("k"))))) for n, k in enumerate(keys)]
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_id"), first.alias("first"), second.alias("second"), *keep)
    rows = rows.withColumn("_node", F.coalesce("first", "second", F.concat(F.lit("id:"), F.col("_id"))))
    names = [c for c in rows.columns if c not in ("_id", "first")]
    rows = cut(rows.groupBy("_id").agg(F.max(F.struct(*names)).alias("r")).select("_id", "r.*"))
    # a record's first key is a node; records of one second key form a star around the least of their nodes
    pairs = rows.filter("second is not null").select("_node", "second").distinct()
    least = pairs.groupBy("second").agg(F.min("_node").alias("_least"), F.count("*").alias("n")).filter("n > 1")
    joined = components(pairs.join(least, "second").filter("_node != _least").select("_node", "_least"), "_node", "_least")
    rows = rows.join(joined, F.col("_node") == F.col("node"), "left").withColumn("group", F.coalesce("component", "_node"))
    return rows.drop("_node", "second", "node", "component").withColumnRenamed("_id", key)


def survivors(groups: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """group, key: the first record by order (which must be total) of each group of two or more.

    The limit on the rank reaches below the exchange, so that of a group of
    any size at most two records a task are sent.
    """
    ranked = groups.withColumn("rank", F.row_number().over(W.partitionBy("group").orderBy(*order))).filter("rank <= 2")
    return ranked.groupBy("group").agg(F.count("*").alias("n"), F.min_by(key, "rank").alias(key)).filter("n = 2").select("group", key)


def golden(groups: DataFrame, key: str, rank: Column, fields: dict[str, Column]) -> DataFrame:
    """group, key and each of the fields for groups of two or more: key of the least rank, fields as given (aggregates)."""
    made = groups.groupBy("group").agg(F.count("*").alias("_n"), F.min_by(key, rank).alias(key), *[f.alias(n) for n, f in fields.items()])
    return made.filter("_n > 1").drop("_n")

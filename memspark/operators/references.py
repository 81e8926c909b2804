"""References to records that are missing, already closed, or begin later.

References and parent keys are partitioned and sorted by one key and merged in
a single pass (a sort-merge join, whose skewed keys AQE splits); the parent
side is one row per key with the span over which any of its records is valid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.tables import ref_key


def parent_spans(df: DataFrame, key: str, begins: str | None, ends: str | None) -> DataFrame:
    """key, begin_us, end_us (null: no bound) per key as references compare, over all its records; null and blank keys are none."""
    bound = lambda c, pick, none: pick(F.coalesce(F.col(c) if c else F.lit(None).cast("long"), F.lit(none)))
    least, most = -(2**63), 2**63 - 1
    spans = df.select(ref_key(F.col(key)).alias("key"), *[F.col(c) for c in (begins, ends) if c]).filter("key is not null")
    spans = spans.groupBy("key").agg(bound(begins, F.min, least).alias("begin_us"), bound(ends, F.max, most).alias("end_us"))
    null = lambda c, none: F.when(F.col(c) != none, F.col(c)).alias(c)
    return spans.select("key", null("begin_us", least), null("end_us", most))


def check_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """references with status: ok, missing, closed or late.

    references: target, reference, at_us and further columns; parents: target,
    key, begin_us, end_us (parent_spans() of each target, in a union). Null
    and blank references refer to nothing and are left out. closed: every
    record of the key ended at or before at_us; late: none has begun by then.
    A row without a time can be neither. Repeated rows stay repeated.
    """
    refs = references.withColumn("_key", ref_key(F.col("reference"))).filter("_key is not null")
    there = parents.select(F.col("target").alias("_target"), F.col("key").alias("_parent"), "begin_us", "end_us")
    merged = refs.join(there.hint("merge"), (F.col("target") == F.col("_target")) & (F.col("_key") == F.col("_parent")), "left")
    status = (
        F.when(F.col("_parent").isNull(), "missing")
        .when(F.col("end_us") <= F.col("at_us"), "closed")
        .when(F.col("begin_us") > F.col("at_us"), "late")
        .otherwise("ok")
    )
    return merged.withColumn("status", status).drop("_key", "_target", "_parent", "begin_us", "end_us")

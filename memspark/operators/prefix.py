"""Distributed prefix sums and neighbours within groups of any size.

Rows are range-partitioned by group and order and written with the number of
their range, so a group of any size is spread over many ranges. Only groups
that span ranges need anything from elsewhere: at most one row per range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark.tables import cut


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df written in ranges of (keys, order), with its range as _range."""
    return cut(df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn("_range", F.spark_partition_id()))


def spanning(df: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """df left-joined with extra on keys (null-safe) and _range.

    extra has rows only for groups that go on in another range, so no more
    than there are ranges (shuffle partitions): a bounded broadcast.
    """
    by = [*keys, "_range"]
    names = [f"_k{i}" for i in range(len(by))]
    extra = extra.withColumnsRenamed(dict(zip(by, names, strict=True)))
    return df.join(F.broadcast(extra), [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)], "left").drop(*names)


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """df with, for each value: out of values, the sum of `value` over the rows before this one in its group (keys may hold nulls).

    order must tell the rows of a group apart; a null value counts as 0; an
    empty table stays empty. Sums start at 0.
    """
    df = ranged(df, keys, order)
    by, names = [*keys, "_range"], list(values)
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*by).agg(*[F.sum(v).alias(f"_sum{i}") for i, v in enumerate(names)])
    bases = totals.select(*by, *[F.sum(f"_sum{i}").over(before).alias(f"_base{i}") for i in range(len(names))], F.count("*").over(before).alias("_before")).filter("_before > 0").drop("_before")
    local = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = spanning(df.withColumns({f"_local{i}": F.sum(v).over(local) for i, v in enumerate(names)}), bases, keys)
    zero = F.lit(0)
    rows = rows.withColumns({values[v]: F.coalesce(f"_base{i}", zero) + F.coalesce(f"_local{i}", zero) for i, v in enumerate(names)})
    return rows.drop("_range", *[f"_{k}{i}" for i in range(len(names)) for k in ("base", "local")])


def prefix_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """prefix_sums() of one value."""
    return prefix_sums(df, keys, order, {value: out})


def neighbour(df: DataFrame, keys: list[str], order: str, carried: list[str], out: str, forward: bool) -> DataFrame:
    """df (from ranged()) with `out`: the carried columns of the next (or previous) row of the key, in whichever range it is."""
    step, end = (F.lead, F.min_by) if forward else (F.lag, F.max_by)
    here = F.struct(*carried)
    near = df.withColumn("_near", step(here).over(W.partitionBy(*keys, "_range").orderBy(order)))
    edges = df.groupBy(*keys, "_range").agg(end(here, F.col(order)).alias("_edge"))
    far = edges.withColumn("_far", step("_edge").over(W.partitionBy(*keys).orderBy("_range"))).filter("_far is not null").drop("_edge")
    return spanning(near, far, keys).withColumn(out, F.coalesce("_near", "_far")).drop("_near", "_far")

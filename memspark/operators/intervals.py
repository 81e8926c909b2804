"""Continuous periods of overlapping intervals, and the gaps between them.

Two-level merge. Time is cut into shards at quantiles of the starts, so no
shard of any entity holds more than about `shard_rows` intervals. An interval
inside one shard stays a row; one that crosses a border becomes a head (only
the earliest per shard matters), a tail (only the latest) and a run of wholly
covered shards, one row however many they are. Heads, tails, runs and equal
starts collapse before the shuffle. Shards merge locally; what touches their borders is stitched on a
summary of at most three rows per entity and shard.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark.tables import cut

#: Intervals per shard aimed at; and the most shards, which bounds the driver's list of borders and what is stitched in one task (beyond 1.3 billion intervals shards grow).
SHARD_ROWS, MOST_SHARDS = 65_536, 20_000


def _borders(spans: DataFrame, shard_rows: int) -> list[int]:
    """Ascending starts of the shards after the first; fewer than MOST_SHARDS."""
    rows = spans.agg(F.count("*")).first()[0]
    n = min(MOST_SHARDS, -(-rows // shard_rows))
    if n < 2:
        return []
    cuts = spans.agg(F.percentile_approx("s", [i / n for i in range(1, n)], 10 * n)).first()[0]
    return sorted(set(cuts))


def _shard(df: DataFrame, at: str, out: str, borders: list[int]) -> DataFrame:
    if not borders:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *map(float, borders), float("inf")]
    df = df.withColumn("_at", F.col(at).cast("double"))
    return Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket").transform(df).withColumn(out, F.col("_bucket").cast("int")).drop("_at", "_bucket")


def _islands(pieces: DataFrame, by: list[str]) -> DataFrame:
    """Merged (s, e) of pieces within each group `by`; touching pieces merge. The starts of a group must differ."""
    w = W.partitionBy(*by).orderBy("s")
    before = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("s") <= F.col("_before"), 0).otherwise(1)).over(w)
    return pieces.withColumn("_before", before).withColumn("_run", run).groupBy(*by, "_run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_run")


def _covered(islands: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, shard of the shards with islands that lie within a run: one row for each island's shard and run, however many shards a run covers."""
    none = F.lit(None).cast("long").alias("to_shard")
    marks = islands.select(*keys, F.col("shard").cast("long"), none).distinct().unionByName(runs.select(*keys, F.col("from_shard").cast("long").alias("shard"), "to_shard"))
    w = W.partitionBy(*keys).orderBy("shard")  # rows of one shard are peers: a run that begins there counts
    return marks.withColumn("_until", F.max("to_shard").over(w)).filter("to_shard IS NULL AND _until > shard").select(*keys, F.col("shard").cast("int").alias("shard"))


def _merged(spans: DataFrame, keys: list[str], shard_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Islands within shards (with first/last flags, without those of wholly covered shards); stitched blocks; runs of covered shards."""
    borders = _borders(spans, shard_rows)
    k = [*keys, "shard"]
    spans = _shard(spans, "s", "lo", borders).withColumn("_last", F.col("e") - 1)
    spans = _shard(spans, "_last", "hi", borders).drop("_last")
    edges = spans.sparkSession.createDataFrame([(i, b) for i, b in enumerate(borders, 1)], "i int, border long") if borders else None
    if borders:
        # at most MOST_SHARDS rows of two numbers: a bounded broadcast
        start = F.broadcast(edges.select(F.col("i").alias("hi"), F.col("border").alias("hi_start")))
        end = F.broadcast(edges.select((F.col("i") - 1).alias("lo"), F.col("border").alias("lo_end")))
        spans = spans.join(start, "hi", "left").join(end, "lo", "left")
        crossing = F.col("lo") < F.col("hi")
        inside = spans.filter(~crossing).select(*keys, F.col("lo").alias("shard"), "s", "e")
        heads = spans.filter(crossing).groupBy(*keys, F.col("lo").alias("shard")).agg(F.min("s").alias("s"), F.first("lo_end").alias("e"))
        tails = spans.filter(crossing).groupBy(*keys, F.col("hi").alias("shard")).agg(F.first("hi_start").alias("s"), F.max("e").alias("e"))
        long = spans.filter(F.col("hi") - F.col("lo") > 1)
        runs = _islands(long.groupBy(*keys, (F.col("lo") + 1).cast("long").alias("s")).agg(F.max(F.col("hi").cast("long")).alias("e")), keys)
        runs = runs.withColumnsRenamed({"s": "from_shard", "e": "to_shard"})  # to_shard is the first that isn't covered
        inside = inside.unionByName(heads).unionByName(tails)
    else:
        inside = spans.select(*keys, F.col("lo").alias("shard"), "s", "e")
        runs = None
    pieces = inside.groupBy(*k, "s").agg(F.max("e").alias("e"))
    islands = _islands(pieces, k)
    if runs is not None:
        covered = _covered(islands, runs, keys)
        same = [islands[c].eqNullSafe(covered[c]) for c in k]
        islands = islands.join(covered, same, "left_anti")
    islands = islands.withColumn("prev_e", F.lag("e").over(W.partitionBy(*k).orderBy("s"))).withColumn("next_s", F.lead("s").over(W.partitionBy(*k).orderBy("s")))
    islands = cut(islands)
    blocks = islands.groupBy(*k).agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("shard")
    if runs is not None:
        whole = runs.join(F.broadcast(edges.select(F.col("i").cast("long").alias("from_shard"), F.col("border").alias("s"))), "from_shard")
        whole = whole.join(F.broadcast(edges.select(F.col("i").cast("long").alias("to_shard"), F.col("border").alias("e"))), "to_shard").select(*keys, "s", "e")
        runs = whole
        blocks = blocks.unionByName(whole)
    return islands, blocks, runs


def _spans(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    return df.select(*keys, F.col(start).alias("s"), F.col(end).alias("e")).filter(F.col("s").isNotNull() & (F.col("e") > F.col("s")))


def gaps(df: DataFrame, keys: list[str], start: str, end: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """keys, gap_start, gap_end: the stretches between the first and last covered instant that no [start, end) covers.

    start and end are long columns (starts below 2^53 in size, as borders are
    compared as doubles; ends of any size). Null bounds and ends not after their
    starts cover nothing; a null key is a key of its own; touching intervals
    leave no gap; repeated rows and further columns have no effect; no
    interval, no row.
    """
    islands, blocks, _ = _merged(_spans(df, keys, start, end), keys, shard_rows)
    inner = islands.filter(F.col("prev_e").isNotNull()).select(*keys, F.col("prev_e").alias("gap_start"), F.col("s").alias("gap_end"))
    w = W.partitionBy(*keys).orderBy("s")
    outer = blocks.withColumn("gap_start", F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))).filter(F.col("s") > F.col("gap_start"))
    return inner.unionByName(outer.select(*keys, "gap_start", F.col("s").alias("gap_end")))


def periods(df: DataFrame, keys: list[str], start: str, end: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """keys, period_start, period_end: the maximal stretches covered without a gap. Null and empty cases as for gaps()."""
    islands, _, runs = _merged(_spans(df, keys, start, end), keys, shard_rows)
    border = F.col("prev_e").isNull() | F.col("next_s").isNull()
    ends = islands.filter(border).select(*keys, "s", "e")
    if runs is not None:
        ends = ends.unionByName(runs)
    stitched = _islands(ends.groupBy(*keys, "s").agg(F.max("e").alias("e")), keys)
    return islands.filter(~border).select(*keys, "s", "e").unionByName(stitched).withColumnsRenamed({"s": "period_start", "e": "period_end"})

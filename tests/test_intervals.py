from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memspark.operators.intervals import _merged, gaps, periods

SCHEMA = "k string, a long, b long, s string, e string"


def brute(rows):
    by = defaultdict(set)
    for k, a, b in rows:
        if a is not None and b is not None and b > a:
            by[k].update(range(a, b))
    holes, runs = set(), set()
    for k, at in by.items():
        start = before = min(at)
        for x in sorted(at)[1:]:
            if x > before + 1:
                runs.add((k, start, before + 1))
                holes.add((k, before + 1, x))
                start = x
            before = x
        runs.add((k, start, before + 1))
    return holes, runs


def check(spark, rows, shard_rows):
    # the clashing names s and e must not matter
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    holes, runs = brute(rows)
    got = [tuple(r) for r in gaps(df, ["k"], "a", "b", shard_rows).collect()]
    assert sorted(got, key=str) == sorted(holes, key=str)
    got = [tuple(r) for r in periods(df, ["k"], "a", "b", shard_rows).collect()]
    assert sorted(got, key=str) == sorted(runs, key=str)


BOUND = st.one_of(st.none(), st.integers(0, 60))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(st.sampled_from(["x", "y", None]), BOUND, BOUND), max_size=25), shard_rows=st.sampled_from([1, 2, 5, 100]))
def test_against_instants(spark, rows, shard_rows):
    check(spark, rows, shard_rows)


@pytest.mark.parametrize("shard_rows", [2, 1000])
def test_nested_touching_repeated(spark, shard_rows):
    rows = [("x", 0, 50), ("x", 3, 4), ("x", 50, 52), ("x", 55, 56), ("x", 55, 56), ("x", 9, 2), ("x", 7, 7), ("y", 1, 2), ("y", 4, 9), ("y", 20, 21)]
    check(spark, rows, shard_rows)


def test_long_interval_covers_whole_shards(spark):
    check(spark, [("x", 0, 90)] + [("x", i, i + 1) for i in range(0, 100, 2)], 3)


def test_open_intervals_make_few_rows(spark):
    """20,000 intervals without end over 100 shards: no row per covered shard."""
    n = 20_000
    df = spark.range(n).select((F.col("id") % 500).cast("string").alias("k"), (F.col("id") * 7).alias("s"), F.lit(2**62).alias("e"))
    islands, blocks, runs = _merged(df, ["k"], n // 100)
    assert islands.count() + blocks.count() + runs.count() <= 2 * n
    assert runs.count() <= 500 and "Generate" not in runs._jdf.queryExecution().toString()
    assert periods(df.withColumnsRenamed({"s": "a", "e": "b"}), ["k"], "a", "b", n // 100).count() == 500


def test_empty(spark):
    check(spark, [], 2)

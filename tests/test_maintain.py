from datetime import datetime

import pytest

from memspark.jobs.maintain import JOBS, run
from memspark.operators.metrics import hit_at_k, nearest_rank
from memspark.operators.state import merged_maps


def test_all_jobs_run_and_write(spark, tmp_path):
    done = run(spark, "/root/testdata/sf0.001", str(tmp_path), [*JOBS, "forget"], datetime(2026, 6, 1))
    assert list(done) == list(JOBS)
    for name, parts in done.items():
        for part in parts:
            assert spark.read.parquet(f"{tmp_path}/{name}/{part}").columns
    with pytest.raises(ValueError, match="no such"):
        run(spark, "x", "y", ["other"], datetime(2026, 1, 1))


def test_metrics(spark):
    gold = spark.createDataFrame([("q1", "a", "x"), ("q1", "b", "x"), ("q2", "c", "x"), ("q3", "d", "y")], "query string, key string, kind string")
    found = spark.createDataFrame([("q1", "b", 2), ("q2", "c", 9), ("q9", "a", 1)], "query string, key string, rank int")
    assert {r.kind: (r.n, r.hits, r.rate) for r in hit_at_k(found, gold, 5, ["kind"]).collect()} == {"x": (2, 1, 0.5), "y": (1, 0, 0.0)}
    row = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double").agg(*nearest_rank("v", 0.5, 0.99)).first()
    assert (row.p50, row.p99) == (50.0, 99.0)


def test_three_way_merge(spark):
    rows = [({"a": "1", "b": "1", "c": "1"}, {"a": "2", "b": "1", "d": "5"}, {"a": "3", "b": "4", "c": "1"}), (None, {"x": "1"}, None)]
    df = spark.createDataFrame(rows, "base map<string,string>, ours map<string,string>, theirs map<string,string>")
    got = [r.m for r in df.select(merged_maps("base", "ours", "theirs").alias("m")).collect()]
    assert got == [{"a": "3", "b": "4", "d": "5"}, {"x": "1"}]
    assert df.select(merged_maps("base", "ours", "theirs", "ours").alias("m")).first().m["a"] == "2"

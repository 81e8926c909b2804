from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memspark.operators import causal, fusion, graph, search, spatial, state, temporal
from memspark.scope import ScopeFilter, cross_project_scope, parse_scope, project_scope, scope_path, tenant_scope

D = datetime


@pytest.fixture(scope="module")
def triples(spark):
    rows = [
        ("t1", "e1", "knows", "e2", None, "global", D(2025, 1, 1), None, None, "semantic"),
        ("t2", "e1", "works_at", None, "CompanyX", "global", D(2025, 1, 1), D(2025, 4, 1), None, "semantic"),
        ("t3", "e1", "works_at", None, "CompanyY", "global", D(2025, 4, 1), None, None, "semantic"),
        ("t4", "e2", "reviewed", None, "PR-1", "project:a", D(2025, 6, 15), None, "t3", "semantic"),
        ("t5", "e3", "status", None, "active", "project:a", D(2025, 6, 1), None, "t4", "project_state"),
        ("t6", "e2", "knows", "e4", None, "global", D(2025, 1, 2), None, "t4", "causal"),
        ("t7", "e4", "knows", "e1", None, "project:b", D(2025, 1, 3), None, "t9", "semantic"),
        ("t8", "e4", "knows", "e4", None, "global", D(2025, 1, 4), None, None, "semantic"),
        ("t9", "e4", "knows", "e5", None, "global", D(2025, 1, 5), D(2025, 2, 1), "t7", "semantic"),
        ("t5", "e3", "status", None, "active", "project:a", D(2025, 6, 1), None, "t4", "project_state"),
    ]
    df = spark.createDataFrame(rows, "id string, subject_id string, predicate string, object_id string, object_value string, scope string, valid_from timestamp_ntz, valid_to timestamp_ntz, predecessor_id string, relation_type string")
    return df.withColumn("confidence", F.lit(0.5))


def ids(df, c="id"):
    return [r[c] for r in df.collect()]


def test_scopes(spark):
    names = ["global", "project:a", "project:b", "tenant:t", None, "other", "project:"]
    df = spark.createDataFrame([(n,) for n in names], "scope string")
    keep = lambda f: ids(df.filter(f.column()), "scope")
    assert keep(project_scope("a")) == ["global", "project:a"]
    assert keep(cross_project_scope(False)) == ["project:a", "project:b", "project:"]
    assert keep(ScopeFilter(project="a", all_projects=True, include_global=False)) == ["project:a", "project:b", "project:"]
    assert keep(tenant_scope("t", False)) == ["tenant:t"] and keep(ScopeFilter(include_global=False)) == []
    got = {r.scope: (r.s.kind, r.s.name) for r in df.select("scope", parse_scope(F.col("scope")).alias("s")).collect()}
    assert got == {"global": ("global", None), "project:a": ("project", "a"), "project:b": ("project", "b"), "tenant:t": ("tenant", "t"), None: (None, None), "other": (None, None), "project:": (None, None)}
    assert scope_path("project", "a") == "project:a" and scope_path("global") == "global"
    with pytest.raises(ValueError, match="no scope"):
        scope_path("project")


def test_temporal(triples, spark):
    end = D(2025, 4, 1)
    assert "t2" not in ids(temporal.query_at_time(triples, end)) and "t3" in ids(temporal.query_at_time(triples, end))
    assert {"t2", "t3"} <= set(ids(temporal.query_in_range(triples, end, end)))
    assert ids(temporal.query_in_range(triples, D(2025, 1, 1), end, limit=2)) == ["t1", "t2"]
    with pytest.raises(ValueError, match="range"):
        temporal.query_in_range(triples, end, D(2025, 1, 1))
    line = temporal.timeline(triples, spark.createDataFrame([("e4",)], "id string"))
    assert sorted((r.role, r.id) for r in line.collect()) == [("object", "t6"), ("object", "t8"), ("subject", "t7"), ("subject", "t8"), ("subject", "t9")]
    with pytest.raises(ValueError, match="role"):
        temporal.timeline(triples, triples, False, False)
    now = D(2026, 1, 1)
    assert temporal.fold_range(None, None, end, now) == (now, end) and temporal.fold_range(end, None, None, now) == (end, end) and temporal.fold_range(None, None, None, now) is None


def test_state(triples):
    rows = state.superseded(triples).collect()
    assert [(r.id, r.closed_at, r.predecessor) for r in rows] == [("t5", None, None)]
    assert [(r.id, r.object_value) for r in state.current_state(triples).collect()] == [("t5", "active")]
    with pytest.raises(ValueError, match="order"):
        state.current_state(triples, "other")


def test_late_arrival_wins_by_arrival_only(spark):
    rows = [("a1", "project:p", "s", "k", None, "old", D(2025, 2, 1), 0.5, "config"), ("a2", "project:p", "s", "k", None, "new", D(2025, 1, 1), 0.5, "config")]
    df = spark.createDataFrame(rows, "id string, scope string, subject_id string, predicate string, object_id string, object_value string, valid_from timestamp, confidence double, relation_type string")
    assert state.current_state(df).first().object_value == "new" and state.current_state(df, "event_time").first().object_value == "old"
    assert {(r.id, r.closed_at, r.predecessor) for r in state.superseded(df).collect()} == {("a1", D(2025, 1, 1), None), ("a2", None, "a1")}


def test_spatial(spark):
    rows = [("l1", "beijing", (116.4074, 39.9042), "global"), ("l2", "beijing.tiananmen", (116.3974, 39.9162), "global"), ("l3", "beijing2", (116.3104, 39.9912), "global"), ("l4", "shanghai", (121.4737, 31.2304), "global"), ("l5", "beijing.x", None, "project:a"), ("l6", None, (500.0, 39.9), None)]
    df = spark.createDataFrame(rows, "id string, path string, coordinates struct<lng double, lat double>, scope string")
    assert ids(spatial.query_in_area(df, 116.4074, 39.9042, 2000)) == ["l1", "l2"]
    assert ids(spatial.query_in_area(df, 116.4074, 39.9042, 100_000)) == ["l1", "l2", "l3"]
    assert ids(spatial.query_in_location(df, "beijing")) == ["l1", "l2", "l5"]
    assert ids(spatial.query_in_location(df, "beijing", False)) == ["l1"]


def test_graph(triples, spark):
    starts = spark.createDataFrame([("e1",)], "id string")
    assert sorted((r.node, r.depth) for r in graph.n_degree(triples, starts, 3).collect()) == [("e2", 1), ("e4", 2)]
    assert sorted(r.node for r in graph.n_degree(triples, starts, 3, relation_types=["semantic"]).collect()) == ["e2"]
    way = [(r.position, r.node, r.triple) for r in graph.shortest_path(triples, "e1", "e4").collect()]
    assert way == [(0, "e1", None), (1, "e2", "t1"), (2, "e4", "t6")]
    assert graph.shortest_path(triples, "e1", "e5").count() == 0 and graph.shortest_path(triples, "e1", "e4", 1).count() == 0
    assert [(r.node, r.triple) for r in graph.shortest_path(triples, "e1", "e1").collect()] == [("e1", None)]


def test_causal(triples):
    got = lambda *a, **k: sorted((r.direction, r.id, r.depth) for r in causal.trace(triples, *a, **k).collect())
    assert got("t5") == [("backward", "t3", 2), ("backward", "t4", 1), ("backward", "t5", 0)]
    assert got("t3", "forward") == [("forward", "t4", 1), ("forward", "t5", 2), ("forward", "t6", 2)]
    assert got("t7", "both") == [("backward", "t7", 0), ("backward", "t9", 1), ("forward", "t9", 1)]
    assert got("t3", scope=F.col("scope") == "project:a") == [] and got("none") == []
    with pytest.raises(ValueError, match="direction"):
        causal.trace(triples, "t1", "up")
    assert causal.would_cycle(triples, "t3", "t5") and not causal.would_cycle(triples, "t8", "t5") and causal.would_cycle(triples, "x", "x")
    assert {r.id: r.root_id for r in causal.chains(triples).collect()}["t9"] == "cycle"


def test_bm25_parity(spark):
    texts = ["animal shelter visit", "the shelter is full of shelter dogs", "nothing here", "Shelter Me", "动物收容所做志愿者", "École", "xy"]
    df = spark.createDataFrame([(t, t, "x") for t in texts], "id string, content string, score string")
    got = lambda q: [(r.id, round(r.score, 6)) for r in search.bm25(df, "id", "content", q).collect()]
    assert got("shelter") == [("Shelter Me", -0.285294), ("the shelter is full of shelter dogs", -0.224222), ("animal shelter visit", -0.202121)]
    assert got("animal shelter visit")[0] == ("animal shelter visit", -2.560746)
    assert got("动物收容所") == [("动物收容所做志愿者", -1.736031)]
    assert got("a b") == [] and search.query_terms("a bb the the The") == ["the", "The"] and len(search.query_terms(" ".join(f"word{i}" for i in range(50)))) == 16
    overlap = spark.createDataFrame([("aaaa",), ("aa",), ("a",), ("",)], "t string").select(search.occurrences(F.col("t"), "aa").alias("n"))
    assert [r.n for r in overlap.collect()] == [3, 1, 0, 0]


def test_like(spark):
    df = spark.createDataFrame([("A_b",), ("aXB",), ("É",), (None,)], "t string")
    hit = lambda k: [r.t for r in df.filter(search.keyword_like(F.col("t"), k)).collect()]
    assert hit("a_b") == ["A_b", "aXB"] and hit("é") == [] and hit("É") == ["É"]


def test_knn(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], "global"), (2, [3.0, 4.0], "project:a"), (3, None, "global"), (4, [1.0], "global"), (5, [1.0, 0.0], "project:a"), (1, [0.0, 0.0], "global")], "k int, v array<float>, scope string")
    assert [(r.k, r.distance) for r in search.knn(df, "k", "v", [0.0, 0.0], 2).collect()] == [(1, 0.0), (5, 1.0)]
    a = F.col("scope") == "project:a"
    assert ids(search.knn(df, "k", "v", [0.0, 0.0], 2, a), "k") == [5, 2] and ids(search.knn(df, "k", "v", [0.0, 0.0], 1, a, oversample=2), "k") == [5]
    with pytest.raises(ValueError, match="k must"):
        search.knn(df, "k", "v", [0.0], 0)


def test_rrf_and_fill(spark):
    lists = [spark.createDataFrame([(k, i + 1, n) for i, k in enumerate(x)], "key string, rank int, ranking string") for n, x in (("one", "abc"), ("two", "bad"))]
    got = [(r.key, r.score, r.found_in) for r in fusion.rrf(lists).collect()]
    assert [k for k, *_ in got] == ["a", "b", "c", "d"] and got[0][1] == got[1][1] == 1 / 61 + 1 / 62 and got[2][2] == ["one"]
    items = spark.createDataFrame([(1, 1, "x", 5), (1, 2, "y", 9), (1, 3, "z", 2), (2, 1, "w", 50)], "g int, place int, k string, tokens int")
    got = {r.g: (r["keys"], r.used, r.truncated) for r in fusion.greedy_fill(items, ["g"], ["place"], "tokens", "k", 10).collect()}
    assert got == {1: (["x", "z"], 7, True), 2: ([], 0, True)}
    n = spark.createDataFrame([("",), (None,), ("abc",), ("a" * 41,)], "t string").select(fusion.token_estimate(F.col("t")).alias("n"))
    assert [r.n for r in n.collect()] == [0, 0, 1, 10]
    scaled = fusion.rerank_scale(spark.createDataFrame([(1, 1, 5.0), (1, 2, 3.0), (1, 3, 9.0)], "g int, rank int, s double"), ["g"], "s", "rank", 2).collect()
    assert {r.rank: r.scaled for r in scaled} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_empty_tables(triples, spark):
    none = triples.limit(0)
    starts = spark.createDataFrame([("e1",)], "id string")
    assert graph.n_degree(none, starts).count() == causal.trace(none, "t1").count() == temporal.query_at_time(none, D(2025, 1, 1)).count() == state.current_state(none).count() == state.superseded(none).count() == 0
    assert search.bm25(none, "id", "object_value", "some words").count() == 0

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memspark.engine import Memory, Request
from memspark.scope import project_scope
from memspark.sources import importers, sinks
from memspark.sources.stores import Snapshots, audit, with_access
from memspark.streaming import streams

D = datetime


def test_git_log(spark, tmp_path):
    log = tmp_path / "log"
    log.write_text("\x1eh1\x1fAnn\x1fa@x.test\x1f2025-01-01T00:00:00Z\x1ffix it\n\nsrc/a.py\nb.md\n\x1eh2\x1fBob\x1fb@x.test\x1f2025-01-02T00:00:00Z\x1fempty\n\x1ebroken\n")
    got = importers.git_log(spark, str(log)).collect()
    assert [(r.hash, r.message, r.files) for r in got] == [("h1", "fix it", ["src/a.py", "b.md"]), ("h2", "empty", [])]


def test_markdown_and_code(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "r.md").write_text("# Title\nuses Docker\n## Part [x](https://y.test)\n")
    (tmp_path / "empty.md").write_text("")
    rows = {r.path.rsplit("/", 1)[1]: r for r in importers.markdown(spark, str(tmp_path)).collect()}
    assert rows["r.md"].title == "Title" and rows["r.md"].technologies == ["Docker"] and rows["r.md"].links == ["https://y.test"]
    seeds = importers.readme_seeds(spark.createDataFrame([("p", "# Title\nDocker")], "p string, t string"), F.col("p"), "t").collect()
    assert {(r.predicate, r.object_key) for r in seeds} == {("uses_tech", "tech:docker"), ("has_section", "concept:title")}
    code = spark.createDataFrame([("a/m.py", '"""Doc."""\nimport os\nfrom . import x\nclass C: pass\ndef f(): pass\n'), ("b.py", "# head\ndef (:"), ("c.py", None)], "path string, value string")
    got = {r.path: r for r in importers.python_code(code).collect()}
    assert (got["a/m.py"].docstring, got["a/m.py"].classes, got["a/m.py"].functions, got["a/m.py"].imports) == ("Doc.", ["C"], ["f"], [".", "os"])
    assert got["b.py"].docstring == "head" and got["c.py"].classes == []
    assert ("m.C", "class:a-m-py-c") in {(r.object, r.object_key) for r in importers.code_seeds(importers.python_code(code)).collect()}


def test_batches_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("one\ntwo",), ("one\ntwo",), (None,), ("",)], "t string")
    assert importers.text_batch(df, "t").count() == 1
    have = spark.createDataFrame([("s", "k1"), (None, "k3")], "scope string, k string")
    new = spark.createDataFrame([("s", "k1"), ("s", "k2"), ("s", "k2"), (None, "k3")], "scope string, k string")
    assert [tuple(r) for r in importers.new_rows(new, have, ["scope", "k"]).collect()] == [("s", "k2")]
    pack = tmp_path / "pack.json"
    pack.write_text('{"entities": [{"name": "Big Tea", "entity_type": "concept"}], "triples": [{"subject": "a", "predicate": "p", "object_value": "v"}]}')
    e, t = importers.seed_pack(spark, str(pack))
    assert e.first().entity_id == "concept:big-tea" and t.first().object_value == "v"


def test_stores(spark, tmp_path):
    s, now = Snapshots(spark, str(tmp_path / "snap")), D(2026, 1, 1)
    s.save("a", "1", now)
    s.save("a", "2", now + timedelta(hours=1))
    s.save("b", "3", now)
    s.delete("b", now + timedelta(hours=2))
    assert s.load("a", now + timedelta(hours=3)) == "2" and s.load("b", now + timedelta(hours=3)) is None and s.load("a", now + timedelta(days=2)) is None
    s.cleanup(now + timedelta(hours=3))
    assert spark.read.parquet(s.path).count() == 1 and s.load("a", now + timedelta(hours=3)) == "2"
    audit(spark.createDataFrame([("write", "secret")], "action string, content string"), str(tmp_path / "audit"))
    assert "secret" not in str(spark.read.json(str(tmp_path / "audit")).collect())
    f = spark.createDataFrame([("x", 1, D(2025, 1, 1)), ("y", None, None)], "id string, access_count int, last_accessed_at timestamp")
    log = spark.createDataFrame([("x", D(2025, 2, 1)), ("x", D(2025, 3, 1)), ("z", D(2025, 1, 1))], "id string, at timestamp")
    assert {r.id: (r.access_count, r.last_accessed_at) for r in with_access(f, log).collect()} == {"x": (3, D(2025, 3, 1)), "y": (0, None)}


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    rows = [(i, D(2025, 1, 1) + timedelta(minutes=7 * i if i % 10 else 50 * i), i % 3, "error" if i % 4 else "view", 1.0, f'{{"k": {i}}}') for i in range(60)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    path = tmp_path / "events.parquet"
    for part in (rows[:20], rows[20:40], rows[40:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
    batch = spark.read.parquet(str(path))
    stream = streams.files(spark, str(tmp_path), "events")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(streams.drained(streams.sessions(stream))) == key(streams.sessions(batch))
    assert key(streams.drained(streams.fingerprints(stream))) == key(streams.fingerprints(batch))


def test_engine(spark):
    folder = "/root/testdata/sf0.001"
    m = Memory.open(spark, folder)
    f = m.tables["temporal_fragments"].filter("embedding IS NOT NULL").orderBy("id").first()
    start = m.tables["triples"].filter("object_id IS NOT NULL AND valid_to IS NULL").orderBy("id").first().subject_id
    r = Request("vector index stale", f.embedding, D(2025, 1, 1), D(2025, 6, 1), start, None, 5, 600)
    c = m.context(r).collect()
    assert len({x.key for x in c}) == len(c) > 5 and {x.layer for x in c} == {0, 1, 2}
    assert f.id in {x.key for x in c}
    got = m.fill(r).first()
    assert 0 < got.used <= 420 and len(got["keys"]) > 0
    said = m.recall(r, {"triples": m.tables["triples"]}).collect()
    assert [x.key for x in said if not x.text.startswith("[归档] ")] == got["keys"] and all(0 <= x.score <= 1 and len(x.snippet) <= 120 for x in said)
    for mode, to in (("neighbours", None), ("causes", None), ("path", start)):
        m.graph_query(mode, start, to).collect()
    with pytest.raises(ValueError, match="mode"):
        m.graph_query("sideways", start)
    scoped = Request("vector index", scope=project_scope("nobody", False))
    assert m.recall(scoped).count() == 0
    name = m.tables["entities"].orderBy("id").first()
    assert m.resolve(name.entity_id).first().entity_id == name.entity_id


@pytest.mark.parametrize(
    ("ask", "wanted"),
    [
        (lambda m: m.at_time(D(2025, 6, 1), scope=project_scope("harborlight")), ["valid_from", "valid_to", "scope"]),
        (lambda m: m.in_range(D(2025, 3, 1), D(2025, 4, 1), "entities", project_scope("harborlight")), ["valid_from", "valid_to", "scope"]),
        (lambda m: m.in_area(1.0, 2.0, 1e5, project_scope("harborlight")), ["coordinates.lng", "coordinates.lat", "scope"]),
        (lambda m: m.in_location("a.b", scope=project_scope("harborlight")), ["path", "scope"]),
        (lambda m: m.browse(scope=project_scope("harborlight")), ["scope"]),
        (lambda m: m.get("triples", "x"), ["id"]),
    ],
    ids=["at_time", "in_range", "in_area", "in_location", "browse", "get"],
)
def test_filters_reach_the_scan(spark, ask, wanted):
    plan = ask(Memory.open(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = [x for x in plan.split("\n") if x.startswith("PushedFilters")]
    assert pushed and all(any(w in x for x in pushed) for w in wanted), pushed


def test_sinks_and_layout(spark, tmp_path):
    rows = [(str(i), f"l{i % 3}", "global", f"a.b{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "id string, location_id string, scope string, path string")
    path = str(tmp_path / "locations")
    sinks.laid_out("locations", df.limit(0)).write.parquet(path)
    for _ in range(2):
        sinks.sink("locations", df, path)
    assert sorted(r.location_id for r in spark.read.parquet(path).collect()) == ["l0", "l1", "l2"]
    links = spark.createDataFrame([("1", "e", None, None), ("2", None, None, "f"), ("3", None, "t", None), ("4", None, None, None)], "id string, entity_id string, triple_id string, fragment_id string")
    gone = spark.createDataFrame([("e",), ("f",)], "id string")
    assert sorted(r.id for r in sinks.without_vectors(links, gone).collect()) == ["3", "4"]
    with pytest.raises(ValueError, match="table"):
        sinks.appended("nothing", df, df)


def test_sessions_drop_their_state(spark):
    """In append mode only sessions that the watermark has passed come out."""
    folder = "/root/testdata/sf0.001"
    made = streams.drained(streams.sessions(streams.files(spark, folder, "events"), late="1 hour"), "append")
    last = spark.read.parquet(f"{folder}/events.parquet").agg(F.max("ts")).first()[0]
    assert made.count() > 0 and made.agg(F.max("end_ts")).first()[0].replace(tzinfo=None) <= last

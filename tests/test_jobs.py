import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memspark.functions import masking, text, vector
from memspark.jobs import cloning, communities, memory, quality

D = datetime
NOW = D(2026, 1, 1)
FRAGMENT = "id string, fragment_id string, time_start timestamp, time_end timestamp, location_id string, content string, entities array<string>, relations array<string>, scope string, layer string, importance double, access_count int, last_accessed_at timestamp, created_at timestamp, updated_at timestamp"
TRIPLE = "id string, subject_id string, predicate string, object_id string, object_value string, scope string, valid_from timestamp, valid_to timestamp, predecessor_id string, confidence double, relation_type string"


def fragment(i, content="text", entities=(), scope="project:a", layer="L1", importance=0.5, accesses=0, updated=D(2025, 12, 31), end=None, created=D(2025, 1, 1), fid=None, place=None):
    return (i, fid or f"f-{i}", D(2025, 1, 1), end, place, content, list(entities), [], scope, layer, importance, accesses, None, created, updated)


def triple(i, s, p, o=None, v=None, scope="project:a", a=D(2025, 1, 1), b=None, prior=None, confidence=0.5, kind="semantic"):
    return (i, s, p, o, v, scope, a, b, prior, confidence, kind)


def frags(spark, *rows):
    return spark.createDataFrame(list(rows), FRAGMENT)


def trips(spark, *rows):
    return spark.createDataFrame(list(rows), TRIPLE)


def test_consolidate(spark):
    df = frags(spark, fragment("1", "one" * 30, ["b", "a"], accesses=2), fragment("2", "two", ["a", "b"], importance=0.8), fragment("3", "solo", ["c"]), fragment("4", "x", layer="L2"))
    new, gone = memory.consolidate(df)
    r = new.first()
    assert new.count() == 1 and (r.entities, r.importance, r.access_count, r.members, r.layer) == (["a", "b"], 0.8, 2, 2, "L2")
    assert r.content == "【聚合】a,b:2 条记忆聚合 — " + ("one" * 30)[:50] + "; two"
    assert sorted((x.group_id == r.id, x.position, x.id) for x in gone.collect()) == [(True, 0, "1"), (True, 1, "2")]
    assert memory.consolidate(df, most_text=10)[0].first().content is None
    assert memory.consolidate(df.join(gone, "id", "left_anti"))[0].count() == 0


def test_forget(spark):
    df = frags(spark, fragment("p", importance=0.95, end=D(2025, 2, 1)), fragment("e", end=D(2025, 2, 1)), fragment("d", importance=0.3, updated=D(2025, 9, 1)), fragment("h", importance=0.3, updated=D(2025, 11, 1), accesses=99), fragment("n", importance=None))
    assert {r.id: r.verdict for r in memory.forget(df, NOW).collect()} == {"p": "protected", "e": "expired", "d": "decayed", "h": "decayed" if 0.3 * 0.5 ** (61 / 30) * 3 < 0.1 else "kept", "n": "decayed"}
    many = frags(spark, *[fragment(f"{i:02}", importance=i / 100) for i in range(20)], fragment("pp", importance=0.99))
    assert sorted(r.id for r in memory.over_capacity(many, NOW, 18).collect()) == ["00", "01", "02"]


def test_summaries(spark):
    long = "First sentence! " + "word " * 200
    df = frags(spark, fragment("1", long), fragment("2", "short"), fragment("3", long, fid="has"), fragment("4", "s", fid="has:summary"))
    got = memory.summarize(df).collect()
    assert [(r.fragment_id, r.content) for r in got] == [("f-1:summary", f"【摘要】First sentence!…(原文共 {len(long)} 字)")]
    cut = spark.createDataFrame([("x" * 130,), ("",), (None,), ("。" + "y" * 130,)], "t string").select(text.rule_summary(F.col("t")).alias("s"))
    assert [r.s for r in cut.collect()] == ["x" * 120 + "…(原文共 130 字)", "", None, "。" + "y" * 119 + "…(原文共 131 字)"]


def test_dedup_against_all_pairs(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randrange(3, 9))) for _ in range(400)]
    base = [[r.choice(words) for _ in range(12)] for _ in range(60)]
    texts = [" ".join(b) for b in base] + [" ".join(r.choice(words) if r.random() < 0.08 else w for w in b) for b in base[:40] for _ in range(2)]
    rows = [fragment(f"{i:03}", t, scope="project:a" if i % 7 else "project:b") for i, t in enumerate(texts)]
    df = frags(spark, *rows, fragment("999", "short"), fragment("998", texts[0].upper(), scope="project:b"))
    got = {(x.a, x.b) for x in memory.near_duplicates(df).collect()}

    def grams(t):
        t = "".join(c for c in t.lower() if c.isalnum())
        return {t[i : i + 2] for i in range(len(t) - 1)}

    sets = {row[0]: (row[8], grams(row[5])) for row in rows}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) / len(sets[a][1] | sets[b][1]) >= 0.7}
    assert got <= want

    def groups(pairs):
        up = {}

        def top(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in pairs:
            x, y = sorted((top(a), top(b)))
            up[y] = x
        return {x: top(x) for x in up}

    exact, found = groups(want), {x.id: x.group for x in memory.dedup_members(df).collect()}
    assert sum(found.get(x) == g for x, g in exact.items()) >= 0.95 * len(exact) > 0


@pytest.mark.parametrize("block", [1 << 18, 20000])
def test_dedup_of_a_hot_template_is_exact(spark, block):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 8)))
    texts = []
    for _ in range(200):
        free = [word() for _ in range(8)]
        texts.append(free)
        texts.append([word() if i in (1, 6) else w for i, w in enumerate(free)])
    texts = [f"status report of {' '.join(t)} was written and filed by the team" for t in texts]
    rows = [fragment(f"{i:04}", t, scope="project:a") for i, t in enumerate(texts)]
    got = {(x.a, x.b): x.jaccard for x in memory.near_duplicates(frags(spark, *rows), block=block).collect()}
    flat = [t.replace(" ", "") for t in texts]
    sets = [{t[i : i + 2] for i in range(len(t) - 1)} for t in flat]
    score = {(a, b): len(x & y) / len(x | y) for b, y in enumerate(sets) for a, x in enumerate(sets[:b])}
    want = {(f"{a:04}", f"{b:04}"): s for (a, b), s in score.items() if s >= 0.7 and flat[a] != flat[b]}
    assert len(want) > 50 and got == want


def test_dedup_absorbs(spark):
    t = "the same memory told in the very same words"
    df = frags(spark, fragment("2", t, ["e1", "e2"], accesses=3, created=D(2025, 1, 2)), fragment("1", t + "!", ["e2", "e3"], accesses=4, created=D(2025, 1, 5)), fragment("3", t, scope="project:b"), fragment("4", t, importance=0.95), fragment("5", "tiny"))
    r = memory.dedup(df).collect()
    assert [(x.survivor, x.members, x.access_count, x.entities) for x in r] == [("2", 2, 7, ["e1", "e2", "e3"])]


def test_archive_and_restore(spark):
    df = trips(spark, triple("1", "s", "p", v="a", b=D(2024, 1, 1)), triple("2", "s", "p", v="b"), triple("3", "s", "p", v="c", b=D(2025, 12, 1)))
    hot, cold = quality.archive(df, quality.cold_triples(df, NOW), NOW)
    assert [r.id for r in cold.collect()] == ["1"] and quality.archive(hot, quality.cold_triples(hot, NOW), NOW)[1].count() == 0
    hot, cold = quality.restore(hot, cold, F.col("id") == "1")
    assert sorted(r.id for r in hot.collect()) == ["1", "2", "3"] and cold.count() == 0
    f = frags(spark, fragment("e", end=D(2025, 1, 1)), fragment("s", updated=D(2025, 1, 1), importance=0.2), fragment("i", updated=D(2025, 1, 1), importance=0.6), fragment("n", updated=D(2025, 1, 1), importance=None))
    assert sorted(r.id for r in f.filter(quality.cold_fragments(f, NOW)).collect()) == ["e", "s"]


CASES = [
    ("value", [triple("1", "s", "color", v="red"), triple("2", "s", "color", v="blue")], {"value"}),
    ("same", [triple("1", "s", "color", v="red"), triple("2", "s", "color", v="red")], set()),
    ("plain", [triple("1", "s", "likes", v="tea"), triple("2", "s", "likes", v="rice")], set()),
    ("state", [triple("1", "s", "owner", v="ann", kind="config"), triple("2", "s", "owner", v="bob")], {"value"}),
    ("numeric", [triple("1", "s", "people", v="3 人"), triple("2", "s", "people", v="5 人")], {"numeric"}),
    ("near", [triple("1", "s", "people", v="100"), triple("2", "s", "people", v="105")], set()),
    ("zero", [triple("1", "s", "n", v="0"), triple("2", "s", "n", v="0.0")], set()),
    ("signs", [triple("1", "s", "n", v="-5"), triple("2", "s", "n", v="5")], {"numeric"}),
    ("mixed", [triple("1", "s", "status", v="3"), triple("2", "s", "status", v="open")], {"value"}),
    ("causal", [triple("1", "s", "causes", v="x", kind="causal"), triple("2", "s", "causes", v="y", kind="causal")], {"causal"}),
    ("scopes", [triple("1", "s", "color", v="red"), triple("2", "s", "color", v="blue", scope="global")], set()),
    ("closed", [triple("1", "s", "color", v="red", b=D(2025, 6, 1)), triple("2", "s", "color", v="blue", a=D(2025, 3, 1))], {"temporal"}),
    ("after", [triple("1", "s", "color", v="red", b=D(2025, 3, 1)), triple("2", "s", "color", v="blue", a=D(2025, 3, 1))], set()),
    ("restated", [triple("1", "s", "color", v="red", b=D(2025, 6, 1)), triple("2", "s", "color", v="red", a=D(2025, 3, 1))], set()),
]


def test_contradictions(spark):
    rows = [(f"{n}-{t[0]}", f"{n}-{t[1]}", *t[2:]) for n, ts, _ in CASES for t in ts]
    df = trips(spark, *rows)
    got = {n: set() for n, *_ in CASES}
    for r in quality.contradictions(df).collect():
        got[r.id.split("-")[0]].add(r.kind)
    for r in quality.temporal_contradictions(df).collect():
        got[r.id.split("-")[0]].add("temporal")
    assert got == {n: k for n, _, k in CASES}
    back = trips(spark, triple("1", "a", "causes", "b"), triple("2", "b", "causes", "a"), triple("3", "a", "causes", "c"), triple("4", "c", "uses", "a"))
    assert [(r.a, r.b) for r in quality.inverse_causes(back).collect()] == [("1", "2")]


def test_promotion(spark):
    entities = spark.createDataFrame([("i1", "tech:x", "X", "project:a"), ("i2", "tech:x", "X", "project:b")], "id string, entity_id string, name string, scope string")
    rows = [triple("1", "i1", "uses", v="Big  Tea"), triple("2", "i2", "uses", v="big tea ", scope="project:b", confidence=0.9), triple("3", "tech:x", "uses", v="BIG TEA", scope="project:c"), triple("4", "z", "uses", v="q"), triple("5", "z", "uses", v="q", scope="project:b"), triple("6", "tech:x", "uses", v="big tea", scope="project:d", b=NOW)]
    df = trips(spark, *rows)
    got = quality.promote(df, entities).collect()
    assert [(r.source, r.subject_key, r.predicate, r.object_key) for r in got] == [("2", "tech:x", "uses", "value:big tea")]
    done = df.unionByName(trips(spark, triple("g", "tech:x", "uses", v="big tea", scope="global")))
    assert quality.promote(done, entities).count() == 0


def store(spark):
    entities = spark.createDataFrame([("e1", "k:1", "person", "A", "project:a", D(2025, 1, 1), None), ("e2", "k:2", "object", "B", "project:a", D(2025, 1, 1), None), ("e3", "k:2", "object", "B", "project:b", D(2025, 1, 1), None)], "id string, entity_id string, entity_type string, name string, scope string, valid_from timestamp, valid_to timestamp")
    t = trips(spark, triple("t1", "e1", "uses", "e2"), triple("t2", "e1", "uses", "e2"), triple("t3", "e1", "likes", "gone"), triple("t4", "e1", "notes", v="x", prior="t1"))
    locations = spark.createDataFrame([("l1", "loc:1", None, "project:a", None), ("l2", "loc:2", "l1", "project:a", None)], "id string, location_id string, parent_id string, scope string, valid_to timestamp")
    f = frags(spark, fragment("f1", entities=["e2", "gone", "e1"], place="l2"), fragment("f3", layer="L3"))
    return {"entities": entities, "triples": t, "temporal_fragments": f, "locations": locations}


def test_clone_twice_and_package(spark, tmp_path):
    tables = store(spark)
    new = cloning.clone(tables, "project:a", "project:b")
    n = {k: df.count() for k, df in new.items()}
    assert n == {"entities": 1, "triples": 2, "temporal_fragments": 1, "locations": 2}
    by = {r.source_id: r for r in new["triples"].collect()}
    assert by["t1"].object_id == "e3" and by["t4"].predecessor_id == by["t1"].id
    f = new["temporal_fragments"].first()
    assert f.entities[0] == "e3" and len(f.entities) == 2 and f.location_id in {r.id for r in new["locations"].collect()}
    both = {k: tables[k].unionByName(new[k].drop("source_id")) for k in tables}
    assert {k: df.count() for k, df in cloning.clone(both, "project:a", "project:b").items()} == dict.fromkeys(n, 0)
    path = f"file://{tmp_path}/pack"
    cloning.export_package(tables, "project:a", path)
    scope, back = cloning.import_package(spark, path, tables)
    assert scope == "project:a" and {k: df.count() for k, df in back.items()} == {"entities": 2, "triples": 4, "temporal_fragments": 2, "locations": 2}
    assert sorted(map(str, back["triples"].collect())) == sorted(map(str, tables["triples"].collect()))
    spark.createDataFrame([("9.0", "x")], "version string, scope string").write.mode("overwrite").json(f"{path}/manifest")
    with pytest.raises(ValueError, match="version"):
        cloning.import_package(spark, path, tables)


def test_communities(spark):
    two = [("project:p", f"{g}{i}", f"{g}{j}", 3) for g in "ab" for i in range(5) for j in range(i + 1, 5)] + [("project:p", "a0", "b0", 1), ("global", "x", "y", 2)]
    edges = spark.createDataFrame(two, "universe string, a string, b string, weight long")
    at = communities.communities(edges).collect()
    labels = {r.node: r.label for r in at}
    assert {r.universe for r in at if r.node in "xy"} == {"global"}
    good = {r.universe: r.modularity for r in communities.modularity(edges, spark.createDataFrame(at)).collect()}
    assert good["project:p"] > 0.45
    assert len({labels[f"a{i}"] for i in range(5)}) == len({labels[f"b{i}"] for i in range(5)}) == 1 and labels["a0"] != labels["b0"]
    names = spark.createDataFrame([("a0", "Alpha", "project:p")], "id string, name string, scope string")
    made = communities.summaries(spark.createDataFrame(at), edges, names)
    assert sorted((r.universe, r.size, r.inner_edges) for r in made.collect()) == [("global", 2, 1), ("project:p", 5, 10), ("project:p", 5, 10)]
    assert sorted((r.action) for r in communities.refresh(made.limit(2), made).collect()) == ["insert"] and communities.refresh(made, made).count() == 0


def test_constraints(spark):
    tables = store(spark)
    bad = trips(spark, triple("x", "s", "p", scope="nowhere", confidence=2.0, kind="odd")).withColumn("certainty", F.lit("exact")).withColumn("causal_level", F.lit(-1))
    vectors = spark.createDataFrame([(None, None, None, 2, [1.0])], "entity_id string, triple_id string, fragment_id string, dimension int, embedding array<float>")
    places = spark.createDataFrame([((200.0, 0.0),), (None,)], "coordinates struct<lng double, lat double>")
    got = {r.check: r.n for r in quality.violations(tables["entities"], bad, tables["temporal_fragments"], places, vectors).collect()}
    assert {k for k, n in got.items() if n} == {"triples.relation_type", "triples.confidence", "triples.causal_level", "triples.object", "triples.scope", "locations.longitude", "vector_links.owner", "vector_links.dimension"}


def test_masks(spark):
    t = "mail ann@host.org, 13800138000, 11010519491231002X, 4111111111111111, 4111111111111112, 192.168.1.1, 999.1.1.1, sk-abcdefghijklmnop1234"
    df = spark.createDataFrame([(t,), (None,), ("",)], "t string")
    got = [r.t for r in df.select(masking.masked(F.col("t")).alias("t")).collect()]
    assert got == ["mail [EMAIL], [PHONE], [ID_CARD], [BANK_CARD], 4111111111111112, [IPV4], 999.1.1.1, [API_KEY]", None, ""]
    assert df.select(masking.masked(F.col("t"), "mask").alias("t")).first().t == "mail a***@host.org, 138****8000, 1101************2X, 4111********1111, 4111111111111112, 192.*.*.*, 999.1.1.1, sk-***"
    assert "[EMAIL:" in df.select(masking.masked(F.col("t"), "hash").alias("t")).first().t
    assert df.select(masking.masked(F.col("t"), "redact", ("api_key", "email", "phone")).alias("t")).first().t.startswith("mail [EMAIL], [PHONE], 110105")
    with pytest.raises(ValueError, match="masking"):
        masking.masked(F.col("t"), "redact", ("ip",))


def test_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.5, 1.0]), (2, [3.0, 3.0]), (3, None), (4, []), (5, [float("nan"), 1.0])], "k int, v array<float>")
    got = {r.k: (r.q.codes if r.q else None, r.b) for r in df.select("k", vector.quantize(F.col("v")).alias("q")).withColumn("b", vector.dequantize(F.col("q"))).collect()}
    assert got[1][0] == [0, 128, 255] and abs(got[1][1][1] - 0.5) < 0.003 and got[2] == ([0, 0], [3.0, 3.0]) and got[3][0] is got[4][0] is got[5][0] is None
    e = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string").select(vector.hash_embedding(F.col("t"), 20).alias("v")).collect()
    assert e[0].v == e[1].v != e[2].v and len(e[0].v) == 20 and abs(sum(x * x for x in e[0].v) - 1) < 1e-5 and e[3].v is None


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(text.normalize_value(lit("  A\t b　C "))) == "a b c" and one(text.entity_key("tech", lit("Node.js 类!"))) == "tech:node-js-类" and one(text.entity_key("x", lit("!!"))) is None
    assert one(text.bigrams(lit("aaab"))) == ["aa", "ab"] and one(text.bigrams(lit("a"))) == ["a"] and one(text.bigrams(lit(""))) == []
    assert one(text.jaccard(F.array(lit("a"), lit("b")), F.array(lit("b")))) == 0.5 and one(text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0
    assert one(text.error_text(lit("Error 12 at\n  Line 7"))) == "error # at line #" and one(text.first_number(lit("about -3.5 or 2"))) == -3.5
    assert one(text.chunks(lit("aa\nbbb\ncc"), 6)) == ["aa\n", "bbb\ncc"] and one(text.chunks(lit(""), 6)) == [] and one(text.chunks(lit("a" * 9 + "\nb"), 4)) == ["a" * 9 + "\n", "b"]
    assert one(text.facts(lit('so: ["a", " b "]'))) == ["a", "b"] and one(text.facts(lit("- one\n2. two\n\n"))) == ["one", "two"]
    assert one(text.headings(lit("# A #\ntext\n### B\n#### no"))) == ["A", "B"] and one(text.technologies(lit("We use k8s, React; not reactive"))) == ["React", "Kubernetes"]
    assert one(text.links(lit("[x](https://a.test/y) [z](ftp://q)"))) == ["https://a.test/y"] and one(text.without_angles(lit("<|end|> <b>"))) == "|end| <b>"

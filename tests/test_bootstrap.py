from memspark.operators.metrics import hits_at
from memspark.sources.bootstrap import resolve_or_create, seeded, unknown

SEEDS = "scope string, subject_key string, predicate string, object_key string, object string"
ENTITIES = "id string, entity_id string, entity_type string, name string, scope string"
TRIPLES = "id string, scope string, subject_id string, predicate string, object_id string, valid_to string"


def test_second_run_adds_nothing(spark):
    seeds = spark.createDataFrame([("project:a", "s", "uses", "tech:x", "X"), ("project:a", "s", "uses", "tech:x", "X"), ("project:a", "s", "uses", None, None), ("project:b", "s", "uses", "tech:x", "x")], SEEDS)
    entities = spark.createDataFrame([("1", "tech:x", "t", "X", "global"), ("2", "s", "t", "S", "project:a"), ("0", "s", "t", "S", None)], ENTITIES)
    triples = spark.createDataFrame([], TRIPLES)
    new, said = seeded(seeds, entities, triples)
    assert [(r.entity_id, r.scope) for r in new.collect()] == [("s", "project:b")]
    rows = said.collect()
    assert sorted((r.scope, r.subject_id == "2", r.object_id) for r in rows) == [("project:a", True, "1"), ("project:b", False, "1")]
    after = spark.createDataFrame([(r.id, r.scope, r.subject_id, r.predicate, r.object_id, None) for r in rows], TRIPLES)
    new, said = seeded(seeds, entities.unionByName(new.select(*entities.columns)), after)
    assert new.count() == 0 and said.count() == 0
    assert resolve_or_create(spark.createDataFrame([], "scope string, entity_id string, entity_type string, name string"), entities)[0].count() == 0


def test_unknown(spark):
    triples = spark.createDataFrame([("1", "project:a", "s", "owner", None, None), ("2", "project:a", "s", "status", None, "2025"), ("3", "global", "s", "owner", None, None), ("4", None, "s", None, None, None)], TRIPLES)
    assert [(r.scope, r.predicate) for r in unknown(triples, ["owner", "status"]).collect()] == [("project:a", "status")]


def test_hits_at_cutoffs(spark):
    found = spark.createDataFrame([("q", "a", 3), ("q", "b", 1), ("r", "c", 1)], "query string, key string, rank int")
    gold = spark.createDataFrame([("q", "a"), ("s", "a")], "query string, key string")
    r = hits_at(found, gold, [1, 3]).first()
    assert (r.n, r.hit_1, r.hit_3) == (2, 0.0, 0.5)

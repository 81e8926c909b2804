"""Queries of the retrieval operators over the tables of a folder."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.operators import causal, fusion, graph, search, spatial, state, temporal
from memspark.operators.prefix import prefix_sum
from memspark.scope import cross_project_scope, global_only_scope, parse_scope, project_scope, tenant_scope
from memspark.tables import cut, micros, table

AT, START, END = datetime(2025, 6, 1), datetime(2025, 3, 1), datetime(2025, 4, 1)
PROJECT, WORDS = "harborlight", "vector index rebuilt 归档搬运"
LNG, LAT, RADIUS_M = -100.0, 35.0, 3_000_000.0


def _t(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """These columns of a table as records: rows of one id are one."""
    return table(spark, folder, name).select("id", *columns).dropDuplicates(["id"])


def _us(df: DataFrame, *columns: str) -> list:
    return [micros(df, c).alias(f"{c}_us") for c in columns]


def temporal_as_of(spark, folder):
    t = table(spark, folder, "triples")
    rows = temporal.query_at_time(t, AT, project_scope(PROJECT).column())
    return rows.select("id", "scope", *_us(t, "valid_from", "valid_to")).distinct()


def temporal_as_of_entities(spark, folder):
    e = table(spark, folder, "entities")
    return temporal.query_at_time(e, AT).select("id", "entity_id", *_us(e, "valid_from")).distinct()


def temporal_range(spark, folder):
    t = table(spark, folder, "triples")
    return temporal.query_in_range(t, START, END, cross_project_scope().column()).select("id", *_us(t, "valid_from", "valid_to")).distinct()


def entity_timeline(spark, folder):
    t = table(spark, folder, "triples")
    people = table(spark, folder, "entities").filter("entity_type = 'person'")
    return temporal.timeline(t, people).select("entity", "role", "id", *_us(t, "valid_from")).distinct()


def scope_counts(spark, folder):
    e = _t(spark, folder, "entities", "scope")
    filters = {"project": project_scope(PROJECT), "project_only": project_scope(PROJECT, False), "projects": cross_project_scope(False), "global": global_only_scope(), "tenant": tenant_scope("t1")}
    return e.agg(*[F.count_if(f.column()).alias(n) for n, f in filters.items()])


def scope_kinds(spark, folder):
    e = _t(spark, folder, "entities", "scope").select(parse_scope(F.col("scope")).alias("s"))
    return e.groupBy(F.col("s.kind").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("s.name").alias("names"))


def current_state_lww(spark, folder):
    t = table(spark, folder, "triples")
    return state.current_state(t).select(*state.KEY, "id", "object_id", "object_value", *_us(t, "valid_from"))


def current_state_event_time(spark, folder):
    return state.current_state(table(spark, folder, "triples"), "event_time").select(*state.KEY, "id")


def superseded_chain(spark, folder):
    t = table(spark, folder, "triples")
    rows = state.superseded(t)
    return rows.select("id", micros(t, "valid_from").alias("valid_from_us"), micros(rows, "closed_at").alias("closed_us"), "predecessor")


def write_conflicts(spark, folder):
    """The rows of project_current_state as incoming writes against the current triples."""
    new = table(spark, folder, "project_current_state").select(*state.KEY, F.coalesce("object_id", "object_value").alias("value")).distinct()
    return state.write_conflicts(table(spark, folder, "triples"), new)


def spatial_radius(spark, folder):
    near = spatial.query_in_area(table(spark, folder, "locations"), LNG, LAT, RADIUS_M)
    return near.select("id", F.round("distance_m", 3).alias("distance_m"))


def spatial_hierarchy(spark, folder):
    """The places at and below the parent of the least path of three steps."""
    places = table(spark, folder, "locations")
    path = places.filter(F.size(F.split("path", "\\.")) == 3).agg(F.min("path")).first()[0]
    return spatial.query_in_location(places, path.rpartition(".")[0]).select("id", "path")


def _people(spark, folder):
    return table(spark, folder, "entities").filter("entity_type = 'person' AND valid_to IS NULL").select("id").distinct()


def graph_n_degree(spark, folder):
    """The neighbours of every person within two steps, in all scopes."""
    return graph.n_degree(table(spark, folder, "triples"), _people(spark, folder), 2)


def graph_n_degree_named(spark, folder):
    rows = graph.n_degree(table(spark, folder, "triples"), _people(spark, folder), 1, relation_types=["semantic"])
    return graph.with_names(rows, "node", table(spark, folder, "entities"), "name")


def graph_edges(spark, folder):
    return graph.edges(table(spark, folder, "triples"), relation_types=["semantic", "causal"]).groupBy("src").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("targets"))


def graph_path(spark, folder):
    """A shortest way from the first subject that is two steps from another entity to the last such entity."""
    t = table(spark, folder, "triples")
    e = graph.edges(t)
    two = e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").filter("src <> end AND src <> dst AND dst <> end")
    ends = two.agg(F.min_by(F.struct("src", "end"), F.struct("src", "end"))).first()[0]
    return graph.shortest_path(t, ends["src"], ends["end"], 6)


def causal_backward(spark, folder):
    t = table(spark, folder, "triples")
    start = t.filter("predecessor_id IS NOT NULL").agg(F.max("id")).first()[0]
    return causal.trace(t, start, "backward")


def causal_forward(spark, folder):
    t = table(spark, folder, "triples")
    start = t.filter("predecessor_id IS NOT NULL").agg(F.min("predecessor_id")).first()[0]
    return causal.trace(t, start, "both")


def causal_chains(spark, folder):
    return causal.chains(table(spark, folder, "triples"))


def _probe(spark, folder) -> list[float]:
    """The vector of the least vector_id that has one of 64 dimensions."""
    v = table(spark, folder, "vector_links").filter("size(embedding) = 64")
    return list(v.agg(F.min_by("embedding", "vector_id")).first()[0])


def _distances(df):
    return df.select("vector_id", F.round("distance", 4).alias("distance"))


def knn_l2(spark, folder):
    v = table(spark, folder, "vector_links").filter(~F.exists("embedding", lambda x: F.isnan(x)))
    return _distances(search.knn(v, "vector_id", "embedding", _probe(spark, folder), 20))


def _owned(spark, folder):
    """Vectors with the scope of what they stand for."""
    v = table(spark, folder, "vector_links").filter(~F.exists("embedding", lambda x: F.isnan(x)))
    names = ["entities", "triples", "temporal_fragments"]
    owners = [table(spark, folder, n).select("id", "scope").distinct() for n in names]
    scopes = owners[0].unionByName(owners[1]).unionByName(owners[2]).groupBy("id").agg(F.min("scope").alias("scope"))
    return v.withColumn("memory_id", search.memory_id()).join(scopes, F.col("memory_id") == scopes["id"], "left").select("vector_id", "embedding", "scope")


def knn_scoped_exact(spark, folder):
    scope = project_scope(PROJECT, False).column()
    return _distances(search.knn(_owned(spark, folder), "vector_id", "embedding", _probe(spark, folder), 10, scope))


def knn_scoped_oversample(spark, folder):
    scope = project_scope(PROJECT, False).column()
    return _distances(search.knn(_owned(spark, folder), "vector_id", "embedding", _probe(spark, folder), 10, scope, oversample=5))


def bm25_fragments(spark, folder):
    rows = search.bm25(table(spark, folder, "temporal_fragments"), "id", "content", WORDS, 25)
    return rows.select("id", F.round("score", 6).alias("score"))


def bm25_scoped(spark, folder):
    rows = search.bm25(table(spark, folder, "temporal_fragments"), "id", "content", "session cache stale", 15, project_scope(PROJECT).column())
    return rows.select("id", F.round("score", 6).alias("score"))


def keyword_like(spark, folder):
    return table(spark, folder, "temporal_fragments").filter(search.keyword_like(F.col("content"), "Shared_Lock%twice")).select("id").distinct()


def panel_search(spark, folder):
    return search.panel_search(table(spark, folder, "temporal_fragments"), "id", "content", "updated_at", "锁管", 30).select("id")


def panel_phrase(spark, folder):
    """A query of three characters or more is one phrase."""
    rows = search.panel_search(table(spark, folder, "temporal_fragments"), "id", "content", "updated_at", "lock manager", 30)
    return rows.select("id", F.round("score", 6).alias("score"))


def bm25_postings(spark, folder):
    """bm25_fragments() through an index of trigrams that is written first."""
    from memspark.sources.sinks import laid_out

    f = table(spark, folder, "temporal_fragments")
    index = cut(laid_out("postings", search.postings(f, "id", "content")))
    return search.bm25_indexed(index, f, "id", "content", WORDS, 25).select("id", F.round("score", 6).alias("score"))


def keyword_overlap(spark, folder):
    t = table(spark, folder, "triples").select("id", F.concat_ws(" ", "predicate", "object_value").alias("text"))
    return search.keyword_overlap(t, "id", "text", "token budget 1000 review status", 40)


def _rankings(spark, folder):
    f = table(spark, folder, "temporal_fragments")
    words = search.bm25(f, "id", "content", "vector index stale", 40)
    q = list(f.filter("size(embedding) = 64").agg(F.min_by("embedding", "id")).first()[0])
    near = search.knn(f, "id", "embedding", q, 40)
    return [search.ranks(near, "id", [F.col("distance"), F.col("id")], "vector"), search.ranks(words, "id", [F.round("score", 9), F.col("id")], "words")]


def rrf_fusion(spark, folder):
    return fusion.rrf(_rankings(spark, folder)).select("key", F.round("score", 9).alias("score"), F.array_join("found_in", ",").alias("found_in"))


def _request(spark, folder):
    """A request that uses every channel: words, a vector, a range of time, an entity and a triple of the tables."""
    from memspark.engine import Memory, Request

    m = Memory.open(spark, folder)
    t = m.tables["triples"]
    vector = list(m.tables["temporal_fragments"].filter("size(embedding) = 64").agg(F.min_by("embedding", "id")).first()[0])
    start = graph.edges(t).agg(F.min("src")).first()[0]
    cause = t.filter("predecessor_id IS NOT NULL").agg(F.max("id")).first()[0]
    return m, Request(query="vector index stale", vector=vector, start=START, end=END, entity=start, triple=cause, top_k=10, budget=600)


def hybrid_search(spark, folder):
    """Time, graph and cause strategies fused: 20 of each, 10 in all."""
    m, r = _request(spark, folder)
    return m.hybrid(r).select("key", F.round("score", 9).alias("score"), F.array_join("found_in", ",").alias("found_in"))


def context_candidates(spark, folder):
    """What all layers offer for a context, each id in its first layer."""
    m, r = _request(spark, folder)
    return m.context(r).select("layer", "key", F.round("score", 9).alias("score"), "text", "tokens")


def context_fill(spark, folder):
    """What of it fits a budget of 600 tokens."""
    m, r = _request(spark, folder)
    return m.fill(r).select(F.size("keys").alias("n"), "used", "truncated")


def recall_context(spark, folder):
    """A recall with archived records."""
    from memspark.jobs import quality

    m, r = _request(spark, folder)
    now = datetime(2026, 6, 1)
    cold = {n: m.tables[n].filter(c(m.tables[n], now)) for n, c in (("temporal_fragments", quality.cold_fragments), ("triples", quality.cold_triples))}
    return m.recall(r, cold).select("layer", "key", F.round("score", 9).alias("score"), "snippet", "tokens")


def recall_accesses(spark, folder):
    """The fragments with the accesses of that recall counted."""
    from memspark.sources.stores import with_access

    m, r = _request(spark, folder)
    f = m.tables["temporal_fragments"].select("id", "access_count", "last_accessed_at").dropDuplicates(["id"])
    counted = with_access(f, m.accesses(m.recall(r), datetime(2026, 6, 1)))
    return counted.select("id", "access_count", micros(counted, "last_accessed_at").alias("last_us"))


def layered_dedup(spark, folder):
    """The fragment of the first layer for every content of a scope."""
    f = _t(spark, folder, "temporal_fragments", "scope", "content", "layer", "importance").withColumn("content_key", F.md5(F.concat_ws("|", "scope", "content")))
    return fusion.first_layer(f, "content_key", F.col("layer"), [F.desc_nulls_last("importance"), F.col("id")]).select("id", "layer")


def rerank_scaled(spark, folder):
    """All fragments of each layer in order of importance, as scores of which the first 50 were reranked; none counts as 0."""
    f = _t(spark, folder, "temporal_fragments", "layer", "importance")
    f = f.withColumns({"score": F.coalesce("importance", F.lit(0.0)), "one": F.lit(1).cast("long")}).withColumn("worse", -F.col("score"))
    placed = prefix_sum(f, ["layer"], ["worse", "id"], "one", "before").withColumn("place", F.col("before") + 1)
    return fusion.rerank_scale(placed, ["layer"], "score", "place").select("id", "layer", F.round("scaled", 9).alias("scaled"))


def memory_browse(spark, folder):
    """The 100 latest memories of one project and global that mention a word."""
    from memspark.engine import Memory

    rows = Memory.open(spark, folder).browse(keyword="index", scope=project_scope(PROJECT), limit=100)
    return rows.select("id", "kind", "layer", "text")


def _found_and_gold(spark, folder):
    """Places that the fragments of a scope name, ranked by importance, and those that its very important ones of a layer name."""
    from pyspark.sql import Window as W

    f = _t(spark, folder, "temporal_fragments", "scope", "location_id", "layer", "importance")
    gold = f.filter("location_id IS NOT NULL AND importance > 0.9").select(F.col("scope").alias("query"), F.col("location_id").alias("key"), "layer").distinct()
    found = f.filter("location_id IS NOT NULL").select(F.col("scope").alias("query"), F.col("location_id").alias("key"), F.row_number().over(W.partitionBy("scope").orderBy(F.desc_nulls_last("importance"), "id")).alias("rank"))
    return f, found, gold


def hit_rates(spark, folder):
    """How often the five most important fragments of a scope name a place that its very important ones of a layer name; medians of importance."""
    from memspark.operators.metrics import hit_at_k, nearest_rank

    f, found, gold = _found_and_gold(spark, folder)
    rates = hit_at_k(found, gold, 5, ["layer"])
    return rates.join(f.groupBy("layer").agg(*nearest_rank("importance", 0.5, 0.99)), "layer")


def hit_cutoffs(spark, folder):
    """The same at the cutoffs 1, 3 and 20."""
    from memspark.operators.metrics import hits_at

    _, found, gold = _found_and_gold(spark, folder)
    return hits_at(found, gold, [1, 3, 20], ["layer"])


QUERIES = {n: q for n, q in globals().items() if callable(q) and getattr(q, "__module__", "") == __name__ and not n.startswith("_")}

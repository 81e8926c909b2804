"""One object over the tables of a store: retrieval, context and writes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.jobs import quality
from memspark.operators import causal, fusion, graph, search, spatial, state, temporal
from memspark.scope import ScopeFilter
from memspark.tables import cut, table

# What marks archived records in a context, and the length of a snippet.
ARCHIVED, SNIPPET = "[归档] ", 120
TABLES = ("entities", "triples", "locations", "temporal_fragments", "vector_links", "project_current_state")


@dataclass(frozen=True)
class Request:
    """A recall: words, a query vector or both; a range of time, an entity and a triple to start from are optional."""

    query: str = ""
    vector: Sequence[float] | None = None
    start: datetime | None = None
    end: datetime | None = None
    entity: str | None = None
    triple: str | None = None
    top_k: int = 10
    budget: int = 4000
    scope: ScopeFilter | None = None


class Memory:
    """Lazy: every method but find_path gives a DataFrame. Rows of one id count once: they are compared after filters and projections, so these reach the scan."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = dict(tables)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, names: Sequence[str] = TABLES) -> Memory:
        return cls({n: table(spark, folder, n) for n in names})

    def _scope(self, scope: ScopeFilter | None):
        return None if scope is None else scope.column()

    def at_time(self, t: datetime, name: str = "triples", scope: ScopeFilter | None = None) -> DataFrame:
        if name not in ("triples", "entities"):
            raise ValueError(f"no such table: {name!r}")
        return temporal.query_at_time(self.tables[name], t, self._scope(scope))

    def in_range(self, start: datetime, end: datetime, name: str = "triples", scope: ScopeFilter | None = None, limit: int | None = None) -> DataFrame:
        if name not in ("triples", "entities"):
            raise ValueError(f"no such table: {name!r}")
        return temporal.query_in_range(self.tables[name], start, end, self._scope(scope), limit)

    def get(self, name: str, key: str) -> DataFrame:
        """The record of a table with this id: a point lookup that reaches the scan."""
        return self.tables[name].filter(F.col("id") == key).limit(1)

    def timeline(self, entities: DataFrame, **roles: bool) -> DataFrame:
        return temporal.timeline(self.tables["triples"], entities, **roles)

    def in_area(self, lng: float, lat: float, radius_m: float, scope: ScopeFilter | None = None) -> DataFrame:
        return spatial.query_in_area(self.tables["locations"], lng, lat, radius_m, self._scope(scope))

    def in_location(self, path: str, children: bool = True, scope: ScopeFilter | None = None) -> DataFrame:
        return spatial.query_in_location(self.tables["locations"], path, children, self._scope(scope))

    def find_path(self, src: str, dst: str, max_depth: int = 5, scope: ScopeFilter | None = None, types: Sequence[str] | None = None) -> DataFrame:
        return graph.shortest_path(self.tables["triples"], src, dst, max_depth, self._scope(scope), types)

    def n_degree(self, starts: DataFrame, max_depth: int = 2, scope: ScopeFilter | None = None, types: Sequence[str] | None = None) -> DataFrame:
        return graph.n_degree(self.tables["triples"], starts, max_depth, self._scope(scope), types)

    def trace(self, triple: str, direction: str = "backward", max_depth: int = 20, scope: ScopeFilter | None = None) -> DataFrame:
        return causal.trace(self.tables["triples"], triple, direction, max_depth, self._scope(scope))

    def current_state(self, order: str = "arrival") -> DataFrame:
        return state.current_state(self.tables["triples"], order)

    def resolve(self, name: str, project: str | None = None) -> DataFrame:
        """The entity that an id, entity_id or name means: of the project first, then global, then the least scope."""
        e = self.tables["entities"]
        found = e.filter((F.col("id") == name) | (F.col("entity_id") == name) | (F.col("name") == name))
        rank = F.when(F.col("scope") == f"project:{project}", 0).when(F.col("scope") == "global", 1).otherwise(2)
        return found.orderBy(rank, "scope", "id").limit(1)

    def _first_layer(self, r: Request) -> DataFrame:
        """key, score of the fragments nearest in words and vector, scaled by the number of channels that found any."""
        f, rankings = self.tables["temporal_fragments"], []
        if r.vector is not None:
            near = search.knn(f, "id", "embedding", r.vector, r.top_k, self._scope(r.scope))
            rankings.append(search.ranks(near, "id", [F.col("distance"), F.col("id")], "vector"))
        if search.query_terms(r.query):
            words = search.bm25(f, "id", "content", r.query, 2 * r.top_k, self._scope(r.scope))
            rankings.append(search.ranks(words, "id", [F.col("score"), F.col("id")], "words"))
        if not rankings:
            return f.select(F.col("id").alias("key"), F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("found_in")).limit(0)
        fused = fusion.rrf(rankings).limit(r.top_k)
        channels = F.broadcast(fused.agg(F.size(F.array_distinct(F.flatten(F.collect_list("found_in")))).alias("_n")))  # one row
        return fused.crossJoin(channels).select("key", (F.col("score") * (fusion.RRF_K + 1) / F.greatest(F.col("_n"), F.lit(1))).alias("score"), "found_in")

    def hybrid(self, r: Request) -> DataFrame:
        """key, score, found_in of triples by time, graph and cause, 20 of each, top_k in all."""
        t, rankings, scope = self.tables["triples"], [], self._scope(r.scope)
        span = temporal.fold_range(None, r.start, r.end, datetime.max.replace(microsecond=0))
        if span is not None:
            rankings.append(search.ranks(temporal.query_in_range(t, *span, scope, 20), "id", [F.col("valid_from"), F.col("id")], "time"))
        if r.entity is not None:
            start = t.sparkSession.createDataFrame([(r.entity,)], "id string")
            hood = graph.n_degree(t, start, 2, scope).select("node").unionByName(start.withColumnRenamed("id", "node"))
            now = t.filter("valid_to IS NULL").select("id", "subject_id", "object_id", "valid_from")
            touching = now.join(hood, F.col("subject_id") == F.col("node"), "left_semi").unionByName(now.join(hood, F.col("object_id") == F.col("node"), "left_semi")).dropDuplicates(["id"])
            rankings.append(search.ranks(touching.orderBy(F.desc("valid_from"), "id").limit(20), "id", [F.desc("valid_from"), F.col("id")], "graph"))
        if r.triple is not None:
            chain = causal.trace(t, r.triple, "both", scope=scope)
            rankings.append(search.ranks(chain.orderBy("direction", "depth", "id").limit(20), "id", [F.col("direction"), F.col("depth"), F.col("id")], "cause"))
        if not rankings:
            return self._first_layer(Request())
        return fusion.rrf(rankings).limit(r.top_k).select("key", "score", "found_in")

    def context(self, r: Request) -> DataFrame:
        """layer, key, score, text, tokens of the candidates of all layers, each id in its first layer, in order (place)."""
        f, t = self.tables["temporal_fragments"], self.tables["triples"]
        session = f.filter("layer = 'L0' AND content IS NOT NULL")
        session = (session if r.scope is None else session.filter(r.scope.column())).select("id", "importance", "updated_at", "content").dropDuplicates(["id"]).orderBy(F.desc_nulls_last("importance"), F.desc_nulls_last("updated_at"), "id").limit(r.top_k)
        l0 = session.select(F.lit(0).alias("layer"), F.col("id").alias("key"), F.coalesce("importance", F.lit(0.0)).alias("score"), F.col("content").alias("text"))
        l1 = self._first_layer(r).join(f.select(F.col("id").alias("key"), F.col("content").alias("text")).dropDuplicates(["key"]), "key").select(F.lit(1).alias("layer"), "key", "score", "text")
        thing = F.coalesce(F.when(F.length("object_id") > 0, F.col("object_id")), F.when(F.length("object_value") > 0, F.col("object_value")), F.lit("?"))
        said = t.select(F.col("id").alias("key"), F.concat_ws(" ", "subject_id", "predicate", thing).alias("text")).dropDuplicates(["key"])
        l2 = self.hybrid(r).join(said, "key").select(F.lit(2).alias("layer"), "key", "score", "text")
        items = fusion.first_layer(l0.unionByName(l1).unionByName(l2), "key", F.col("layer"), [F.desc("score")])
        place = F.struct(F.col("layer"), (-F.col("score")).alias("s"), F.col("key"))
        return items.withColumn("tokens", fusion.token_estimate(F.col("text"))).withColumn("place", place)

    def fill(self, r: Request) -> DataFrame:
        """keys, used, truncated: what of the context fits the budget, in order."""
        return fusion.greedy_fill(self.context(r).withColumn("one", F.lit(1)), ["one"], ["place"], "tokens", "key", r.budget).drop("one")

    def recall(self, r: Request, archived: dict[str, DataFrame] | None = None) -> DataFrame:
        """position, layer, key, score (0 to 1), snippet, text, tokens of what a recall gives.

        The context within the budget and, if archived tables (fragments,
        triples) are given, up to top_k archived records with the query as a
        keyword, marked and of score 0.
        """
        items = cut(self.context(r))
        chosen = fusion.greedy_fill(items.withColumn("one", F.lit(1)), ["one"], ["place"], "tokens", "key", r.budget)
        chosen = chosen.select(F.posexplode("keys").alias("position", "key"))
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
        columns = ["position", F.concat(F.lit("L"), F.col("layer").cast("string")).alias("layer"), "key", clamped.alias("score"), F.substring("text", 1, SNIPPET).alias("snippet"), "text", "tokens"]
        found = items.join(chosen, "key").select(*columns)
        if archived is None:
            return found.orderBy("position")
        cold = quality.query_archived(archived, r.query, self._scope(r.scope), r.top_k)
        line = F.concat(F.lit(ARCHIVED), F.col("text"))
        cold = cold.select((F.col("place") + 1_000_000).alias("position"), F.lit("L2").alias("layer"), F.col("id").alias("key"), F.lit(0.0).alias("score"), F.substring("text", 1, SNIPPET).alias("snippet"), line.alias("text"), fusion.token_estimate(line).alias("tokens"))
        return found.unionByName(cold).orderBy("position")

    def accesses(self, recalled: DataFrame, at: datetime) -> DataFrame:
        """id, at: an access for every fragment that a recall gave, to be logged and counted by stores.with_access()."""
        ids = recalled.select(F.col("key").alias("id")).distinct()
        return self.tables["temporal_fragments"].select("id").join(ids, "id", "left_semi").distinct().withColumn("at", F.lit(at))

    def graph_query(self, mode: str, start: str, target: str | None = None, max_depth: int = 3, scope: ScopeFilter | None = None) -> DataFrame:
        """position, id, name of a path, of neighbours (by depth) or of causes (triples with their texts), whatever the start is called."""
        if mode not in ("path", "neighbours", "causes"):
            raise ValueError(f"no mode: {mode!r}")
        e, t = self.tables["entities"], self.tables["triples"]
        found = self.resolve(start).first()
        first = found["id"] if found else start
        if mode == "causes":
            thing = F.coalesce(F.when(F.length("object_id") > 0, F.col("object_id")), F.when(F.length("object_value") > 0, F.col("object_value")), F.lit("?"))
            said = t.select("id", F.concat_ws(" ", "subject_id", "predicate", thing).alias("name")).dropDuplicates(["id"])
            return self.trace(start, "both", max_depth, scope).join(said, "id").select(F.col("depth").alias("position"), "id", "name")
        if mode == "path":
            end = self.resolve(target or "").first()
            rows = self.find_path(first, end["id"] if end else target or "", max_depth, scope).select("position", F.col("node").alias("id"))
        else:
            rows = self.n_degree(t.sparkSession.createDataFrame([(first,)], "id string"), max_depth, scope).select(F.col("depth").alias("position"), F.col("node").alias("id"))
        return graph.with_names(rows, "id", e, "name")

    def browse(self, layer: str | None = None, keyword: str | None = None, scope: ScopeFilter | None = None, limit: int = 50) -> DataFrame:
        """id, kind, layer, scope, text, at of memories, the latest first: fragments, triples (as L2) and entities (as L1)."""
        f, t, e = self.tables["temporal_fragments"], self.tables["triples"], self.tables["entities"]
        thing = F.coalesce(F.when(F.length("object_id") > 0, F.col("object_id")), F.col("object_value"), F.lit("?"))
        rows = f.select("id", F.lit("fragment").alias("kind"), "layer", "scope", F.col("content").alias("text"), F.col("updated_at").alias("at"))
        rows = rows.unionByName(t.select("id", F.lit("triple").alias("kind"), F.lit("L2").alias("layer"), "scope", F.concat_ws(" ", "subject_id", "predicate", thing).alias("text"), F.col("valid_from").alias("at")))
        rows = rows.unionByName(e.select("id", F.lit("entity").alias("kind"), F.lit("L1").alias("layer"), "scope", F.col("name").alias("text"), F.col("valid_from").alias("at")))
        for wanted in (None if layer is None else F.col("layer") == layer, None if keyword is None else search.keyword_like(F.col("text"), keyword), self._scope(scope)):
            rows = rows if wanted is None else rows.filter(wanted)
        return rows.dropDuplicates(["id", "kind"]).orderBy(F.desc_nulls_last("at"), "id").limit(limit)

"""Queries of the maintenance jobs, functions and sources over the tables of a folder."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from memspark.functions import masking, text, vector
from memspark.jobs import cloning, communities, memory, quality
from memspark.sources import bootstrap, importers, sinks
from memspark.tables import micros, table

NOW = datetime(2026, 6, 1)
SOURCE, TARGET = "project:harborlight", "project:atlas-delta-000000"


def _t(spark, folder, name, *columns):
    """These columns of a table (all, if none is named) as records: rows of one id are one."""
    df = table(spark, folder, name)
    return (df.select("id", *columns) if columns else df).dropDuplicates(["id"])


def _r(c, n=6):
    return F.round(c, n).alias(c)


def consolidate_groups(spark, folder):
    new, _ = memory.consolidate(table(spark, folder, "temporal_fragments"))
    return new.select("scope", F.array_join("entities", ",").alias("entities"), "content", "importance", micros(new, "time_start").alias("start_us"), micros(new, "time_end").alias("end_us"), "access_count", "members")


def consolidate_survivors(spark, folder):
    f = table(spark, folder, "temporal_fragments")
    _, gone = memory.consolidate(f)
    return f.join(gone, "id", "left_anti").groupBy("layer").agg(F.countDistinct("id").alias("n"))


def forget_scores(spark, folder):
    return memory.forget(_t(spark, folder, "temporal_fragments", "importance", "updated_at", "last_accessed_at", "access_count", "time_end"), NOW).select("id", _r("score"), "verdict")


def capacity_prune(spark, folder):
    return memory.over_capacity(table(spark, folder, "temporal_fragments"), NOW, 50)


def summarize_rule(spark, folder):
    return memory.summarize(table(spark, folder, "temporal_fragments")).select("fragment_id", "content", "scope", "layer", "source_id")


def dedup_groups(spark, folder):
    """Fragments merged by similarity: the survivor and what it absorbs."""
    return memory.dedup(table(spark, folder, "temporal_fragments")).select("survivor", "members", "access_count", "importance", F.array_join("entities", ",").alias("entities"))


def dedup_classes(spark, folder):
    """Every fragment with the class of its near-duplicates."""
    return memory.dedup_members(table(spark, folder, "temporal_fragments"))


def top_fragments(spark, folder):
    return memory.top_of_scope(_t(spark, folder, "temporal_fragments", "scope", "importance"), 5).select("scope", "place", "id")


def archive_split(spark, folder):
    f, t = _t(spark, folder, "temporal_fragments", "time_end", "updated_at", "importance"), _t(spark, folder, "triples", "valid_to")
    parts = []
    for name, df, cold in (("temporal_fragments", f, quality.cold_fragments(f, NOW)), ("triples", t, quality.cold_triples(t, NOW))):
        hot, gone = quality.archive(df, cold, NOW)
        parts += [hot.select("id", F.lit(name).alias("table_name"), F.lit("hot").alias("tier")), gone.select("id", F.lit(name).alias("table_name"), F.lit("cold").alias("tier"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def archive_find_cold(spark, folder):
    f, t = _t(spark, folder, "temporal_fragments", "time_end", "updated_at", "importance"), _t(spark, folder, "triples", "valid_to")
    return f.agg(F.count_if(quality.cold_fragments(f, NOW)).alias("fragments")).crossJoin(t.agg(F.count_if(quality.cold_triples(t, NOW)).alias("triples")))  # one row each


def archive_query(spark, folder):
    """Archived fragments and triples with a keyword, the latest first, 50 at most."""
    f, t = table(spark, folder, "temporal_fragments"), table(spark, folder, "triples")
    gone = {"temporal_fragments": quality.archive(f, quality.cold_fragments(f, NOW), NOW)[1], "triples": quality.archive(t, quality.cold_triples(t, NOW), NOW)[1]}
    return quality.query_archived(gone, "scope filter", None, 50).select("id", "found_in")


def restore_roundtrip(spark, folder):
    """Archived, and those of one project restored: these are hot again, the rest stay archived."""
    t = _t(spark, folder, "triples", "valid_to", "scope")
    hot, gone = quality.archive(t, quality.cold_triples(t, NOW), NOW)
    hot, gone = quality.restore(hot, gone, F.col("scope") == SOURCE)
    return hot.select("id", F.lit("hot").alias("tier")).unionByName(gone.select("id", F.lit("cold").alias("tier")))


def predicate_codes(spark, folder):
    return quality.predicate_codes(table(spark, folder, "triples"))


def contradiction_kinds(spark, folder):
    return quality.contradictions(table(spark, folder, "triples"))


def contradiction_temporal(spark, folder):
    return quality.temporal_contradictions(table(spark, folder, "triples"))


def causal_inverse(spark, folder):
    """Among the triples and the reverse of every sure cause."""
    t = table(spark, folder, "triples").select("id", "scope", "predicate", "subject_id", "object_id", "valid_to", "confidence")
    back = t.filter("predicate = 'causes' AND confidence >= 0.5 AND object_id IS NOT NULL").select(F.concat("id", F.lit("-")).alias("id"), "scope", "predicate", F.col("object_id").alias("subject_id"), F.col("subject_id").alias("object_id"), "valid_to", "confidence")
    return quality.inverse_causes(t.unionByName(back))


def _shared(spark, folder):
    """Entities under keys without their numbers, which projects so have in common."""
    return table(spark, folder, "entities").withColumn("entity_id", F.regexp_replace("entity_id", r"(?:-\d+)+$", ""))


def cross_project_patterns(spark, folder):
    return quality.cross_project_patterns(table(spark, folder, "triples"), _shared(spark, folder), 2)


def promote_missing(spark, folder):
    return quality.promote(table(spark, folder, "triples"), _shared(spark, folder), 2)


def promote_entities(spark, folder):
    """The global entities that the promoted triples need."""
    e = _shared(spark, folder)
    return quality.global_entities(quality.promote(table(spark, folder, "triples"), e, 2), e).select("id", "entity_id", "entity_type", "name", "source_closet")


def promote_by_hand(spark, folder):
    """Every surely known triple between entities, promoted by its id."""
    t = table(spark, folder, "triples")
    return quality.manual_promote(t, _shared(spark, folder), t.filter("confidence >= 0.95 AND relation_type = 'semantic'").select("id"))


def contradiction_new(spark, folder):
    """The closed and open triples of one project as incoming ones against those of all."""
    t = table(spark, folder, "triples")
    new = t.filter(F.col("scope") == SOURCE).withColumn("id", F.concat("id", F.lit("+")))
    return quality.check_new(t, new)


def dq_constraints(spark, folder):
    return quality.violations(*[table(spark, folder, n) for n in ("entities", "triples", "temporal_fragments", "locations", "vector_links")])


def stats_by_layer(spark, folder):
    return quality.statistics(table(spark, folder, "temporal_fragments"), table(spark, folder, "triples"))


def sink_triples(spark, folder):
    """What the surer triples add to the others: the sink adds no key twice."""
    t = table(spark, folder, "triples")
    late = F.coalesce(F.col("confidence") >= 0.5, F.lit(False))
    return sinks.appended("triples", t.filter(late), t.filter(~late)).select(*sinks.KEYS["triples"][:-1], micros(t, "valid_from").alias("from_us"))


def sink_entities(spark, folder):
    """What the entities without a type of their own add to the others, by scope and key without number."""
    e = _shared(spark, folder)
    return sinks.appended("entities", e.filter("valid_to IS NULL"), e.filter("valid_to IS NOT NULL")).select("scope", "entity_id")


def sink_locations(spark, folder):
    p = table(spark, folder, "locations")
    return sinks.appended("locations", p.filter("parent_id IS NOT NULL"), p.filter("parent_id IS NULL")).select("scope", "location_id")


def vectors_deleted(spark, folder):
    """The vectors that stay when all expired fragments go."""
    f, v = table(spark, folder, "temporal_fragments"), table(spark, folder, "vector_links")
    return sinks.without_vectors(v, f.filter(micros(f, "time_end") < 1_740_000_000_000_000)).select("id").distinct()


def version_conflicts(spark, folder):
    """State writes as commits of a chain per layer of time; each key's current row claims to be based on the version before the last."""
    from memspark.operators import state

    t = table(spark, folder, "triples")
    resource = F.concat_ws("|", *state.KEY).alias("resource_id")
    writes = state.state_rows(t).select("id", resource, F.col("predicate").alias("chain_id"), F.col("id").alias("at")).dropDuplicates(["id"])
    incoming = table(spark, folder, "project_current_state").select(resource, F.lit("chain").alias("chain_id"), F.when(F.col("confidence") > 0.8, 2).alias("expected_version"), F.lit(1).alias("base_version")).distinct()
    return state.version_conflicts(writes, incoming)


def read_write_conflicts(spark, folder):
    """Errors as writes to the payload's resource, views as reads of it."""
    from memspark.operators import state

    e = table(spark, folder, "events").select("event_type", F.col("props").alias("resource_id"), F.col("user_id").cast("string").alias("chain_id"), F.col("ts").alias("at"))
    made = state.read_write_conflicts(e.filter("event_type = 'error'").drop("event_type"), e.filter("event_type = 'view'").drop("event_type"), 86_400.0)
    return made.select("resource_id", "chain_id", micros(made, "read_at").alias("read_us"), "kind", "strategy", "other_chain_id")


def expired_fingerprints(spark, folder):
    return memory.expired_fingerprints(fingerprints(spark, folder), datetime(2024, 6, 1), 90).select("fingerprint")


def consolidate_members(spark, folder):
    """The members of the groups of consolidate_groups, a row each."""
    return memory.consolidate(table(spark, folder, "temporal_fragments"))[1].select("position", "id", "text")


def semantic_communities(spark, folder):
    t, e = table(spark, folder, "triples"), table(spark, folder, "entities")
    edges = communities.weights(t, e)
    return communities.summaries(communities.communities(edges), edges, e)


def community_edges(spark, folder):
    return communities.weights(table(spark, folder, "triples"), table(spark, folder, "entities"))


def _cloned(spark, folder):
    return cloning.clone({n: table(spark, folder, n) for n in cloning.TABLES}, SOURCE, TARGET)


def clone_entities(spark, folder):
    return _cloned(spark, folder)["entities"].select("id", "source_id", "entity_id")


def clone_triples(spark, folder):
    return _cloned(spark, folder)["triples"].select("id", "source_id", "subject_id", "object_id", "predecessor_id")


def clone_fragments(spark, folder):
    return _cloned(spark, folder)["temporal_fragments"].select("id", "source_id", F.array_join("entities", ",").alias("entities"), "location_id")


def fingerprints(spark, folder):
    """Errors of the event stream by fingerprint of type and payload."""
    e = table(spark, folder, "events").filter("event_type = 'error'")
    key = text.error_fingerprint(F.lit("global"), F.col("event_type"), F.col("props"))
    return e.groupBy(key.alias("fingerprint")).agg(F.count("*").alias("n"), micros_min(e, "ts").alias("first_us"), micros_max(e, "ts").alias("last_us"))


def micros_min(df, c):
    return F.min(micros(df, c))


def micros_max(df, c):
    return F.max(micros(df, c))


def text_functions(spark, folder):
    d = table(spark, folder, "documents")
    t = F.col("text")
    return d.select(
        "doc_id", F.md5(text.compact(t)).alias("compact"), F.size(text.bigrams(text.compact(t))).alias("bigrams"), text.digest(t).alias("digest"), text.text_key(t).alias("text_key"),
        text.first_number(t).alias("first_number"), F.array_join(text.technologies(t), ",").alias("technologies"), text.error_text(t).alias("error_text"),
    )


def document_outline(spark, folder):
    d = table(spark, folder, "documents")
    c = text.chunks(F.col("text"), 400)
    return d.select("doc_id", F.array_join(text.headings(F.col("text")), "|").alias("headings"), F.size(c).alias("n_chunks"), (F.concat_ws("", c) == F.col("text")).alias("whole"))


def text_import(spark, folder):
    return importers.text_batch(table(spark, folder, "documents"), "text").select("fragment_id")


def readme_seeds(spark, folder):
    d = table(spark, folder, "documents").filter("lower(trim(source)) = 'readme'")
    return importers.readme_seeds(d, F.col("scope"), "text")


def _project_seeds(spark, folder):
    d = table(spark, folder, "documents").filter("lower(trim(source)) = 'readme' AND scope IS NOT NULL")
    made = importers.readme_seeds(d, F.col("scope"), "text").filter("object_key IS NOT NULL")
    return made.select(F.col("subject").alias("scope"), F.concat(F.lit("concept:"), "subject").alias("subject_key"), "predicate", "object_key", "object")


def bootstrap_entities(spark, folder):
    """The entities that the readmes of all projects add; some of their keys are there already."""
    new, _ = bootstrap.seeded(_project_seeds(spark, folder), _shared(spark, folder), table(spark, folder, "triples"))
    return new.select("id", "entity_id", "name", "scope")


def bootstrap_triples(spark, folder):
    return bootstrap.seeded(_project_seeds(spark, folder), _shared(spark, folder), table(spark, folder, "triples"))[1]


def bootstrap_gaps(spark, folder):
    """What every project is asked next."""
    return bootstrap.unknown(table(spark, folder, "triples"), ["owner", "status", "build_version", "deadline"])


def rule_summaries(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.rule_summary(F.col("text")).alias("summary"))


def jaccard_to_predecessor(spark, folder):
    """How similar each value of a state is to the one it replaced."""
    from memspark.operators import state

    t = table(spark, folder, "triples")
    rows = state.superseded(t).filter("predecessor IS NOT NULL").select("id", "predecessor")
    value = lambda n: t.select(F.col("id").alias(n), F.coalesce("object_id", "object_value").alias(f"v_{n}")).distinct()
    both = rows.join(value("id"), "id").join(value("predecessor"), "predecessor")
    grams = lambda c: text.bigrams(text.compact(F.coalesce(F.col(c), F.lit(""))))
    return both.select("id", F.round(text.jaccard(grams("v_id"), grams("v_predecessor")), 9).alias("jaccard"))


def mask_plain(spark, folder):
    """Fragments whose email addresses or keys are redacted in the JVM."""
    f = table(spark, folder, "temporal_fragments")
    masked = masking.masked(F.col("content"), "redact", ("api_key", "email"))
    return f.select("id", masked.alias("content")).distinct()


def mask_checked(spark, folder):
    """All categories, with Luhn, identity number and octet checks."""
    f = table(spark, folder, "temporal_fragments").select("id", "content").distinct()
    return f.select("id", masking.masked(F.col("content"), "mask").alias("content"))


def quantize_error(spark, folder):
    """The error of vectors after a round through bytes."""
    v = table(spark, folder, "vector_links").filter("size(embedding) = 64")
    q = v.select("vector_id", "embedding", vector.quantize(F.col("embedding")).alias("q")).filter("q IS NOT NULL").select("vector_id", "embedding", "q", vector.dequantize(F.col("q")).alias("back"))
    worst = F.array_max(F.zip_with("embedding", "back", lambda a, b: F.abs(a.cast("double") - b)))
    step = (F.col("q.high").cast("double") - F.col("q.low")) / 255
    return q.select("vector_id", (worst <= 0.5001 * step + 1e-6).alias("within_half_step"), F.array_max("q.codes").alias("top_code"), F.array_min("q.codes").alias("low_code")).distinct()


def quantize_codes(spark, folder):
    """The codes of vectors, as one text."""
    v = table(spark, folder, "vector_links").filter("size(embedding) = 64")
    q = v.select("vector_id", vector.quantize(F.col("embedding")).alias("q")).filter("q IS NOT NULL")
    return q.select("vector_id", F.array_join(F.transform("q.codes", lambda c: c.cast("string")), ",").alias("codes"), "q.low", "q.high").distinct()


def hash_embed(spark, folder):
    """The numbers of the embeddings, as whole thousandths."""
    made = table(spark, folder, "documents").select("doc_id", vector.hash_embedding(F.col("text")).alias("v")).filter("v IS NOT NULL")
    return made.select("doc_id", F.array_join(F.transform("v", lambda x: F.floor(x.cast("double") * 1000 + 0.5).cast("string")), ",").alias("thousandths"))


def content_lookup(spark, folder):
    """The text of whatever vectors stand for."""
    ids = table(spark, folder, "vector_links").select(F.coalesce("entity_id", "triple_id", "fragment_id").alias("id")).filter("id IS NOT NULL")
    return importers.lookup({n: table(spark, folder, n) for n in ("temporal_fragments", "entities", "triples")}, ids)


def sink_new_fragments(spark, folder):
    """What an idempotent sink appends of the L1 fragments where the other layers are there already."""
    f = table(spark, folder, "temporal_fragments")
    return importers.new_rows(f.filter("layer = 'L1'"), f.filter("layer <> 'L1'"), ["scope", "fragment_id"]).select("scope", "fragment_id")


_HELPERS = ("micros_min", "micros_max")
QUERIES = {n: q for n, q in globals().items() if callable(q) and getattr(q, "__module__", "") == __name__ and not n.startswith("_") and n not in _HELPERS}

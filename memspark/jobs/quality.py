"""Archive and restore, contradictions, cross-project promotion, checks, statistics."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark.functions.text import first_number, normalize_value
from memspark.operators.prefix import prefix_sum, prefix_sums
from memspark.operators.search import keyword_like
from memspark.operators.state import STATE_TYPES
from memspark.tables import cut, micros

# Predicates of which two different current values exclude each other; predicates of causes; kinds that the tables may hold.
ENUM_PREDICATES = ["color", "status", "state", "priority", "category", "颜色", "状态", "类别", "优先级"]
CAUSE_PREDICATES = ["导致", "causes", "leads_to"]
ENTITY_TYPES = ["person", "location", "object", "concept", "event"]
RELATION_TYPES = ["semantic", "causal", "spatial", "temporal", "project_state", "task_status", "config"]
CERTAINTIES = ["exact", "high", "medium", "low", "unknown"]
LAYERS = ["L0", "L1", "L2", "L3"]
COLD_TRIPLE_DAYS, COLD_FRAGMENT_DAYS, COLD_IMPORTANCE = 365, 180, 0.3


def _us(t: datetime) -> int:
    return int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))


def cold_triples(triples: DataFrame, now: datetime, days: int = COLD_TRIPLE_DAYS) -> Column:
    """Closed before the cutoff; current ones never."""
    return F.coalesce(micros(triples, "valid_to") < _us(now - timedelta(days=days)), F.lit(False))


def cold_fragments(fragments: DataFrame, now: datetime, days: int = COLD_FRAGMENT_DAYS, importance: float = COLD_IMPORTANCE) -> Column:
    """Ended before the cutoff, or not updated since and of little importance."""
    cutoff = _us(now - timedelta(days=days))
    stale = (micros(fragments, "updated_at") < cutoff) & (F.col("importance") <= importance)
    return F.coalesce(micros(fragments, "time_end") < cutoff, F.lit(False)) | F.coalesce(stale, F.lit(False))


def archive(df: DataFrame, cold: Column, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(hot, archived): the archive has archived_us and, where there is one, the embedding dropped."""
    gone = df.filter(cold).withColumn("archived_us", F.lit(_us(now)))
    if "embedding" in df.columns:
        gone = gone.withColumn("embedding", F.lit(None).cast(df.schema["embedding"].dataType))
    return df.filter(~cold), gone


def restore(hot: DataFrame, archived: DataFrame, wanted: Column) -> tuple[DataFrame, DataFrame]:
    """(hot, archived) with the wanted rows back, unless their id is hot already; current state is not touched."""
    back = archived.filter(wanted).drop("archived_us").join(hot.select("id").distinct(), "id", "left_anti")
    return hot.unionByName(back), archived.filter(~F.coalesce(wanted, F.lit(False)))


def query_archived(archived: dict[str, DataFrame], keyword: str, scope: Column | None = None, top_k: int = 50) -> DataFrame:
    """place, id, found_in, text of archived fragments and triples that hold the keyword, the latest first, top_k in all; an empty keyword is held by all."""
    thing = F.coalesce(F.when(F.length("object_id") > 0, F.col("object_id")), F.when(F.length("object_value") > 0, F.col("object_value")), F.lit("?"))
    texts = {"temporal_fragments": (F.col("content"), "time_start"), "triples": (F.concat_ws(" ", "subject_id", "predicate", thing), "valid_from")}
    parts = []
    for name, (text, at) in texts.items():
        if name in archived:
            rows = archived[name] if scope is None else archived[name].filter(scope)
            rows = rows.select("id", F.lit(name).alias("found_in"), text.alias("text"), F.col(at).cast("timestamp_ntz").alias("at"))
            parts.append((rows.filter(keyword_like(F.col("text"), keyword)) if keyword else rows).dropDuplicates(["id"]).orderBy(F.desc_nulls_last("at"), "id").limit(top_k))
    found = reduce(DataFrame.unionByName, parts).orderBy(F.desc_nulls_last("at"), "id").limit(top_k)
    # at most top_k rows
    return found.withColumn("place", F.row_number().over(W.orderBy(F.desc_nulls_last("at"), "id"))).select("place", "id", "found_in", "text")


def check_new(triples: DataFrame, incoming: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """new_id, kind, n, existing: how many rows there contradict each incoming triple, by kind, and the first of them.

    incoming: id and the columns of triples. For every row of its key
    (scope, subject_id, predicate) with another value the first kind that
    holds: causal (both causal and open), temporal (one closed, and they
    overlap), numeric, value; besides inverse: the reverse of a new cause is
    there. Counts, not pairs, so that a key of any size is reduced before the
    shuffle's end.
    """
    key = ["scope", "subject_id", "predicate"]
    value = F.coalesce(F.when(F.col("object_id") != "", F.col("object_id")), "object_value", F.lit(""))

    def sided(df: DataFrame, side: str, extra: list[str]) -> DataFrame:
        bounds = [micros(df, "valid_from").alias(f"a_{side}"), F.coalesce(micros(df, "valid_to"), F.lit(2**62)).alias(f"b_{side}"), F.col("valid_to").isNull().alias(f"open_{side}")]
        return df.select(*[F.col(k).alias(f"{k}_{side}") for k in [*key, "id", "relation_type", *extra]], value.alias(f"v_{side}"), *bounds).dropDuplicates([f"id_{side}"])

    old, new = sided(triples, "old", ["object_id"]), sided(incoming, "new", ["object_id"])
    pairs = new.join(old, [F.col(f"{k}_new").eqNullSafe(F.col(f"{k}_old")) for k in key]).filter("v_new <> v_old AND id_new <> id_old")
    x, y = first_number(F.col("v_new")), first_number(F.col("v_old"))
    both_open = F.col("open_new") & F.col("open_old")
    causal = (F.col("relation_type_new") == "causal") & (F.col("relation_type_old") == "causal") & both_open
    temporal = ~both_open & (F.col("a_new") < F.col("b_old")) & (F.col("a_old") < F.col("b_new"))
    numbers = x.isNotNull() & y.isNotNull()
    apart = F.try_divide(F.abs(x - y), F.greatest(F.abs(x), F.abs(y))) > tolerance
    single = F.col("relation_type_new").isin(STATE_TYPES) | F.col("relation_type_old").isin(STATE_TYPES) | F.col("predicate_new").isin(ENUM_PREDICATES)
    kind = F.when(causal, "causal").when(temporal, "temporal").when(both_open & numbers, F.when(apart, "numeric")).when(both_open & single, "value")
    cause = (F.col("relation_type_new") == "causal") & F.col("predicate_new").isin(CAUSE_PREDICATES)
    turned = (F.col("scope_new") == F.col("scope_old")) & (F.col("predicate_new") == F.col("predicate_old")) & (F.col("v_new") == F.col("subject_id_old")) & (F.col("subject_id_new") == F.col("object_id_old"))
    back = new.filter(cause).join(old.filter("relation_type_old = 'causal' AND open_old"), turned).select("id_new", F.lit("inverse").alias("kind"), "id_old")
    found = pairs.select("id_new", kind.alias("kind"), "id_old").filter("kind IS NOT NULL").unionByName(back)
    return found.groupBy(F.col("id_new").alias("new_id"), "kind").agg(F.count("*").alias("n"), F.min("id_old").alias("existing"))


def predicate_codes(triples: DataFrame) -> DataFrame:
    """predicate, code: a dictionary in order of the predicates, from 1; numbered over ranges, so of any size."""
    names = triples.select("predicate").filter("predicate IS NOT NULL").distinct()
    numbered = prefix_sum(names.withColumn("one", F.lit(1).cast("long")), [], ["predicate"], "one", "before")
    return numbered.select("predicate", (F.col("before") + 1).cast("int").alias("code"))


def contradictions(triples: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """id, kind of every current triple that another one of its (scope, subject_id, predicate) contradicts.

    kinds: causal (both causal), numeric (both values hold a number, more than
    tolerance apart), value (an attribute of one value or an enum predicate).
    Equal values contradict nothing. Whether a partner exists follows from the
    least and greatest value of each class of partners: partial aggregates, no
    pairs, so a key of any size costs one pass.
    """
    rows = triples.filter("valid_to IS NULL").select("id", "scope", "subject_id", "predicate", F.coalesce(F.when(F.col("object_id") != "", F.col("object_id")), "object_value").alias("v"), "relation_type").filter("v IS NOT NULL").dropDuplicates(["id"])
    rows = rows.withColumn("x", first_number(F.col("v"))).withColumn("c", F.when(F.col("relation_type") == "causal", "c").when(F.col("relation_type").isin(STATE_TYPES), "s").otherwise("o"))
    rows = rows.withColumn("c", F.concat("c", F.when(F.col("x").isNull(), "t").otherwise("n")))
    key = ["scope", "subject_id", "predicate"]
    classes = ["ct", "cn", "st", "sn", "ot", "on"]
    ends = [f(F.when(F.col("c") == c, F.col("v"))).alias(f"{n}_{c}") for c in classes for n, f in (("lo", F.min), ("hi", F.max))]
    numbers = [f(F.when(F.col("c").isin(cs), F.col("x"))).alias(f"{n}_{g}") for g, cs in (("causal", ["cn"]), ("plain", ["sn", "on"])) for n, f in (("lo", F.min), ("hi", F.max))]
    spans = rows.groupBy(*key).agg(*ends, *numbers, F.count("*").alias("rows")).filter("rows > 1")
    at = rows.join(spans, key)
    v, x, c = F.col("v"), F.col("x"), F.col("c")
    other = lambda *cs: reduce(Column.__or__, [F.coalesce((F.col(f"lo_{k}") != v) | (F.col(f"hi_{k}") != v), F.lit(False)) for k in cs])

    def apart(y: Column) -> Column:
        return F.coalesce(F.try_divide(F.abs(x - y), F.greatest(F.abs(x), F.abs(y))) > tolerance, F.lit(False))

    far = lambda g: apart(F.col(f"lo_{g}")) | apart(F.col(f"hi_{g}"))
    causal, number, single = c.startswith("c"), x.isNotNull(), c.startswith("s")
    enum = F.col("predicate").isin(ENUM_PREDICATES)
    # two causal triples contradict as such; numbers are compared across all but such pairs
    numeric = number & F.when(causal, far("plain")).otherwise(far("plain") | far("causal"))
    text_partner = F.when(causal, other("st", "ot")).otherwise(other("ct", "st", "ot"))
    any_partner = F.when(causal, other("st", "sn", "ot", "on")).otherwise(other(*classes))
    single_partner = F.when(number, other("st")).otherwise(other("st", "sn"))
    value = single_partner | ((single | enum) & F.when(number, text_partner).otherwise(any_partner))
    kinds = F.array_compact(F.array(F.when(causal & other("ct", "cn"), "causal"), F.when(numeric, "numeric"), F.when(value, "value")))
    return at.select("id", F.explode(kinds).alias("kind"))


def temporal_contradictions(triples: DataFrame) -> DataFrame:
    """id of every triple that overlaps one of its key (scope, subject_id, predicate) with another value, one of the two being closed.

    Counted, not paired. Closed ones: the stretches of each value (merged, so
    that a value never overlaps itself) that begin before the triple ends,
    less those that end by its start; more than the triple's own is a
    contradiction. The counts are prefix sums over the sorted bounds of the
    key. Open ones: of the other values' closed triples the last end counts.
    """
    from memspark.operators.intervals import periods

    key = ["scope", "subject_id", "predicate"]
    rows = triples.select("id", *key, F.coalesce(F.when(F.col("object_id") != "", F.col("object_id")), "object_value").alias("v"), micros(triples, "valid_from").alias("a"), F.coalesce(micros(triples, "valid_to"), F.lit(2**62)).alias("b"), F.col("valid_to").isNotNull().alias("closed"))
    rows = cut(rows.filter("a < b AND v IS NOT NULL").dropDuplicates(["id"]))
    runs = periods(rows, [*key, "v"], "a", "b")
    mark = lambda df, at, who, begins, ends, order: df.select(*key, F.col(at).alias("at"), F.lit(order).alias("o"), F.col(who).alias("who"), F.lit(begins).cast("long").alias("begins"), F.lit(ends).cast("long").alias("ends"))
    runs = runs.withColumn("who", F.concat(F.lit("run:"), F.md5("v")))
    asked = rows.filter("closed")
    # at one instant: ends, then the ask for a start, the ask for an end, then beginnings
    events = mark(runs, "period_end", "who", 0, 1, 0).unionByName(mark(asked, "a", "id", 0, 0, 1)).unionByName(mark(asked, "b", "id", 0, 0, 2)).unionByName(mark(runs, "period_start", "who", 1, 0, 3))
    summed = prefix_sums(events, key, ["at", "o", "who"], {"begins": "begun", "ends": "ended"})
    counts = summed.filter("o IN (1, 2)").groupBy(F.col("who").alias("id")).agg((F.max(F.when(F.col("o") == 2, F.col("begun"))) - F.max(F.when(F.col("o") == 1, F.col("ended")))).alias("n"))
    ends = asked.groupBy(*key, "v").agg(F.max("b").alias("b"))
    last = ends.groupBy(*key).agg(F.max_by("v", F.struct("b", "v")).alias("v1"), F.max("b").alias("b1"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    second = ends.alias("l").join(last.alias("r"), same).filter("l.v != v1").groupBy(*[F.col(f"l.{k}").alias(k) for k in key]).agg(F.max("l.b").alias("b2"))
    rest = last.alias("l").join(second.alias("r"), same, "left").select("l.*", "b2")
    open_ = rows.filter("NOT closed").alias("l").join(rest.alias("r"), same).filter(F.when(F.col("v") == F.col("v1"), F.col("b2")).otherwise(F.col("b1")) > F.col("a"))
    return counts.filter("n > 1").select("id").unionByName(open_.select("l.id"))


def inverse_causes(triples: DataFrame) -> DataFrame:
    """a, b (a < b): current causal triples of one predicate of which each states the reverse of the other; one row per scope and pair of entities, by their least ids."""
    rows = triples.filter(F.col("predicate").isin(CAUSE_PREDICATES) & F.col("valid_to").isNull() & F.col("object_id").isNotNull())
    rows = rows.groupBy("scope", "predicate", "subject_id", "object_id").agg(F.min("id").alias("id"))
    back = rows.select("scope", "predicate", F.col("subject_id").alias("object_id"), F.col("object_id").alias("subject_id"), F.col("id").alias("other"))
    return rows.join(back, ["scope", "predicate", "subject_id", "object_id"]).filter("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"))


def _keyed(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """triples with pattern: what the triple says, whatever project says it."""
    names = entities.groupBy("id").agg(F.min("entity_id").alias("entity_id"))
    s = names.select(F.col("id").alias("subject_id"), F.col("entity_id").alias("_s"))
    o = names.select(F.col("id").alias("object_id"), F.col("entity_id").alias("_o"))
    rows = triples.join(s, "subject_id", "left").join(o, "object_id", "left")
    thing = F.when(F.length("object_id") > 0, F.coalesce("_o", "object_id")).otherwise(F.concat(F.lit("value:"), normalize_value(F.col("object_value"))))
    return rows.withColumn("pattern", F.concat_ws("|", F.coalesce("_s", "subject_id"), "predicate", thing)).drop("_s", "_o")


def cross_project_patterns(triples: DataFrame, entities: DataFrame, min_projects: int = 3) -> DataFrame:
    """pattern, projects, support, representative (most confident, then least id) of what that many projects say now; states don't count."""
    now = triples.filter(F.col("scope").startswith("project:") & F.col("valid_to").isNull() & ~F.col("relation_type").isin(STATE_TYPES)).dropDuplicates(["id"])
    best = F.struct(-F.coalesce("confidence", F.lit(0.0)), F.col("id"))
    found = _keyed(now, entities).groupBy("pattern").agg(F.countDistinct("scope").alias("projects"), F.count("*").alias("support"), F.min_by("id", best).alias("representative"))
    return found.filter(F.col("projects") >= min_projects)


def promote(triples: DataFrame, entities: DataFrame, min_projects: int = 3) -> DataFrame:
    """The triples that global lacks: id, source, subject_key, predicate, object_key; a second run finds none."""
    have = _keyed(triples.filter("scope = 'global'"), entities).select(F.col("pattern").alias("have")).distinct()
    new = cross_project_patterns(triples, entities, min_projects).join(have, F.col("pattern") == F.col("have"), "left_anti")
    return _promoted(new)


def _promoted(new: DataFrame) -> DataFrame:
    """The global triples of patterns, by id of the pattern and the triple that stands for it."""
    parts = F.split("pattern", r"\|", 3)
    return new.select(F.sha2(F.concat(F.lit("global|"), "pattern"), 256).alias("id"), F.col("representative").alias("source"), parts[0].alias("subject_key"), parts[1].alias("predicate"), parts[2].alias("object_key"))


def manual_promote(triples: DataFrame, entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same for the wanted triples (column id), whichever projects say them; nothing for what global has or of which there is no such triple."""
    ids = wanted.select("id").distinct()
    rows = _keyed(triples.join(ids, "id", "left_semi").dropDuplicates(["id"]), entities)
    have = _keyed(triples.filter("scope = 'global'"), entities).select(F.col("pattern").alias("have")).distinct()
    new = rows.groupBy("pattern").agg(F.min("id").alias("representative")).join(have, F.col("pattern") == F.col("have"), "left_anti")
    return _promoted(new)


def global_entities(promoted: DataFrame, entities: DataFrame) -> DataFrame:
    """The entities that promoted triples need in global: id, entity_id, entity_type, name, scope, valid_from, source_closet.

    Copied from the first project entity of that entity_id, its id as
    source_closet; what global has, and keys that no entity has, make none.
    """
    keys = promoted.select(F.col("subject_key").alias("entity_id")).unionByName(promoted.select(F.col("object_key").alias("entity_id"))).distinct()
    have = entities.filter("scope = 'global'").select("entity_id").distinct()
    kept = ["id", "entity_type", "name", "valid_from"]
    source = entities.filter(F.col("scope").startswith("project:")).groupBy("entity_id").agg(F.min_by(F.struct(*kept), "id").alias("s"))
    rows = source.join(keys, "entity_id", "left_semi").join(have, "entity_id", "left_anti")
    return rows.select(F.sha2(F.concat(F.lit("global|entity|"), "entity_id"), 256).alias("id"), "entity_id", "s.entity_type", "s.name", F.lit("global").alias("scope"), "s.valid_from", F.col("s.id").alias("source_closet"))


def violations(entities: DataFrame, triples: DataFrame, fragments: DataFrame, locations: DataFrame, vectors: DataFrame) -> DataFrame:
    """check, n: rows that break a constraint of the model, over all tables; n may be 0."""
    bad = lambda ok: F.count_if(~F.coalesce(ok, F.lit(False)))
    scope = F.col("scope").rlike(r"^(?:global|project:.+|tenant:.+)$")
    unit = lambda c: F.col(c).isNull() | F.col(c).between(0, 1)
    checks = {
        "entities": (entities, {"entity_type": F.col("entity_type").isin(ENTITY_TYPES), "scope": scope}),
        "triples": (triples, {"relation_type": F.col("relation_type").isin(RELATION_TYPES), "certainty": F.col("certainty").isin(CERTAINTIES), "confidence": unit("confidence"), "causal_level": F.col("causal_level") >= 0, "object": F.col("object_id").isNotNull() | F.col("object_value").isNotNull(), "scope": scope}),
        "temporal_fragments": (fragments, {"layer": F.col("layer").isin(LAYERS), "importance": unit("importance"), "scope": scope}),
        "locations": (locations, {"latitude": F.col("coordinates").isNull() | F.col("coordinates.lat").between(-90, 90), "longitude": F.col("coordinates").isNull() | F.col("coordinates.lng").between(-180, 180)}),
        "vector_links": (vectors, {"owner": F.coalesce("entity_id", "triple_id", "fragment_id").isNotNull(), "dimension": F.col("embedding").isNull() | (F.size("embedding") == F.col("dimension"))}),
    }
    out = []
    for name, (df, tests) in checks.items():
        row = df.agg(*[bad(t).alias(c) for c, t in tests.items()])
        out.append(row.select(F.explode(F.array(*[F.struct(F.lit(f"{name}.{c}").alias("check"), F.col(c).alias("n")) for c in tests])).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, out)


def statistics(fragments: DataFrame, triples: DataFrame) -> DataFrame:
    """scope, layer, fragments, current_triples: counts; a layer is null for the triples."""
    f = fragments.groupBy("scope", "layer").agg(F.countDistinct("id").alias("n"))
    t = triples.filter("valid_to IS NULL").groupBy("scope").agg(F.countDistinct("id").alias("n")).select("scope", F.lit(None).cast("string").alias("layer"), "n")
    return f.unionByName(t)

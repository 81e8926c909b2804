"""Starting a project from seeds: entities resolved or created, triples added once, and what is still unknown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_or_create(wanted: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scope, entity_id, id) of every wanted entity (scope, entity_id, entity_type, name), and the new rows among them.

    One of the scope counts first, then a global one, the least id of each;
    else an id follows from (scope, entity_id), so a second run finds it.
    Wanted rows without a key are none; of several names the least counts.
    """
    keys = wanted.filter("entity_id IS NOT NULL").groupBy("scope", "entity_id").agg(F.min("entity_type").alias("entity_type"), F.min("name").alias("name"))
    own = entities.groupBy(F.col("scope").alias("_scope"), F.col("entity_id").alias("_key")).agg(F.min("id").alias("_own"))
    shared = own.filter("_scope = 'global'").select(F.col("_key").alias("_gkey"), F.col("_own").alias("_global"))
    at = keys.join(own, (F.col("scope") == F.col("_scope")) & (F.col("entity_id") == F.col("_key")), "left").join(shared, F.col("entity_id") == F.col("_gkey"), "left")
    made = F.sha2(F.concat_ws("|", F.lit("seed"), "scope", "entity_id"), 256)
    at = at.withColumn("known", F.coalesce("_own", "_global")).withColumn("id", F.coalesce("known", made))
    return at.select("scope", "entity_id", "id"), at.filter("known IS NULL").select("id", "entity_id", "entity_type", "name", "scope")


def seeded(seeds: DataFrame, entities: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entities and triples that seeds add: (scope, subject_key, predicate, object_key, object), each triple once by scope, subject, predicate and object."""
    ends = [seeds.select("scope", F.col(k).alias("entity_id"), F.lit("concept").alias("entity_type"), n.alias("name")) for k, n in (("subject_key", F.col("subject_key")), ("object_key", F.col("object")))]
    ids, new = resolve_or_create(ends[0].unionByName(ends[1]), entities)
    of = lambda k, out: ids.select("scope", F.col("entity_id").alias(k), F.col("id").alias(out))
    rows = seeds.join(of("subject_key", "subject_id"), ["scope", "subject_key"]).join(of("object_key", "object_id"), ["scope", "object_key"])
    key = ["scope", "subject_id", "predicate", "object_id"]
    fresh = rows.select(*key).distinct().join(triples.select(*key).distinct(), key, "left_anti")
    return new, fresh.select(F.sha2(F.concat_ws("|", F.lit("seed"), *key), 256).alias("id"), *key)


def unknown(triples: DataFrame, expected: Sequence[str]) -> DataFrame:
    """scope, predicate: what every project is asked next, the expected predicates of which it says nothing that holds now."""
    scopes = triples.filter(F.col("scope").startswith("project:")).select("scope").distinct()
    said = triples.filter("valid_to IS NULL").select("scope", "predicate").distinct()
    return scopes.select("scope", F.explode(F.array(*map(F.lit, expected))).alias("predicate")).join(said, ["scope", "predicate"], "left_anti")

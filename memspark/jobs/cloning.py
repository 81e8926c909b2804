"""Copies of a scope: clone, export as a package, import."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.1"
TABLES = ("entities", "triples", "temporal_fragments", "locations")


@dataclass(frozen=True)
class CloneFilter:
    """What to copy; None is no limit."""

    entity_types: tuple[str, ...] | None = None
    layers: tuple[str, ...] | None = None
    since: datetime | None = None
    until: datetime | None = None
    current_only: bool = True


def _within(df: DataFrame, column: str, f: CloneFilter) -> DataFrame:
    if f.since is not None:
        df = df.filter(F.col(column) >= F.lit(f.since))
    return df if f.until is None else df.filter(F.col(column) <= F.lit(f.until))


def clone(tables: dict[str, DataFrame], source: str, target: str, what: CloneFilter = CloneFilter()) -> dict[str, DataFrame]:
    """The new rows of each table in the target scope; ids follow from (target, old id), so a second run adds nothing.

    Entities merge by entity_id and locations by location_id with those that
    the target has; triples merge by (subject, predicate, object, value),
    fragments by fragment_id. Triples whose ends aren't copied are dropped, of
    predecessors and parents that aren't the link is. Layer L3 is never copied.
    """
    new_id = lambda c: F.sha2(F.concat_ws("|", F.lit(target), c), 256)
    part = {n: tables[n].filter(F.col("scope") == source).dropDuplicates(["id"]) for n in TABLES}
    there = {n: tables[n].filter(F.col("scope") == target).dropDuplicates(["id"]) for n in TABLES}
    now = F.col("valid_to").isNull() if what.current_only else F.lit(True)

    def merged(name: str, key: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        have = there[name].groupBy(F.col(key).alias("_key")).agg(F.min("id").alias("_have"))
        first = rows.groupBy(F.col(key).alias("_same")).agg(F.min("id").alias("_first"))
        rows = rows.join(first, F.col(key) == F.col("_same")).join(have, F.col(key) == F.col("_key"), "left")
        ids = rows.select("id", F.coalesce("_have", new_id(F.col("_first"))).alias("new_id"))
        fresh = rows.filter("_have IS NULL AND id = _first").drop("_have", "_key", "_same", "_first")
        return ids, fresh.withColumn("source_id", F.col("id")).withColumn("id", new_id(F.col("id"))).withColumn("scope", F.lit(target))

    e = _within(part["entities"].filter(now), "valid_from", what)
    e = e if what.entity_types is None else e.filter(F.col("entity_type").isin(list(what.entity_types)))
    entity_ids, entities = merged("entities", "entity_id", e)
    location_ids, locations = merged("locations", "location_id", part["locations"].filter(now))
    parents = location_ids.select(F.col("id").alias("parent_id"), F.col("new_id").alias("_parent"))
    locations = locations.join(parents, "parent_id", "left").withColumn("parent_id", F.col("_parent")).drop("_parent")

    as_ = lambda c, out: entity_ids.select(F.col("id").alias(c), F.col("new_id").alias(out))
    t = _within(part["triples"].filter(now), "valid_from", what).join(as_("subject_id", "_s"), "subject_id").join(as_("object_id", "_o"), "object_id", "left").filter("object_id IS NULL OR _o IS NOT NULL")
    four = [F.col("_s").alias("s"), F.col("predicate").alias("p"), F.coalesce("_o", F.lit("")).alias("o"), F.coalesce("object_value", F.lit("")).alias("v")]
    t = t.withColumn("_four", F.md5(F.to_json(F.struct(*four))))
    keep = t.groupBy("_four").agg(F.min("id").alias("id"))
    have = there["triples"].select(F.md5(F.to_json(F.struct(F.col("subject_id").alias("s"), F.col("predicate").alias("p"), F.coalesce("object_id", F.lit("")).alias("o"), F.coalesce("object_value", F.lit("")).alias("v")))).alias("_four")).distinct()
    t = t.join(keep, ["_four", "id"], "left_semi").join(have, "_four", "left_anti")
    priors = t.select(F.col("id").alias("predecessor_id"), new_id(F.col("id")).alias("_prior"))
    triples = t.join(priors, "predecessor_id", "left").withColumn("source_id", F.col("id")).withColumns({"id": new_id(F.col("id")), "subject_id": F.col("_s"), "object_id": F.col("_o"), "predecessor_id": F.col("_prior"), "scope": F.lit(target)}).drop("_s", "_o", "_prior", "_four")

    f = _within(part["temporal_fragments"].filter("layer <> 'L3'"), "time_start", what)
    f = f if what.layers is None else f.filter(F.col("layer").isin(list(what.layers)))
    _, fragments = merged("temporal_fragments", "fragment_id", f)
    places = location_ids.select(F.col("id").alias("location_id"), F.col("new_id").alias("_place"))
    fragments = fragments.join(places, "location_id", "left").withColumn("location_id", F.col("_place")).drop("_place")
    # lists of entities keep their order; entities that aren't copied leave them
    each = fragments.select("id", F.posexplode("entities").alias("at", "entity")).join(entity_ids.select(F.col("id").alias("entity"), "new_id"), "entity")
    lists = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new_id"))), lambda x: x["new_id"]).alias("_entities"))
    fragments = fragments.join(lists, "id", "left").withColumn("entities", F.coalesce("_entities", F.array().cast("array<string>"))).drop("_entities")
    return {"entities": entities, "triples": triples, "temporal_fragments": fragments, "locations": locations}


def export_package(tables: dict[str, DataFrame], scope: str, path: str) -> None:
    """Writes the rows of a scope as JSON lines, a folder per table, with a version."""
    for n in TABLES:
        tables[n].filter(F.col("scope") == scope).dropDuplicates(["id"]).write.mode("overwrite").json(f"{path}/{n}", ignoreNullFields=False)
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(VERSION, scope)], "version string, scope string").write.mode("overwrite").json(f"{path}/manifest")


def import_package(spark: SparkSession, path: str, like: dict[str, DataFrame]) -> tuple[str, dict[str, DataFrame]]:
    """The scope and the tables of a package, with the schemas of `like`; other major versions are refused."""
    manifest = spark.read.schema("version string, scope string").json(f"{path}/manifest").first()
    if manifest is None or manifest["version"].split(".")[0] != VERSION.split(".")[0]:
        raise ValueError(f"no package of version {VERSION}: {path}")
    return manifest["scope"], {n: spark.read.schema(like[n].schema).json(f"{path}/{n}") for n in TABLES}

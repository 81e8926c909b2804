"""Writing: idempotent sinks of every table, deletion of vectors, layouts that stand for indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.sources.importers import new_rows

#: What makes a record of each table one: the sinks add none twice.
KEYS = {
    "entities": ["scope", "entity_id"],
    "triples": ["scope", "subject_id", "predicate", "object_id", "object_value", "valid_from"],
    "locations": ["scope", "location_id"],
    "temporal_fragments": ["scope", "fragment_id"],
    "vector_links": ["vector_db", "vector_id"],
}
#: The order in which rows are laid out, so that the statistics of files and row groups serve the filters of retrieval.
ORDERS = {
    "entities": ["scope", "entity_id"],
    "triples": ["scope", "subject_id", "predicate", "valid_from"],
    "locations": ["scope", "path"],
    "temporal_fragments": ["scope", "time_start"],
    "vector_links": ["vector_db", "vector_id"],
    "postings": ["gram", "key"],
}


def appended(name: str, incoming: DataFrame, have: DataFrame) -> DataFrame:
    """The incoming rows of a table that it lacks, each key once; columns that the table has and the rows don't are null."""
    if name not in KEYS:
        raise ValueError(f"no such table: {name!r}")
    rows = new_rows(incoming, have, KEYS[name])
    return rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in have.schema])


def sink(name: str, incoming: DataFrame, path: str) -> None:
    """Appends to the table at path what it lacks, in its layout."""
    have = incoming.sparkSession.read.parquet(path)
    laid_out(name, appended(name, incoming, have)).write.mode("append").parquet(path)


def laid_out(name: str, df: DataFrame) -> DataFrame:
    """df in ranges of the table's order and sorted within them: a filter on its first columns skips files and row groups."""
    order = [c for c in ORDERS[name] if c in df.columns]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def bucketed(df: DataFrame, table: str, keys: list[str], buckets: int) -> None:
    """Writes df as a table of the catalogue in buckets of the keys: joins and groups on them need no exchange."""
    df.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(table)


def without_vectors(links: DataFrame, gone: DataFrame) -> DataFrame:
    """links but those that stand for what is gone (column id: an entity, triple or fragment)."""
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    for c in ("entity_id", "triple_id", "fragment_id"):
        links = links.join(ids, F.col(c) == F.col("_gone"), "left_anti")
    return links

"""Queries p1, p2, p6 and p7 over the tables of a folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.operators import hierarchy as H
from memspark.operators.history import history
from memspark.operators.intervals import gaps, periods
from memspark.operators.references import check_references, parent_spans
from memspark.tables import micros, stripped, table

#: Relation types whose triples state the value of an attribute.
STATE_TYPES = ["project_state", "task_status", "config"]
STATE_KEY = ["scope", "subject_id", "predicate"]


def _coverage(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "temporal_fragments")
    return f.select("scope", micros(f, "time_start").alias("start_us"), micros(f, "time_end").alias("end_us"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The gaps between the fragments of each scope."""
    return gaps(_coverage(spark, folder), ["scope"], "start_us", "end_us").withColumnsRenamed({"gap_start": "gap_start_us", "gap_end": "gap_end_us"})


def p1_periods(spark: SparkSession, folder: str) -> DataFrame:
    """The continuous periods of each scope."""
    return periods(_coverage(spark, folder), ["scope"], "start_us", "end_us").withColumnsRenamed({"period_start": "period_start_us", "period_end": "period_end_us"})


def _locations(spark: SparkSession, folder: str) -> DataFrame:
    blank = F.col("parent_id").rlike(r"(?U)^\s*$")
    return table(spark, folder, "locations").select("id", F.when(~blank, F.col("parent_id")).alias("parent_id"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Root and depth of every location; cycles told apart."""
    return H.hierarchy(_locations(spark, folder)).select("id", "root_id", "depth")


def p2_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Every location with its full path, depth, root and the number of its descendants."""
    return H.hierarchy(_locations(spark, folder), with_path=True).select("id", "root_id", "depth", "path", "n_descendants")


def p2_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every location with every descendant."""
    return H.descendants(H.hierarchy(_locations(spark, folder)))


def _updates(spark: SparkSession, folder: str) -> DataFrame:
    t, p = table(spark, folder, "triples"), table(spark, folder, "project_current_state")
    value = F.when(F.col("object_id").rlike(r"(?U)\S"), F.col("object_id")).otherwise(stripped(F.col("object_value"))).alias("value")
    of_triples = t.filter(F.col("scope").startswith("project:") & F.col("relation_type").isin(STATE_TYPES))
    of_triples = of_triples.select(*STATE_KEY, micros(t, "valid_from").alias("from_us"), micros(t, "valid_to").alias("to_us"), value, F.struct(F.lit(1).alias("first"), F.col("id").alias("id"), F.lit("").alias("v")).alias("rank"))
    # rows of one key and time that differ have no id to tell them apart: the greatest value counts
    of_state = p.select(*STATE_KEY, micros(p, "valid_from").alias("from_us"), F.lit(None).cast("long").alias("to_us"), value).withColumn("rank", F.struct(F.lit(0).alias("first"), F.lit("").alias("id"), F.coalesce("value", F.lit("")).alias("v")))
    return of_triples.unionByName(of_state)


def _history(spark: SparkSession, folder: str) -> DataFrame:
    return history(_updates(spark, folder), STATE_KEY, "predicate")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every version of every state value, with its period."""
    return _history(spark, folder).select(*STATE_KEY, "from_us", F.coalesce("to_us", F.lit(-1).cast("long")).alias("to_us"))


def p6_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the value each version had."""
    return _history(spark, folder).select(*STATE_KEY, "value", "from_us", F.coalesce("to_us", F.lit(-1).cast("long")).alias("to_us"))


#: table, reference column, time of the row, target
REFERENCES = [
    ("vector_links", "fragment_id", "created_at", "temporal_fragments"),
    ("temporal_fragments", "location_id", "time_start", "locations"),
    ("triples", "subject_id", "valid_from", "entities"),
    ("triples", "object_id", "valid_from", "entities"),
]


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    def refs(name: str, column: str, at: str, target: str) -> DataFrame:
        t = table(spark, folder, name)
        return t.select(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), F.col("id").alias("row_id"), F.lit(target).alias("target"), F.col(column).alias("reference"), micros(t, at).alias("at_us"))

    def spans(target: str, closes: bool) -> DataFrame:
        t = table(spark, folder, target)
        t = t.select("id", micros(t, "valid_from").alias("b"), micros(t, "valid_to").alias("e")) if closes else t.select("id")
        return parent_spans(t, "id", *(("b", "e") if closes else (None, None))).withColumn("target", F.lit(target))

    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    parents = union([spans("temporal_fragments", False), spans("locations", True), spans("entities", True)])
    return check_references(union([refs(*r) for r in REFERENCES]), parents)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The rows whose reference names a record that is absent or closed."""
    return _checked(spark, folder).filter(F.col("status").isin("missing", "closed")).select("table_name", "column_name", "row_id").distinct()


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with such references (and with late ones, which are no orphans) per table, column and month."""
    rows = _checked(spark, folder).filter("status != 'ok'").select("table_name", "column_name", "row_id", "status", "at_us").distinct()
    month = F.date_format(F.timestamp_micros("at_us"), "yyyy-MM")
    return rows.groupBy("table_name", "column_name", "status", month.alias("month")).agg(F.count("*").alias("n_rows"))


QUERIES = {q.__name__: q for q in (p1_found, p1_periods, p2_found, p2_paths, p2_descendants, p6_found, p6_versions, p7_found, p7_report)}

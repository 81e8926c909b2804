"""Rows valid at a time or in a range, timelines, current state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current() -> Column:
    return F.col("valid_to").isNull()


def valid_at(t: datetime) -> Column:
    """[valid_from, valid_to) holds t; no valid_to is no end."""
    return (F.col("valid_from") <= F.lit(t)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(t)))


def valid_in(start: datetime, end: datetime) -> Column:
    """The closed interval meets the closed range."""
    return (F.col("valid_from") <= F.lit(end)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.lit(start)))


def query_at_time(df: DataFrame, t: datetime, scope: Column | None = None) -> DataFrame:
    """Rows valid at t, each id once; filters reach the scan and come before ids are compared. In order of valid_from, id."""
    return df.filter(valid_at(t) if scope is None else valid_at(t) & scope).dropDuplicates(["id"]).orderBy("valid_from", "id")


def query_in_range(df: DataFrame, start: datetime, end: datetime, scope: Column | None = None, limit: int | None = None) -> DataFrame:
    """Rows valid at some time of the range, each id once, in order of valid_from, id; the first `limit` of them."""
    if end < start:
        raise ValueError("the range ends before it starts")
    rows = df.filter(valid_in(start, end) if scope is None else valid_in(start, end) & scope).dropDuplicates(["id"]).orderBy("valid_from", "id")
    return rows if limit is None else rows.limit(limit)


def timeline(triples: DataFrame, entities: DataFrame, as_subject: bool = True, as_object: bool = True) -> DataFrame:
    """entity, role and the triple, for every entity (column id) and role: a triple from an entity to itself comes twice."""
    if not (as_subject or as_object):
        raise ValueError("neither role is asked for")
    ids = entities.select(F.col("id").alias("entity")).distinct()
    roles = [(as_subject, "subject_id", "subject"), (as_object, "object_id", "object")]
    made = [triples.join(ids, F.col(c) == F.col("entity")).dropDuplicates(["id"]).withColumn("role", F.lit(r)) for wanted, c, r in roles if wanted]
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def fold_range(exact: datetime | None, start: datetime | None, end: datetime | None, now: datetime) -> tuple[datetime, datetime] | None:
    """The range a request for a time means: an instant, or a span whose open side is now; None if it names neither."""
    if exact is not None:
        return exact, exact
    return None if start is None and end is None else (start or now, end or now)

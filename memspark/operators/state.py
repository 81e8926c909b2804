"""Current state by last write, with what each write supersedes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.operators.prefix import neighbour, ranged

#: Relation types whose triples state the one value of a key.
STATE_TYPES = ["project_state", "task_status", "config"]
KEY = ["scope", "subject_id", "predicate"]


def state_rows(triples: DataFrame) -> DataFrame:
    return triples.filter(F.col("scope").startswith("project:") & F.col("relation_type").isin(STATE_TYPES))


def current_state(triples: DataFrame, order: str = "arrival") -> DataFrame:
    """Per (scope, subject_id, predicate) the last write: by arrival (id order), or by valid_from and then arrival.

    A partial aggregate, so a key of any size is reduced before the shuffle.
    """
    if order not in ("arrival", "event_time"):
        raise ValueError(f"no order: {order!r}")
    last = F.struct("id") if order == "arrival" else F.struct("valid_from", "id")
    kept = ["object_id", "object_value", "valid_from", "confidence", "id"]
    return state_rows(triples).groupBy(*KEY).agg(F.max_by(F.struct(*kept), last).alias("s")).select(*KEY, "s.*")


def superseded(triples: DataFrame) -> DataFrame:
    """Every state write with closed_at (valid_from of the next arrival, null if it stands) and predecessor (the write before, if its value differs)."""
    rows = state_rows(triples).select(*KEY, "id", "valid_from", F.coalesce("object_id", "object_value").alias("value")).distinct()
    rows = ranged(rows, KEY, ["id"])
    rows = neighbour(rows, KEY, "id", ["id", "value"], "before", forward=False)
    rows = neighbour(rows, KEY, "id", ["valid_from"], "after", forward=True)
    differs = F.col("before").isNotNull() & ~F.col("before.value").eqNullSafe(F.col("value"))
    return rows.select(*KEY, "id", "valid_from", F.col("after.valid_from").alias("closed_at"), F.when(differs, F.col("before.id")).alias("predecessor"))


def write_conflicts(triples: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming writes (KEY, value) that differ from a current row of their key: KEY, value, existing (the first such id)."""
    open_ = triples.filter("valid_to IS NULL").select(*KEY, F.coalesce("object_id", "object_value").alias("existing_value"), F.col("id").alias("existing"))
    found = incoming.join(open_, KEY).filter(~F.col("value").eqNullSafe(F.col("existing_value")))
    return found.groupBy(*KEY, "value").agg(F.min("existing").alias("existing"))


def merged_maps(base: str, ours: str, theirs: str, prefer: str = "theirs"):
    """Three-way merge of map columns: a change of one side is taken, of both the preferred one; a key that a side removed and the other left is gone."""
    if prefer not in ("ours", "theirs"):
        raise ValueError(f"no side: {prefer!r}")
    b, o, t = (F.coalesce(F.col(c), F.create_map().cast("map<string,string>")) for c in (base, ours, theirs))
    keys = F.array_distinct(F.concat(F.map_keys(b), F.map_keys(o), F.map_keys(t)))

    def value(k):
        x, y, z = (F.try_element_at(m, k) for m in (b, o, t))
        mine, other = ~y.eqNullSafe(x), ~z.eqNullSafe(x)
        return F.when(mine & other, z if prefer == "theirs" else y).when(mine, y).when(other, z).otherwise(x)

    return F.map_from_entries(F.filter(F.transform(keys, lambda k: F.struct(k.alias("key"), value(k).alias("value"))), lambda e: e["value"].isNotNull()))


# What is done about a conflict of each kind.
STRATEGIES = {"version_stale": "auto_merge", "write_write": "auto_last", "read_write": "auto_last", "causal_cycle": "rollback", "causal_contradiction": "manual"}


def strategy(kind):
    """The strategy for a conflict of this kind (a column); null for none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in STRATEGIES.items() for x in pair]), kind)


def version_conflicts(writes: DataFrame, incoming: DataFrame) -> DataFrame:
    """resource_id, chain_id, kind, strategy, current_version, other_chain_id of incoming writes that don't fit what is there.

    writes: resource_id, chain_id, at, a row per commit (its number is the
    version). incoming: resource_id, chain_id, expected_version, base_version.
    version_stale: an expected version that isn't the current one; else
    write_write: one based on an older version of what exists.
    """
    now = writes.groupBy("resource_id").agg(F.count("*").alias("current"), F.max_by("chain_id", F.struct("at", "chain_id")).alias("other_chain_id"))
    at = incoming.join(now, "resource_id", "left").withColumn("current_version", F.coalesce("current", F.lit(0)))
    stale = F.col("expected_version").isNotNull() & (F.col("expected_version") != F.col("current_version"))
    kind = F.when(stale, "version_stale").when(F.col("current").isNotNull() & (F.col("base_version") < F.col("current_version")), "write_write")
    return at.withColumn("kind", kind).filter("kind IS NOT NULL").select("resource_id", "chain_id", "kind", strategy(F.col("kind")).alias("strategy"), "current_version", "other_chain_id")


def read_write_conflicts(writes: DataFrame, reads: DataFrame, window_s: float = 60.0) -> DataFrame:
    """resource_id, chain_id, read_at, kind, strategy, other_chain_id of reads (resource_id, chain_id, at) that another chain's last write made stale within the window."""
    now = writes.groupBy("resource_id").agg(F.max(F.struct("at", "chain_id")).alias("w"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = reads.withColumnRenamed("at", "read_at").join(now, "resource_id")
    late = us("w.at") - us("read_at")
    rows = rows.filter((F.col("w.chain_id") != F.col("chain_id")) & (late > 0) & (late <= window_s * 1e6)).withColumn("kind", F.lit("read_write"))
    return rows.select("resource_id", "chain_id", "read_at", "kind", strategy(F.col("kind")).alias("strategy"), F.col("w.chain_id").alias("other_chain_id"))

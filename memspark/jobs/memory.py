"""Fragments: consolidation, forgetting, summaries, near-duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark.functions.text import compact, rule_summary
from memspark.operators.components import components
from memspark.operators.prefix import prefix_sum
from memspark.tables import cut, micros

# What marks texts made by a job.
CONSOLIDATED, SUMMARY, SUMMARY_ID = "【聚合】", "【摘要】", ":summary"
PROTECTED, HALF_LIFE_DAYS, FORGOTTEN = 0.9, 30.0, 0.1
#: Characters up to which members are joined in one text.
MOST_TEXT = 1 << 20


def consolidate(fragments: DataFrame, layer: str = "L1", target: str = "L2", head: int = 50, most_text: int = MOST_TEXT) -> tuple[DataFrame, DataFrame]:
    """New fragments, one per scope and set of entities of two or more fragments of the layer, and their members.

    A null list of entities is an empty one. members: group_id, position, id
    and text (the first `head` characters) of each fragment replaced, in order
    of id, a row each, so that a group of any size is no single row. The
    content joins these texts where they have most_text characters at most,
    else it is null and stands in the members.
    """
    names = F.array_sort(F.coalesce("entities", F.array().cast("array<string>")))
    kept = ["id", "scope", "relations", "importance", "time_start", "time_end", "updated_at", "access_count"]
    rows = fragments.filter(F.col("layer") == layer).select(*kept, names.alias("names"), F.substring("content", 1, head).alias("text")).dropDuplicates(["id"])
    rows = cut(rows.withColumn("key", F.md5(F.to_json(F.struct("scope", "names")))))
    each = rows.groupBy("key").agg(
        F.first("scope").alias("scope"), F.first("names").alias("names"), F.count("*").alias("n"), F.max("importance").alias("importance"), F.min("time_start").alias("time_start"), F.max("time_end").alias("time_end"),
        F.max("updated_at").alias("updated_at"), F.sum("access_count").alias("access_count"), F.min("id").alias("first"), F.bit_xor(F.xxhash64("id")).alias("mix"), F.sum(F.coalesce(F.length("text"), F.lit(0)) + 2).alias("chars"),
    ).filter("n >= 2")
    each = cut(each.withColumn("id", F.sha2(F.concat_ws("|", F.lit(target), "key", "first", F.col("n").cast("string"), F.col("mix").cast("string")), 256)))
    grouped = rows.join(each.select("key", F.col("id").alias("group_id"), "chars"), "key")
    # as many names as there are kinds of relations
    relations = grouped.select("group_id", F.explode("relations").alias("relation")).distinct().groupBy(F.col("group_id").alias("id")).agg(F.array_sort(F.collect_list("relation")).alias("relations"))
    parts = grouped.filter(F.col("chars") <= most_text).groupBy(F.col("group_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("member"), "text"))).alias("parts"))
    label = F.when(F.size("names") > 0, F.array_join("names", ",")).otherwise(F.col("scope"))
    body = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), "; ")
    content = F.concat(F.lit(CONSOLIDATED), label, F.lit(":"), F.col("n").cast("string"), F.lit(" 条记忆聚合 — "), body)
    new = each.join(relations, "id", "left").join(parts, "id", "left")
    new = new.select("id", "scope", F.lit(target).alias("layer"), F.col("names").alias("entities"), F.coalesce("relations", F.array().cast("array<string>")).alias("relations"), content.alias("content"), "importance", "time_start", "time_end", "updated_at", "access_count", F.col("n").alias("members"))
    members = prefix_sum(grouped.select("group_id", "id", "text", F.lit(1).cast("long").alias("one")), ["group_id"], ["id"], "one", "position")
    return new, members.select("group_id", "position", "id", "text")


def retention(df: DataFrame, now: datetime) -> Column:
    """importance * 0.5 ** (days since the last update or access / 30) * min(3, 1 + log10(1 + accesses)); null importance as 0."""
    last = F.greatest(micros(df, "updated_at"), micros(df, "last_accessed_at"))
    age = F.greatest((F.lit(int(now.timestamp() * 1_000_000)) - last) / 86_400e6, F.lit(0.0))
    heat = F.least(F.lit(3.0), 1 + F.log10(1 + F.coalesce("access_count", F.lit(0))))
    return F.coalesce("importance", F.lit(0.0)) * F.pow(F.lit(0.5), age / HALF_LIFE_DAYS) * heat


def forget(fragments: DataFrame, now: datetime) -> DataFrame:
    """fragments with score and verdict: protected, expired, decayed or kept, in this order of tests."""
    rows = fragments.withColumn("score", retention(fragments, now))
    ended = micros(fragments, "time_end") < int(now.timestamp() * 1_000_000)
    return rows.withColumn("verdict", F.when(F.col("importance") >= PROTECTED, "protected").when(ended, "expired").when(F.col("score") < FORGOTTEN, "decayed").otherwise("kept"))


def over_capacity(fragments: DataFrame, now: datetime, cap: int) -> DataFrame:
    """scope, id of what a scope with more than cap fragments drops: the lowest (score, id) that aren't protected.

    The number to drop comes from counts; the order within a scope from
    positions over ranges, so a scope of any size is no single task.
    """
    rows = fragments.select("scope", "id", "importance", retention(fragments, now).alias("score")).dropDuplicates(["id"])
    excess = rows.groupBy("scope").agg((F.count("*") - cap).alias("excess")).filter("excess > 0")
    open_ = rows.filter(F.coalesce(F.col("importance") < PROTECTED, F.lit(True))).join(excess, "scope").withColumn("one", F.lit(1).cast("long"))
    return prefix_sum(open_, ["scope"], ["score", "id"], "one", "before").filter("before < excess").select("scope", "id")


def summarize(fragments: DataFrame, layer: str = "L1", longer: int = 500, length: int = 120) -> DataFrame:
    """Summaries of the layer's longer fragments that have none yet: id, fragment_id, content and the rest as in the source. One per fragment_id, that of the least id."""
    rows = fragments.filter((F.col("layer") == layer) & (F.length("content") > longer)).withColumn("summary_id", F.concat("fragment_id", F.lit(SUMMARY_ID)))
    have = fragments.select(F.col("fragment_id").alias("have")).distinct()
    rows = rows.join(have, F.col("summary_id") == F.col("have"), "left_anti")
    first = rows.groupBy("summary_id").agg(F.min_by(F.struct("id", "content", "scope", "layer", "importance"), "id").alias("s"))
    return first.select(F.sha2(F.concat_ws("|", F.lit("summary"), "s.id"), 256).alias("id"), F.col("summary_id").alias("fragment_id"), F.concat(F.lit(SUMMARY), rule_summary(F.col("s.content"), length)).alias("content"), "s.scope", "s.layer", "s.importance", F.col("s.id").alias("source_id"))


#: Columns of the incidence matrices that are multiplied at a time.
COLUMNS = 4096


def _grams(text: str) -> np.ndarray:
    """The distinct pairs of neighbouring characters as numbers, sorted; of a single character itself."""
    p = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.unique((p[:-1] << np.uint64(21)) | p[1:]) if len(p) > 1 else p


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n, the number of distinct bigrams of every norm."""
    for batch in batches:
        n = pa.array([len(_grams(t)) for t in batch.column("norm").to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, n], names=[*batch.schema.names, "n"])


def _scored(similarity: float) -> Callable[[pa.Table], pa.Table]:
    """Every pair of a block (side 0 alone) or of two blocks (side 0 with side 1) that is that similar."""

    def run(rows: pa.Table) -> pa.Table:
        ids, sides = np.array(rows.column("id").to_pylist(), object), np.array(rows.column("side").to_pylist())
        grams = [_grams(t) for t in rows.column("norm").to_pylist()]
        left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        alone = not len(right)
        right = left if alone else right
        sizes = np.array([len(g) for g in grams])
        place = np.zeros(len(ids), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        owner = np.repeat(np.arange(len(ids)), sizes)
        _, column = np.unique(np.concatenate(grams), return_inverse=True)
        # only bigrams that both sides have (or two texts of one side) add to an intersection
        of = sides[owner]
        counts = [np.bincount(column[of == k], minlength=column.max(initial=-1) + 1) for k in (0, 1)]
        shared = counts[0] > 1 if alone else (counts[0] > 0) & (counts[1] > 0)
        number = np.cumsum(shared) - 1
        kept = shared[column]
        owner, column = owner[kept], number[column[kept]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((len(left), len(right)), np.float64)
        for c in range(0, int(shared.sum()), COLUMNS):
            at = slice(*np.searchsorted(column, [c, c + COLUMNS]))
            o, k = owner[at], column[at] - c
            a = np.zeros((len(left), COLUMNS), np.float32)
            a[place[o[sides[o] == 0]], k[sides[o] == 0]] = 1
            b = a
            if not alone:
                b = np.zeros((len(right), COLUMNS), np.float32)
                b[place[o[sides[o] == 1]], k[sides[o] == 1]] = 1
            both += a @ b.T
        score = both / np.maximum(sizes[left][:, None] + sizes[right][None, :] - both, 1)
        x, y = np.nonzero(np.triu(score >= similarity, 1) if alone else score >= similarity)
        one, two = ids[left[x]], ids[right[y]]
        swap = one > two
        return pa.table({"a": pa.array(np.where(swap, two, one), pa.string()), "b": pa.array(np.where(swap, one, two), pa.string()), "jaccard": pa.array(score[x, y], pa.float64())})

    return run


def _classes(rows: DataFrame, shortest: int) -> tuple[DataFrame, DataFrame]:
    """rows (with id, scope, layer, content) with `text`, the hash of their normalised text, for content; and the classes of equal texts: id (the least), scope, layer, text, norm, written."""
    made = rows.withColumn("norm", compact(F.col("content"))).filter(F.length("norm") >= shortest).withColumn("text", F.md5("norm")).drop("content")
    classes = made.groupBy("scope", "layer", "text").agg(F.min("id").alias("id"), F.first("norm").alias("norm"))
    return made.drop("norm"), cut(classes.select("id", "scope", "layer", "text", "norm"))


def near_duplicates(fragments: DataFrame, similarity: float = 0.7, shortest: int = 12, block: int = 1 << 18) -> DataFrame:
    """a, b, jaccard: all links between different texts of one scope and layer whose bigram sets are that similar.

    Equal normalised texts are one class (its least id stands for it). The
    classes of a scope and layer stand in order of the size of their sets, in
    blocks of about `block` characters (a class counts as 256 at least); every
    two blocks whose sizes allow the similarity are compared whole, a task's
    work being bounded by the block. No pair is left out: the work is quadratic
    in the classes of like size of one scope and layer.
    """
    return _links(_classes(fragments.select("id", "scope", "layer", "content"), shortest)[1], similarity, block)


def _links(classes: DataFrame, similarity: float, block: int = 1 << 18) -> DataFrame:
    made = classes.select("id", "scope", "layer", "norm")
    sized = made.mapInArrow(_sized, "id string, scope string, layer string, norm string, n int").withColumn("weight", F.greatest(F.length("norm"), F.lit(256)).cast("long"))
    placed = cut(prefix_sum(sized, ["scope", "layer"], ["n", "id"], "weight", "before").select("id", "scope", "layer", "norm", "n", F.floor(F.col("before") / block).alias("block")))
    blocks = placed.groupBy("scope", "layer", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("classes"))
    one, two = [blocks.select([F.col(c).alias(f"{c}{i}") for c in blocks.columns]) for i in (0, 1)]
    # sets whose sizes differ by more can't be that similar
    like = (F.col("block0") <= F.col("block1")) & (F.col("high0") >= similarity * F.col("low1"))
    pairs = one.join(two, F.col("scope0").eqNullSafe(F.col("scope1")) & F.col("layer0").eqNullSafe(F.col("layer1")) & like)
    pairs = cut(pairs.filter("block0 < block1 OR classes0 > 1").select(F.monotonically_increasing_id().alias("pair"), F.col("scope0").alias("s"), F.col("layer0").alias("l"), "block0", "block1"))
    sides = pairs.select("pair", "s", "l", F.col("block0").alias("k"), F.lit(0).alias("side")).unionByName(pairs.filter("block0 < block1").select("pair", "s", "l", F.col("block1").alias("k"), F.lit(1).alias("side")))
    each = placed.join(sides, F.col("scope").eqNullSafe(F.col("s")) & F.col("layer").eqNullSafe(F.col("l")) & (F.col("block") == F.col("k"))).select("pair", "side", "id", "norm")
    # few bytes, much work: a fixed number of partitions, which aren't put together again
    spark = classes.sparkSession
    each = each.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "pair")
    return each.groupBy("pair").applyInArrow(_scored(similarity), "a string, b string, jaccard double")


def _grouped(rows: DataFrame, similarity: float, shortest: int) -> DataFrame:
    """rows with group, the least id of their group: a text is normalised and grouped once, and joined by its hash."""
    made, classes = _classes(rows, shortest)
    linked = components(_links(classes, similarity), "a", "b")
    of = classes.select(F.col("scope").alias("_s"), F.col("layer").alias("_l"), F.col("text").alias("_t"), F.col("id").alias("rep"))
    of = of.join(linked, F.col("rep") == F.col("node"), "left").select("_s", "_l", "_t", F.coalesce("component", "rep").alias("group"))
    same = F.col("scope").eqNullSafe(F.col("_s")) & F.col("layer").eqNullSafe(F.col("_l")) & (F.col("text") == F.col("_t"))
    return made.join(of, same).drop("_s", "_l", "_t", "text").dropDuplicates(["id"])


def dedup(fragments: DataFrame, similarity: float = 0.7, shortest: int = 12) -> DataFrame:
    """id, survivor of every merged fragment, and what the survivor absorbs: access_count, time_start, time_end, importance, entities.

    One row per group of two or more: survivor (least created_at, then id),
    members. Protected fragments take no part.
    """
    kept = ["id", "scope", "layer", "content", "created_at", "access_count", "time_start", "time_end", "importance", "entities"]
    groups = cut(_grouped(fragments.filter(F.coalesce(F.col("importance") < PROTECTED, F.lit(True))).select(*kept), similarity, shortest))
    order = F.struct(F.coalesce(micros(fragments, "created_at"), F.lit(2**62)), F.col("id"))
    made = groups.groupBy("group").agg(
        F.count("*").alias("members"), F.min_by("id", order).alias("survivor"), F.sum("access_count").alias("access_count"), F.min("time_start").alias("time_start"), F.max("time_end").alias("time_end"), F.max("importance").alias("importance"),
    ).filter("members > 1")
    # distinct before they are collected: as many as the group names entities
    named = groups.join(made.select("group"), "group", "left_semi").select("group", F.explode("entities").alias("entity")).distinct().groupBy("group").agg(F.array_sort(F.collect_list("entity")).alias("entities"))
    return made.join(named, "group", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>"))).drop("group")


def dedup_members(fragments: DataFrame, similarity: float = 0.7, shortest: int = 12) -> DataFrame:
    """id, group: every fragment long enough with the least id of its group (alone: its own)."""
    return _grouped(fragments.select("id", "scope", "layer", "content"), similarity, shortest).select("id", "group")


def expired_fingerprints(fingerprints: DataFrame, now: datetime, days: int = 90) -> DataFrame:
    """The fingerprints (fingerprint, last_us) not seen for so many days."""
    return fingerprints.filter(F.col("last_us") < int((now - datetime(1970, 1, 1)).total_seconds() * 1_000_000) - days * 86_400_000_000)


def top_of_scope(fragments: DataFrame, k: int) -> DataFrame:
    """The k most important fragments of each scope: a limit on the rank that reaches below the exchange."""
    w = W.partitionBy("scope").orderBy(F.desc_nulls_last("importance"), "id")
    return fragments.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)

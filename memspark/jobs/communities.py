"""Communities of entities by weighted label propagation, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark.functions.text import community_key
from memspark.tables import cut, cut_counting


def weights(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """universe, a, b (a < b), weight: current triples per pair of entities, in every universe they belong to.

    A universe is global or a scope with global: the triples of the scope
    between entities of the scope or global, and the global triples between
    entities that both are ends of such. So global triples come into another
    universe only where that links both their ends itself; all of them in
    every universe would multiply them by the number of scopes.
    """
    homes = entities.groupBy("id").agg(F.min("scope").alias("home"))
    rows = triples.filter("valid_to IS NULL AND object_id IS NOT NULL AND subject_id <> object_id AND scope IS NOT NULL").select("id", "scope", "subject_id", "object_id").dropDuplicates(["id"])
    for c, out in (("subject_id", "_s"), ("object_id", "_o")):
        rows = rows.join(homes.select(F.col("id").alias(c), F.col("home").alias(out)), c)
    inside = lambda c: F.col(c).isin("global") | (F.col(c) == F.col("scope"))
    rows = rows.filter(inside("_s") & inside("_o"))
    own = cut(rows.groupBy(F.col("scope").alias("universe"), F.least("subject_id", "object_id").alias("a"), F.greatest("subject_id", "object_id").alias("b")).agg(F.count("*").alias("weight")))
    ends = own.filter("universe <> 'global'").select("universe", F.explode(F.array("a", "b")).alias("node")).distinct()
    shared = own.filter("universe = 'global'").select("a", "b", "weight").join(ends.withColumnRenamed("node", "a"), "a").join(ends.withColumnRenamed("node", "b"), ["universe", "b"])
    return own.unionByName(shared.select(*own.columns)).groupBy("universe", "a", "b").agg(F.sum("weight").alias("weight"))


def communities(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """universe, node, label: in each round half of the nodes, drawn by a hash, take the label of the greatest weight around them if it has more than their own (the least of equal ones), until no node would move.

    Deterministic; a round is a join and two partial aggregates, so a hub of
    any degree is reduced before the shuffle. Modularity is not maximised as
    such. Rounds end at most_rounds should labels never settle.
    """
    both = cut(edges.unionByName(edges.select("universe", F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    labels = cut(both.select("universe", F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    for i in range(most_rounds):
        seen = both.join(labels.withColumnRenamed("node", "b"), ["universe", "b"]).groupBy("universe", "a", "label").agg(F.sum("weight").alias("w"))
        best = seen.groupBy("universe", F.col("a").alias("node")).agg(F.min(F.struct((-F.col("w")).alias("w"), F.col("label").alias("best"))).alias("x"))
        at = labels.join(best, ["universe", "node"]).join(seen.select("universe", F.col("a").alias("node"), "label", F.col("w").alias("own")), ["universe", "node", "label"], "left")
        wants = (F.col("x.best") != F.col("label")) & (-F.col("x.w") > F.coalesce("own", F.lit(0)))
        moves = wants & (F.pmod(F.xxhash64("node", F.lit(i)), F.lit(2)) == 0)
        moved = at.select("universe", "node", F.when(moves, F.col("x.best")).otherwise(F.col("label")).alias("label"), wants.alias("wants"))
        labels, left = cut_counting(moved, F.col("wants"))
        labels = labels.drop("wants")
        if not left:
            break
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """universe, modularity of the labels."""
    a, b = [labels.select("universe", F.col("node").alias(n), F.col("label").alias(f"l{n}")) for n in ("a", "b")]
    rows = edges.join(a, ["universe", "a"]).join(b, ["universe", "b"])
    total = rows.groupBy("universe").agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0)).alias("inner"))
    ends = rows.select("universe", F.explode(F.array("la", "lb")).alias("label"), "weight").groupBy("universe", "label").agg(F.sum("weight").alias("d"))
    squares = ends.join(total, "universe").groupBy("universe").agg(F.sum(F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("expected"))
    return total.join(squares, "universe").select("universe", (F.col("inner") / F.col("m") - F.col("expected")).alias("modularity"))


def summaries(labels: DataFrame, edges: DataFrame, entities: DataFrame, top: int = 5) -> DataFrame:
    """key, universe, label, size, inner_edges, names of the `top` members of most edges; communities of two or more.

    The key hashes universe, label, size and members, not a list of them, so a
    community of any size stays out of a single row. Communities of global
    entities alone come in the universe global only.
    """
    names = entities.groupBy("id").agg(F.min("name").alias("name"), F.min("scope").alias("home"))
    ends = edges.select("universe", F.explode(F.array("a", "b")).alias("node")).groupBy("universe", "node").agg(F.count("*").alias("degree"))
    rows = cut(labels.join(ends, ["universe", "node"]).join(names, F.col("node") == F.col("id"), "left"))
    size = rows.groupBy("universe", "label").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("mix"), F.count_if(F.coalesce(F.col("home") != "global", F.lit(True))).alias("own"))
    size = size.filter("size > 1 AND (universe = 'global' OR own > 0)").drop("own")
    place = F.row_number().over(W.partitionBy("universe", "label").orderBy(F.desc("degree"), "node"))
    best = rows.withColumn("place", place).filter(F.col("place") <= top).groupBy("universe", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("name", "node").alias("name")))), lambda x: x["name"]), ", ").alias("names"))
    a, b = [labels.select("universe", F.col("node").alias(n), F.col("label").alias(f"l{n}")) for n in ("a", "b")]
    inner = edges.join(a, ["universe", "a"]).join(b, ["universe", "b"]).filter("la = lb").groupBy("universe", F.col("la").alias("label")).agg(F.count("*").alias("inner_edges"))
    key = community_key(F.array("universe", F.col("label"), F.col("size").cast("string"), F.col("mix").cast("string")))
    return size.join(best, ["universe", "label"]).join(inner, ["universe", "label"], "left").select(key.alias("key"), "universe", "label", "size", F.coalesce("inner_edges", F.lit(0)).alias("inner_edges"), "names")


def refresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, action (insert, delete) between the keys of two states; what both have stays."""
    a, b = old.select("key").distinct(), new.select("key").distinct()
    return b.join(a, "key", "left_anti").withColumn("action", F.lit("insert")).unionByName(a.join(b, "key", "left_anti").withColumn("action", F.lit("delete")))

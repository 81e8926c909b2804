"""Queries p3, p4, p5, p8, p9 and p10 over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import pii
from memspark.llm.mixing import mix
from memspark.llm.residue import labelled
from memspark.llm.survivors import golden, grouped, same_id, same_text, survivors
from memspark.llm.tokens import counted, encoded
from memspark.llm.vectors import Scan, similar
from memspark.tables import micros, ref_key, stripped, table


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """vector_id, embedding: that of the link or, if null, of the fragment it names."""
    links = table(spark, folder, "vector_links")
    fragments = table(spark, folder, "temporal_fragments").select(ref_key(F.col("id")).alias("key"), "embedding").filter("key is not null and embedding is not null")
    own = links.filter("embedding is not null").select("vector_id", "embedding")
    lent = links.filter("embedding is null").select("vector_id", ref_key(F.col("fragment_id")).alias("key")).join(fragments, "key")
    return own.unionByName(lent.select("vector_id", "embedding"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of vectors of cosine similarity 0.9 at least, one among the 10 most similar of the other."""
    pairs = similar(vectors(spark, folder), "vector_id", "embedding", Scan(k=10, min_sim=0.9))
    return pairs.select(F.least("a", "b").alias("vector_id_a"), F.greatest("a", "b").alias("vector_id_b")).distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The fragments with personal data, and its types."""
    found = pii.find(table(spark, folder, "temporal_fragments"), ["id"], "content")
    return found.select("id", F.col("kind").alias("pii_type")).distinct()


def p4_sanitised(spark: SparkSession, folder: str) -> DataFrame:
    """Every fragment with its content, personal data replaced."""
    rows = table(spark, folder, "temporal_fragments").select("id", "content").distinct()
    return pii.sanitise(rows, ["id"], "content").withColumnRenamed("sanitised", "content")


def _memories(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "temporal_fragments")
    named = F.length(stripped(F.col("location_id"))) > 0
    filled = [F.col("time_start").isNotNull(), F.col("time_end").isNotNull(), named, F.size("entities") > 0]
    count = sum((F.coalesce(c.cast("int"), F.lit(0)) for c in filled), F.lit(0))
    importance = F.when(~F.isnan("importance"), F.col("importance"))
    keep = [count.alias("filled"), importance.alias("importance"), micros(f, "created_at").alias("created_us"), micros(f, "time_start").alias("start_us"), "entities"]
    return grouped(f, "id", ["scope", "layer"], [same_id(F.col("fragment_id")), same_text(F.col("content"))], keep)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The survivor of each group of fragments that hold the same memory."""
    order = [F.desc("filled"), F.desc_nulls_last("importance"), F.desc_nulls_last("created_us"), F.col("id")]
    return survivors(_memories(spark, folder), "id", order).select("id")


def p5_golden(spark: SparkSession, folder: str) -> DataFrame:
    """The survivor with the best values of its group.

    The latest created_at, the highest importance, and time_start and entities
    of the best-ranked record that has them.
    """
    low = F.lit(-(2**63)).cast("long")
    rank = F.struct(-F.col("filled"), F.coalesce(-F.col("importance"), F.lit(float("inf"))), -F.coalesce("created_us", low + 1), F.col("id"))
    has = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, rank))
    fields = {
        "created_us": F.max("created_us"),
        "importance": F.max("importance"),
        "start_us": has("start_us", F.col("start_us").isNotNull()),
        "entities": F.array_join(has("entities", F.size("entities") > 0), ","),
    }
    return golden(_memories(spark, folder), "id", rank, fields).drop("group")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return encoded(table(spark, folder, "documents"), ["doc_id"], "text")


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sizes = counted(table(spark, folder, "documents"), ["doc_id", "source"], "text")
    return mix(sizes, "doc_id", "source", "n_tokens", table(spark, folder, "mix_targets"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of every mix, with the times each occurs."""
    return _mixed(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the sources of every mix reach."""
    return _mixed(spark, folder)[1]


def _by_length(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, folder, "documents"), "doc_id", "source", "n_chars", table(spark, folder, "mix_targets"))


def p9_mix_by_length(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the code points of a text as its size."""
    return _by_length(spark, folder)[0]


def p9_shares_by_length(spark: SparkSession, folder: str) -> DataFrame:
    shares = _by_length(spark, folder)[1]
    return shares.select("mix", "source", F.round("target_share", 9).alias("target_share"), "available", "n_docs", "most_copies", "reached_size", F.round("reached_share", 9).alias("reached_share"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that are residue, wholly or in part."""
    found = labelled(table(spark, folder, "documents"), ["doc_id"], "text")
    return found.filter("residue IS NOT NULL").select("doc_id").distinct()


def p10_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents without residue."""
    return labelled(table(spark, folder, "documents"), ["doc_id", "source", "n_chars"], "text").filter("residue IS NULL").drop("residue")


QUERIES = {q.__name__: q for q in (p3_found, p4_found, p4_sanitised, p5_found, p5_golden, p8_ids, p9_mix, p9_shares, p9_mix_by_length, p9_shares_by_length, p10_found, p10_clean)}

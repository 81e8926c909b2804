"""Keyword search (BM25 over trigrams, LIKE) and nearest neighbours of a vector."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def query_terms(text: str, most: int = 16) -> list[str]:
    """The distinct words of three characters or more, in order, `most` at most."""
    return list(dict.fromkeys(w for w in re.findall(r"\w+", text) if len(w) >= 3))[:most]


def occurrences(text: Column, term: str) -> Column:
    """How often term occurs in text, overlaps counted; both already in one case."""
    if not any(term.endswith(term[:i]) for i in range(1, len(term))):  # can't overlap itself
        return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")
    last = F.length(text) - len(term) + 1
    at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(at, lambda i: F.substr(text, i, F.lit(len(term))) == term)).cast("long")


def _bm25_score(terms: int) -> Column:
    """From _tf and _df of every term, _len, _avg and _n."""
    score = F.lit(0.0)
    for i in range(terms):
        tf, df_ = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.log((F.col("_n") - df_ + 0.5) / (df_ + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        score = score - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return score


def bm25(df: DataFrame, key: str, text: str, query: str | Sequence[str], top_k: int = 20, scope: Column | None = None) -> DataFrame:
    """key, score of the top_k rows that contain a term of the query, best (lowest) first.

    Case is ignored. Statistics cover all rows, whatever the scope: the rows
    with each term, and the length in trigrams. Null texts count as empty;
    rows of one key are one. A text is read once: what is compared and
    shuffled are its counts.
    """
    terms = [t.lower() for t in (query_terms(query) if isinstance(query, str) else query)]
    low = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit("")))).withColumn("_in", scope if scope is not None else F.lit(True))
    low = low.select(key, "_in", F.greatest(F.length("_low") - 2, F.lit(0)).alias("_len"), *[occurrences(F.col("_low"), t).alias(f"_tf{i}") for i, t in enumerate(terms)]).dropDuplicates([key])
    if not terms:
        return low.select(key, F.lit(0.0).alias("score")).limit(0)
    n = F.broadcast(low.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))]))  # one row
    rows = low.filter(F.col("_in") & F.greatest(*[F.col(f"_tf{i}") for i in range(len(terms))], F.lit(0)).cast("boolean")).crossJoin(n)
    return rows.select(key, _bm25_score(len(terms)).alias("score")).orderBy("score", key).limit(top_k)


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """gram, key, len: the distinct trigrams of every text in lower case with its length in trigrams; rows of one key are one.

    To be written once, in ranges of gram (see sources.layout), for bm25_indexed().
    """
    low = df.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low")).dropDuplicates(["key"])
    n = F.length("low") - 2
    # a pattern and no positions: linear in the text
    grams = F.when(n >= 1, F.array_distinct(F.regexp_extract_all("low", F.lit("(?s)(?=(...))"), F.lit(1)))).otherwise(F.array(F.lit("")))
    return low.select(F.explode(grams).alias("gram"), "key", F.greatest(n, F.lit(0)).alias("len"))


def bm25_indexed(index: DataFrame, df: DataFrame, key: str, text: str, query: str | Sequence[str], top_k: int = 20) -> DataFrame:
    """key, score as of bm25(), reading texts only of rows that hold all trigrams of a term.

    The index is filtered by the trigrams of the query, which reaches its scan;
    the number of rows and their mean length come from the index too.
    """
    terms = [t.lower() for t in (query_terms(query) if isinstance(query, str) else query)]
    grams = [(i, t[j : j + 3]) for i, t in enumerate(terms) for j in range(len(t) - 2)]
    needed = {i: len({g for k, g in grams if k == i}) for i in range(len(terms))}
    if not grams:
        return df.select(key, F.lit(0.0).alias("score")).limit(0)
    hits = index.filter(F.col("gram").isin(sorted({g for _, g in grams})))
    held = hits.groupBy("key").agg(*[F.count_if(F.col("gram").isin(sorted({g for k, g in grams if k == i}))).alias(f"_g{i}") for i in needed])
    near = held.filter(reduce(Column.__or__, [F.col(f"_g{i}") == n for i, n in needed.items()])).select(F.col("key").alias(key))
    low = df.join(near, key, "left_semi").withColumn("_low", F.lower(F.col(text)))
    low = low.select(key, F.greatest(F.length("_low") - 2, F.lit(0)).alias("_len"), *[occurrences(F.col("_low"), t).alias(f"_tf{i}") for i, t in enumerate(terms)]).dropDuplicates([key])
    low = low.filter(F.greatest(*[F.col(f"_tf{i}") for i in range(len(terms))], F.lit(0)) > 0)
    size = index.select("key", "len").distinct().agg(F.count("*").alias("_n"), F.avg("len").alias("_avg"))
    counts = low.agg(*[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    rows = low.crossJoin(F.broadcast(size.crossJoin(counts)))  # one row each
    return rows.select(key, _bm25_score(len(terms)).alias("score")).orderBy("score", key).limit(top_k)


def keyword_like(text: Column, keyword: str) -> Column:
    """LIKE %keyword%, case ignored for A to Z only; % and _ in the keyword are wildcards."""
    fold = lambda s: "".join(c.lower() if c in _A_TO_Z else c for c in s)
    return F.translate(text, _A_TO_Z, _A_TO_Z.lower()).like(f"%{fold(keyword)}%")


def panel_search(df: DataFrame, key: str, text: str, updated: str, query: str, top_k: int = 20) -> DataFrame:
    """key, score: the whole query as one phrase by BM25; if shorter than 3 characters, LIKE with the latest first (score null)."""
    if len(query) >= 3:
        return bm25(df, key, text, [query], top_k)
    return df.filter(keyword_like(F.col(text), query)).dropDuplicates([key]).orderBy(F.desc_nulls_last(updated), key).select(key, F.lit(None).cast("double").alias("score")).limit(top_k)


def l2(vector: Column, query: Sequence[float]) -> Column:
    """Euclidean distance, in doubles."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.sqrt(F.aggregate(F.zip_with(vector, q, lambda a, b: F.pow(a.cast("double") - b, 2)), F.lit(0.0), lambda s, x: s + x))


def knn(df: DataFrame, key: str, vector: str, query: Sequence[float], k: int, scope: Column | None = None, oversample: int | None = None) -> DataFrame:
    """key, distance of the k nearest rows, exactly. Null vectors and other lengths are left out; repeated keys count once.

    The scope filters before the search; with oversample, after a search of
    oversample * k, so that fewer than k may come.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    rows = df.filter(F.size(vector) == len(query))
    inside = scope if scope is not None else F.lit(True)
    if oversample is None:
        rows = rows.filter(inside)
    near = rows.select(key, l2(F.col(vector), query).alias("distance"), inside.alias("_in")).distinct()
    near = near.orderBy("distance", key).limit(k * (oversample or 1))
    return (near.filter("_in").orderBy("distance", key).limit(k) if oversample else near).drop("_in")


def memory_id() -> Column:
    """What a vector stands for: its entity, else triple, else fragment."""
    return F.coalesce("entity_id", "triple_id", "fragment_id")


def keyword_overlap(df: DataFrame, key: str, text: str, query: str, top_k: int = 5) -> DataFrame:
    """key, score: how many distinct words of the query the text contains, most first."""
    words = [w.lower() for w in dict.fromkeys(re.findall(r"\w+", query.lower()))]
    score = sum((F.contains(F.lower(F.col(text)), F.lit(w)).cast("int") for w in words), F.lit(0))
    return df.select(key, score.alias("score")).filter("score > 0").dropDuplicates([key]).orderBy(F.desc("score"), key).limit(top_k)


def ranks(df: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """key, rank, ranking of an already limited result (a top-k: one task orders it)."""
    return df.select(F.col(key).alias("key"), F.row_number().over(W.orderBy(*order)).alias("rank"), F.lit(name).alias("ranking"))

from pyspark.sql import functions as F

from memspark.llm.survivors import golden, grouped, same_id, same_text, survivors

SCHEMA = "id string, w string, f string, c string, score int, group string, first string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def make(df):
    return grouped(df, "id", ["w"], [same_id(F.col("f")), same_text(F.col("c"))], [F.col("score")])


def run(spark, rows):
    got = survivors(make(frame(spark, rows)), "id", [F.desc_nulls_last("score"), F.col("id")]).collect()
    return sorted(r.id for r in got)


def test_groups_by_either_key_and_by_way_of_others(spark):
    rows = [
        ("a", "p", "F1 ", "Hello, World", 1),
        ("b", "p", "f1", "other", 5),
        ("c", "p", "f2", "hello world", 9),
        ("d", "q", "f1", "hello world", 99),  # elsewhere
        ("e", "p", "", "...", 1),
        ("f", "p", " ", "!", 1),  # neither key
        ("g", "p", None, None, 1),
        ("h", "p", None, None, 1),
        ("i", None, "f7", None, None),
        ("j", None, "F7", "", None),  # ties: smaller id
        ("k", "p", "f9", "STRASSE 1", 2),
        ("l", "p", None, "Straße 1", 3),
        (None, "p", "f1", "hello world", 100),
    ]
    assert run(spark, rows + rows) == ["c", "i", "l"]


def test_hot_group_and_single(spark):
    rows = [(f"r{i:04}", "p", "same" if i % 2 else None, "same text", i % 7) for i in range(600)] + [("solo", "p", "solo", "alone", 1)]
    assert run(spark, rows) == ["r0006"]


def test_long_text_and_empty(spark):
    assert run(spark, [("a", "p", "1", "x" * 200000, 1), ("b", "p", "2", "X " * 200000, 2)]) == ["b"]
    assert run(spark, []) == []


def test_golden(spark):
    rows = [("a", "p", "1", None, None), ("b", "p", "1", None, 4), ("c", "p", "2", None, 4)]
    rank = F.struct(-F.coalesce("score", F.lit(0)), F.col("id"))
    got = golden(make(frame(spark, rows)), "id", rank, {"score": F.max("score"), "n": F.count("*")}).collect()
    assert [(r.id, r.score, r.n) for r in got] == [("b", 4, 2)]

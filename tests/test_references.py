from memspark.operators.references import check_references, parent_spans


def test_states(spark):
    people = spark.createDataFrame([("A", 10, 20), ("a ", 30, 40), ("B", 5, None), ("C", 50, 60), (None, 1, 2), (" ", 1, 2)], "id string, b long, e long")
    parents = parent_spans(people, "id", "b", "e").selectExpr("'p' AS target", "*")
    refs = [("p", " a", 5, "late"), ("p", "A", 25, "ok"), ("p", "a", 40, "closed"), ("p", "B\t", 99, "ok"), ("p", "D", 1, "missing"), ("p", "c", None, "ok"), ("p", "c", 60, "closed"), ("q", "A", 1, "missing"), ("p", "D", 1, "missing"), ("p", None, 1, None), ("p", " ", 1, None)]
    df = spark.createDataFrame(refs, "target string, reference string, at_us long, status_wanted string").withColumnRenamed("status_wanted", "key")
    got = check_references(df, parents).collect()
    assert len(got) == 9
    assert all(r.status == r.key for r in got)


def test_empty(spark):
    people = spark.createDataFrame([], "id string")
    parents = parent_spans(people, "id", None, None).selectExpr("'p' AS target", "*")
    refs = spark.createDataFrame([("p", "x", 1)], "target string, reference string, at_us long")
    assert [r.status for r in check_references(refs, parents).collect()] == ["missing"]
    assert check_references(refs.limit(0), parents).count() == 0

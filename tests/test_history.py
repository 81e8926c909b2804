import random

from memspark.operators.history import history, satellites

SCHEMA = "k string, from_us long, to_us long, value string, rank int, hash string, prev string"


def brute(rows):
    best = {}
    for k, a, b, v, r in rows:
        if a is not None and ((k, a) not in best or r > best[k, a][2]):
            best[k, a] = (b, v, r)
    out = []
    for k in {k for k, _ in best}:
        times = sorted(a for x, a in best if x == k)
        for i, a in enumerate(times):
            b, v, _ = best[k, a]
            ends = [x for x in (b if b is not None and b > a else None, times[i + 1] if i + 1 < len(times) else None) if x is not None]
            to = min(ends) if ends else None
            if out and out[-1][0] == k and out[-1][1] == v and out[-1][3] == a:
                out[-1] = (*out[-1][:3], to)
            else:
                out.append((k, v, a, to))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = [tuple(r) for r in history(df, ["k"], "k").select("k", "value", "from_us", "to_us").collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_corrections_ends_and_restatements(spark):
    check(spark, [("x", 1, None, "A", 0), ("x", 5, 7, "A", 0), ("x", 9, None, "A", 0), ("x", 9, None, "B", 1), ("x", 12, 11, "B", 0), ("x", 20, 25, "B", 0), ("y", 1, 2, None, 0), ("y", 2, None, None, 0), (None, 3, None, "", 0), ("z", None, None, "A", 0), ("w", 1, 4, "A", 0), ("w", 4, None, "A", 0)])


def test_hot_key_over_many_ranges(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.6 else f"k{r.randrange(9)}", a := r.randrange(500), a + r.randrange(-3, 30) if r.random() < 0.3 else None, r.choice("AB"), i) for i in range(600)]
    check(spark, rows)


def test_empty(spark):
    check(spark, [])


def test_split_by_change_rate(spark):
    rows = [("fast", i, None, str(i), 0) for i in range(9)] + [("slow", 1, None, "A", 0), ("slow", 2, None, "A", 0)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    assert {(r.k, n) for n, at in satellites(df, ["k"], "k").items() for r in at.collect()} == {("fast", "fast"), ("slow", "slow")}
    assert {(r.k, r.satellite) for r in history(df, ["k"], "k").collect()} == {("fast", "fast"), ("slow", "slow")}

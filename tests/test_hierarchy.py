import random

from memspark.operators.hierarchy import descendants, hierarchy

SCHEMA = "id string, parent_id string, depth string, pre int"


def brute(rows):
    parents = {}
    for i, p in rows:
        if i is not None:
            parents[i] = min((x for x in (p, parents.get(i)) if x is not None), default=None)
    out, pairs = {}, set()
    for i in parents:
        way, at = [i], parents[i]
        while at in parents and len(way) <= len(parents):
            way.append(at)
            at = parents[at]
        cyclic = len(way) > len(parents)
        out[i] = ("cycle", -1, None) if cyclic else (way[-1], len(way) - 1, "/".join(reversed(way)))
        if not cyclic:
            pairs |= {(a, i) for a in way[1:]}
    return out, pairs


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    want, pairs = brute(rows)
    nodes = hierarchy(df, with_path=True).cache()
    got = nodes.collect()
    assert {r.id: (r.root_id, r.depth, r.path) for r in got} == want
    assert len(got) == len(want)
    at = {r.id: r for r in got if r.pre is not None}
    ranges = {(a, b) for a in at for b in at if at[a].root_id == at[b].root_id and at[a].pre < at[b].pre <= at[a].last}
    assert ranges == pairs
    assert len({(r.root_id, r.pre) for r in at.values()}) == len(at)
    found = [tuple(r) for r in descendants(nodes).collect()]
    assert len(found) == len(pairs) and set(found) == pairs
    nodes.unpersist()


def test_small_cases(spark):
    rows = [("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("d", "b"), ("e", "gone"), ("f", "f"), ("g", "f"), ("h", "i"), ("i", "h"), ("j", "i"), (None, "a"), ("k", "e")]
    check(spark, rows)


def test_random_forest_with_chain(spark):
    r = random.Random(1)
    names = [f"n{i:03}" for i in range(60)]
    rows = [(n, r.choice(names[:i]) if i and r.random() < 0.9 else None) for i, n in enumerate(names)]
    rows += [(f"c{i:02}", f"c{i - 1:02}" if i else None) for i in range(37)] + [("w1", "w2"), ("w2", "w3"), ("w3", "w1"), ("w4", "w1")]
    r.shuffle(rows)
    check(spark, rows)


def test_empty(spark):
    check(spark, [])

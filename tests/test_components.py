import random

import pytest

from memspark.operators.components import components


def brute(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {x: top(x) for x in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5), (None, 3), (300, 301), (300, 301), (301, 300)]
    got = components(spark.createDataFrame(edges, "x int, y int"), "x", "y").collect()
    assert {r.node: r.component for r in got} == brute(edges) and len(got) == len(brute(edges))


def test_hub_and_empty(spark):
    edges = [("h", f"n{i:04}") for i in range(500)]
    got = components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()
    assert len(got) == 501 and {r.component for r in got} == {"h"}
    assert components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0

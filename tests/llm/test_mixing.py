import random

from memspark.llm.mixing import mix

DOCS = "k long, s string, n long, mix string, source string, copies string"
TARGETS = "mix_name string, source string, target_weight double, max_repeats int, size_ratio double"


def run(spark, docs, targets):
    a = spark.createDataFrame([(*d, "x", "y", "z") for d in docs], DOCS)
    chosen, shares = mix(a, "k", "s", "n", spark.createDataFrame(targets, TARGETS))
    return [(r.mix, r.k, r.source, r.n, r.copies) for r in chosen.collect()], {(r.mix, r.source): r for r in shares.collect()}


def test_budgets_repeats_and_hot_source(spark):
    r = random.Random(4)
    docs = [(i, r.choice(["big", " BIG", "Big", "small"]) if i % 9 else "tiny", r.randrange(1, 40)) for i in range(900)]
    total = sum(n for _, _, n in docs)
    targets = [("m", "big", 3.0, 1, 0.5), ("m", "Small ", 1.0, None, 0.5), ("m", "tiny", 4.0, 3, 0.5), ("m", "none", 1.0, 2, 0.5), ("z", "big", 0.0, 5, 0.9), ("z", "small", 2.0, 50, 2.5)]
    chosen, shares = run(spark, docs, targets)
    assert len({c[:2] for c in chosen}) == len(chosen)
    sizes = {s: sum(n for _, t, n in docs if t.strip().lower() == s) for s in ("big", "small", "tiny")}
    for m, s, w, top, ratio, weights in [("m", "big", 3, 1, 0.5, 9), ("m", "small", 1, 1, 0.5, 9), ("m", "tiny", 4, 3, 0.5, 9), ("z", "small", 2, 50, 2.5, 2)]:
        got = [c for c in chosen if c[0] == m and c[2] == s]
        reached = sum(n * c for *_, n, c in got)
        want = min(w / weights * ratio * total, top * sizes[s])
        assert abs(reached - want) <= 20 and max(c for *_, c in got) <= top
        assert max(c for *_, c in got) - min(c for *_, c in got) <= 1
        assert (shares[m, s].reached_size, shares[m, s].n_docs) == (reached, len(got))
    assert shares["m", "none"].n_docs == 0 and shares["z", "big"].reached_size == 0
    assert abs(sum(x.reached_share for (m, _), x in shares.items() if m == "m") - 1) < 1e-9
    assert sorted(run(spark, docs, targets)[0]) == sorted(chosen)


def test_nulls_and_repeated_rows(spark):
    docs = [(1, "a", 5), (1, "a", 5), (2, None, 5), (3, "a", None), (4, "a", 0), (None, "a", 5), (5, " ", 3)]
    chosen, shares = run(spark, docs, [("m", "A", 1.0, 2, 9.0), ("m", None, 1.0, 1, 9.0), ("n", "a", None, None, 1.0), ("n", "a", float("nan"), None, 1.0)])
    assert chosen == [("m", 1, "a", 5, 2)]
    assert shares["n", "a"].reached_size == 0


def test_empty(spark):
    assert run(spark, [], [("m", "a", 1.0, 1, 1.0)])[0] == []
    assert run(spark, [(1, "a", 2)], []) == ([], {})

from pathlib import Path

import numpy as np

from memspark.llm import vectors
from memspark.llm.vectors import Scan, rotation, scan_list, similar
from memspark.tables import shared_folder

SCHEMA = "v long, e array<float>, id string, vec string, h1 string, rep string"


def brute(vectors, k, min_sim):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    return {i: sorted(((-round(float(s[a, b]), 5), j) for b, j in enumerate(ids) if b != a and s[a, b] >= min_sim))[:k] for a, i in enumerate(ids)}


def run(spark, rows, scan):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    found = {}
    for r in similar(df, "v", "e", scan).collect():
        found.setdefault(r.a, []).append((-round(r.sim, 5), r.b))
    return {a: sorted(b) for a, b in found.items()}


def planted(n, dim, seed=3):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, dim))
    near = base[: n // 2] + 0.15 * r.standard_normal((n // 2, dim))
    return np.concatenate([base, near * r.uniform(0.2, 5, (n // 2, 1))])


def test_recall_over_many_lists(spark):
    x = planted(1500, 64)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = run(spark, rows, Scan(list_rows=40, piece_rows=64))
    want = brute(dict(rows), 10, 0.9)
    pairs = lambda d: {(a, b) for a, to in d.items() for _, b in to}
    assert len(pairs(got) & pairs(want)) >= 0.98 * len(pairs(want)) > 0
    assert not pairs(got) - pairs(want)


def recall(got, want):
    pairs = lambda d: {(a, b) for a, to in d.items() for _, b in to}
    return len(pairs(got) & pairs(want)) / len(pairs(want))


def test_recall_over_sublists(spark):
    """Eight lists, each with lists of its own, and pieces of both sides."""
    x = planted(1500, 64)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = run(spark, rows, Scan(list_rows=40, max_lists=8, piece_rows=256))
    want = brute(dict(rows), 10, 0.9)
    assert recall(got, want) >= 0.98


def test_k_nearest_without_threshold(spark):
    """Clustered vectors over some 25 lists: recall of the 10 nearest, whatever their similarity; all of them if exact."""
    r = np.random.default_rng(7)
    x = np.repeat(r.standard_normal((40, 64)), 25, 0) + 0.6 * r.standard_normal((1000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute(dict(rows), 10, -1.0)
    assert recall(run(spark, rows, Scan(min_sim=-1.0, list_rows=40, probes=8)), want) >= 0.9
    assert recall(run(spark, rows, Scan(min_sim=-1.0, list_rows=40, exact=True, piece_rows=300)), want) >= 0.999


def test_one_dense_list(spark):
    """All vectors near one another: one list is all, and is searched in pieces of queries and candidates."""
    r = np.random.default_rng(9)
    x = r.standard_normal(64) + 0.05 * r.standard_normal((900, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = run(spark, rows, Scan(max_lists=1, max_sublists=1, piece_rows=128))
    assert recall(got, brute(dict(rows), 10, 0.9)) >= 0.95


def test_recall_on_the_tables(spark):
    """The real vectors of sf0.01 against brute force, sub-lists included."""
    v = [(r.vector_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.01/vector_links.parquet").filter("size(embedding) = 64").select("vector_id", "embedding").dropDuplicates(["vector_id"]).collect()]
    v = [(i, e) for i, e in v if np.isfinite(e).all() and np.any(e)]
    want = brute(dict(v), 10, 0.9)
    for scan in (Scan(), Scan(list_rows=16, max_lists=4)):
        assert recall(run(spark, v, scan), want) >= 0.99


def test_copies_and_bad_vectors(spark):
    r = np.random.default_rng(1)
    one, two, three = r.standard_normal((3, 8))
    rows = [(i, (one * (i + 1)).tolist()) for i in range(9)] + [(20, (one + 0.02 * two).tolist()), (21, three.tolist())]
    bad = [(30, None), (31, [0.0] * 8), (32, [1.0] * 7), (33, [float("nan")] + [1.0] * 7), (34, [float("inf")] + [1.0] * 7), (None, one.tolist()), (35, [None] + [1.0] * 7), (36, [])]
    scan = Scan(dim=8, k=3, column_block=4)
    got = run(spark, rows + bad + rows[:4], scan)
    assert 21 not in got and not set(got) & {30, 31, 32, 33, 34, 35, 36, None}
    assert [b for _, b in got[0]] == [1, 2, 3] and [b for _, b in got[1]] == [0, 2, 3] and [b for _, b in got[8]] == [0, 1, 2]
    assert [b for _, b in got[20]] == [0, 1, 2]


def test_no_threshold_finds_all_in_one_list(spark):
    x = planted(60, 64)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = run(spark, rows, Scan(k=4, min_sim=-1.0, list_rows=1000, epsilon=20.0))
    want = brute(dict(rows), 4, -1.0)
    assert {a: [b for _, b in to] for a, to in got.items()} == {a: [b for _, b in to] for a, to in want.items()}


def test_empty_and_single(spark):
    assert run(spark, [], Scan()) == {}
    assert run(spark, [(1, [1.0] * 64)], Scan()) == {}


def test_scan_abandons_most_of_the_work():
    x = planted(4000, 64).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x @ rotation(64, 20)
    i, j, sim, spent = scan_list(x, x, Scan())
    s = x @ x.T
    want = {(a, b) for a, b in np.argwhere(s >= 0.9) if a != b}
    got = {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a != b}
    assert len(want & got) >= 0.99 * len(want)
    assert spent < 0.4 * s.size * 64
    assert np.allclose(sim, s[i, j], atol=1e-4)


def test_disk_is_given_back(spark):
    """Many visits a vector: when the pairs are known, neither shuffles nor tables of vectors or visits are left."""

    def left():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        shuffled = sum(files.apply(i).length() for i in range(files.size()) if "shuffle_" in files.apply(i).getName())
        return shuffled + sum(p.stat().st_size for p in Path(shared_folder(spark).removeprefix("file:")).rglob("*.parquet"))

    x = planted(2000, 64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "v long, e array<float>")
    before = left()
    similar(df, "v", "e", Scan(list_rows=40, border_z=8.0))
    assert left() - before < len(x) * 64 * 4


def test_waves_find_the_same(spark):
    """Lists and pieces of lists over several waves."""
    rows = [(i, v.tolist()) for i, v in enumerate(planted(1500, 64))]
    want = brute(dict(rows), 10, 0.9)
    for scan in (Scan(list_rows=40, wave_rows=9000, wave=0), Scan(max_lists=3, max_sublists=1, piece_rows=128, wave_rows=3000, wave=0)):
        assert recall(run(spark, rows, scan), want) >= 0.98


def test_waves_are_bounded():
    """A wave sends wave_rows or 4 times the vectors, and a piece more; all pieces are in one."""
    r = np.random.default_rng(2)
    held, asked = r.integers(0, 3000, 4096), r.integers(3000, 300_000, 4096)
    held[7], asked[7] = 900_000, 2_000_000
    n = int(held.sum())
    plan = vectors._pieces(held, asked, n, Scan())
    assert plan.waves[0] == 0 and plan.waves[-1] == (plan.cs * plan.vs).sum() and (np.diff(plan.waves) > 0).all()
    each = np.repeat(asked / plan.vs + held / plan.cs, plan.cs * plan.vs)
    sums = [each[a:b].sum() for a, b in zip(plan.waves, plan.waves[1:], strict=False)]
    assert len(sums) > 10 and max(sums) < 4 * n * 1.2
    assert (asked / plan.vs).max() <= 4 * Scan().piece_rows and (held / plan.cs).max() <= Scan().piece_rows

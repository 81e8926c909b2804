"""The most similar vectors of every vector, by an adaptive dimension scan.

Vectors are scaled to length 1 and rotated at random, so that the distance on
a few dimensions estimates the whole. Copies are searched for once, through
one representative. An inverted index holds every representative in the list
of its nearest centroid (centroids come from a bounded sample); lists that are
large have lists of their own, from a bounded sample of each, so that the work
for a vector doesn't grow with the number of vectors; a query visits the lists
that can hold near enough vectors. How many these are grows with the number of
lists, so rows are sent to them in waves, each searched and its shuffle
removed before the next: the disk follows the vectors, not the visits. A list
of any size is scanned in pieces of candidates times pieces of queries; lists
within it are made and searched in the piece. There, dimensions come in column
blocks: after each block a hypothesis test on the partial distance abandons
the candidates that are too far, and the rest are measured exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark.tables import cut, cut_parts, drop, unshuffled


@dataclass(frozen=True)
class Scan:
    """How to search.

    k neighbours of similarity min_sim at least; lists of about list_rows
    vectors, max_lists at most, from a sample of train_per_list rows a list;
    lists of twice list_rows or more have max_sublists lists of their own at
    most. A query visits the lists whose border is within border_z standard
    deviations of where a neighbour can be, the nearest `probes` of them
    (None: all). Blocks of column_block dimensions, tested at epsilon (the
    larger, the fewer true neighbours are abandoned); pieces of piece_rows
    held rows and as many asking ones. Rows are sent to their lists in
    waves of wave_rows, or of `wave` times the number of vectors if that is
    more. exact: no lists and no tests, all pairs of pieces.
    """

    dim: int = 64
    k: int = 10
    min_sim: float = 0.9
    list_rows: int = 128
    max_lists: int = 4096
    max_sublists: int = 256
    train_per_list: int = 8
    probes: int | None = None
    border_z: float = 2.5
    column_block: int = 16
    epsilon: float = 2.1
    piece_rows: int = 16384
    wave_rows: int = 1 << 20
    wave: float = 4.0
    exact: bool = False
    seed: int = 20


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column without nulls, all of length dim."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], pa.list_(pa.float32()))
    return np.asarray(flat.flatten(), np.float32).reshape(-1, dim)


def _lists(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, np.float32)
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())


def _prepare(dim: int, seed: int):
    """Batches of (id, vec): those usable, scaled and rotated, with two hashes that agree for copies of any length."""
    turn = rotation(dim, seed)
    factors = np.random.default_rng(seed).integers(1, 2**63, (2, dim), dtype=np.int64) | 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vec"), dim).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                top = np.abs(x).max(1, initial=0)
                good = np.isfinite(x).all(1) & (top > 0)
                x = x[good] / top[good, None]
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            steps = np.rint(x * 1e5).astype(np.int64)
            h = [(steps * f).sum(1) for f in factors]
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(good)), pa.array(h[0]), pa.array(h[1]), _lists(x.astype(np.float32) @ turn)], ["id", "h1", "h2", "vec"])

    return run


def _centroids(sample: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """k-means over the sample; an empty list keeps its centroid."""
    c = sample[:n].copy()
    for _ in range(rounds):
        at = np.concatenate([(s @ c.T - (c * c).sum(1) / 2).argmax(1) for s in np.array_split(sample, len(sample) // 4096 + 1)])
        sums = np.zeros_like(c)
        np.add.at(sums, at, sample)
        size = np.bincount(at, minlength=len(c))
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c.astype(np.float32)


def _placing(c: np.ndarray, scan: Scan):
    """For rows of vectors, the list of each, the lists to search for it, and how many these are."""
    half = (c * c).sum(1) / 2
    apart = np.sqrt(np.maximum(2 * (half[:, None] + half[None, :] - c @ c.T), 1e-9)).astype(np.float32)
    reach = math.sqrt(max(0.0, 2 - 2 * scan.min_sim)) * min(1.0, scan.border_z / math.sqrt(scan.dim))
    width = min(scan.probes or len(c), len(c))
    step = max(1, (1 << 21) // len(c))  # rows at a time: what is held doesn't grow with the number of lists

    def placed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = x @ c.T - half
        home = score.argmax(1)
        row = np.arange(len(x))
        border = (score[row, home][:, None] - score) / apart[home]
        border[row, home] = -1
        if width == len(c):
            kept = border <= reach
            return home, np.nonzero(kept)[1], kept.sum(1)
        near = np.argpartition(border, width - 1, axis=1)[:, :width]
        kept = np.take_along_axis(border, near, 1) <= reach
        return home, near[kept], kept.sum(1)

    def all_placed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        home, near, sizes = zip(*[placed(x[a : a + step]) for a in range(0, max(len(x), 1), step)], strict=True)
        return np.concatenate(home), np.concatenate(near), np.concatenate(sizes)

    return all_placed


def _assign(c: np.ndarray, scan: Scan):
    """Batches with `home`, the list of each vector, and `visits`, the lists to search for it; vectors and lists as bytes."""
    place, kind = _placing(c, scan), _list_type(len(c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vec"), scan.dim)
            if len(x) == 0:
                continue
            home, near, sizes = place(x)
            yield pa.RecordBatch.from_arrays([b.column("id"), _blobs(x, np.full(len(x), 1)), pa.array(home.astype(np.int32)), _blobs(near.astype(kind), sizes)], ["id", "vec", "home", "visits"])

    return run


def _list_type(lists: int) -> type:
    return np.uint16 if lists <= 1 << 16 else np.int32


def _blobs(rows: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of the first sizes[0] rows, of the next sizes[1] and so on."""
    ends = np.r_[0, np.cumsum(sizes)] * (rows[:1].nbytes if len(rows) else 0)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _flat(column: pa.Array, kind: np.dtype | type) -> np.ndarray:
    """All that _blobs made of a column without nulls."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _counted(lists: int):
    """Batches of (home, visits) as the rows held by and asking each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked = np.zeros((2, lists), np.int64)
        for b in batches:
            held += np.bincount(b.column("home").to_numpy(), minlength=lists)
            asked += np.bincount(_flat(b.column("visits"), _list_type(lists)), minlength=lists)
        at = np.flatnonzero(asked)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at]), pa.array(asked[at])], ["list", "held", "asked"])

    return run


@dataclass(frozen=True)
class Pieces:
    """How lists are cut: list l into cs[l] pieces of what it holds times vs[l] pieces of what asks it, numbered from first[l]; waves: the first piece of each wave, and the end."""

    cs: np.ndarray
    vs: np.ndarray
    first: np.ndarray
    waves: list[int]


def _pieces(held: np.ndarray, asked: np.ndarray, rows: int, scan: Scan) -> Pieces:
    """Pieces of piece_rows held rows and as many asking ones, about; as many to a wave as have wave_rows, or `wave` times `rows`."""
    cs, vs = np.maximum(1, -(-held // scan.piece_rows)), np.maximum(1, -(-asked // scan.piece_rows))
    ends = np.cumsum(cs * vs)
    each = np.repeat(asked / vs + held / cs * (vs > 1), cs * vs)  # rows sent to a piece
    wave = (np.cumsum(each) - each) // max(scan.wave_rows, scan.wave * rows)
    return Pieces(cs, vs, ends - cs * vs, [0, *(np.flatnonzero(np.diff(wave)) + 1).tolist(), int(ends[-1])])


def _row(dim: int) -> np.dtype:
    """A row on its way to a piece; role: 1 it asks, 2 it is held, 3 both."""
    return np.dtype([("id", "<i8"), ("role", "u1"), ("vec", "<f4", (dim,))])


def _mixed(ids: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each id, 0 to 2^32 - 1."""
    h = (ids.astype(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(32)).astype(np.int64)


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """counts[i] times i, for every i, and their numbers from 0."""
    return np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _sending(plan: Pieces, lists: int, begin: int, end: int, dim: int):
    """Batches of placed vectors as (piece, rows): what the pieces from begin to end get, many rows in one."""
    low, high = np.searchsorted(plan.first, [begin, end - 1], "right") - 1  # the lists of these pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, home = b.column("id").to_numpy(), b.column("home").to_numpy()
            visits, kind = b.column("visits").to_pylist(), _list_type(lists)
            at = np.repeat(np.arange(len(ids)), [len(v) // np.dtype(kind).itemsize for v in visits])
            to = np.frombuffer(b"".join(visits), kind)
            kept = (to >= low) & (to <= high)
            at, to = at[kept], to[kept].astype(np.int64)
            cs, vs = plan.cs[to], plan.vs[to]
            c, v, inside = _mixed(ids[at], 1) % cs, _mixed(ids[at], 2) % vs, home[at] == to
            x = _flat(b.column("vec"), np.float32).reshape(-1, dim)
            ends = np.cumsum(cs + inside * vs)
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(ends >> 20)) + 1):  # some million rows at a time, however many pieces a list has
                yield from sent(ids, x, at[part], plan.first[to[part]], cs[part], vs[part], c[part], v[part], inside[part])

    def sent(ids: np.ndarray, x: np.ndarray, at: np.ndarray, first: np.ndarray, cs: np.ndarray, vs: np.ndarray, c: np.ndarray, v: np.ndarray, inside: np.ndarray) -> Iterator[pa.RecordBatch]:
        many, own = _each(cs)  # a row asks every piece of what its list holds
        piece, row, role = [first[many] + own * vs[many] + v[many]], [at[many]], [1 + 2 * (inside[many] & (own == c[many]))]
        many, own = _each(np.where(inside, vs, 0))  # and is held for every piece of what asks it
        many, own = many[own != v[many]], own[own != v[many]]
        piece, row, role = (np.concatenate(p) for p in ((*piece, first[many] + c[many] * vs[many] + own), (*row, at[many]), (*role, np.full(len(many), 2))))
        order = np.flatnonzero((piece >= begin) & (piece < end))
        order = order[np.argsort(piece[order], kind="stable")]
        for s in range(0, len(order), 1 << 15):  # some 9 MB at a time
            part = order[s : s + (1 << 15)]
            rows = np.empty(len(part), _row(dim))
            rows["id"], rows["role"], rows["vec"] = ids[row[part]], role[part], x[row[part]]
            which, sizes = np.unique(piece[part], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(which), _blobs(rows, sizes)], ["piece", "rows"])

    return run


def _nearest(i: np.ndarray, j: np.ndarray, gone: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest candidates of each query, and the place of each among them."""
    order = np.lexsort((gone, i))
    i, j, gone = i[order], j[order], gone[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    kept = rank < k
    return i[kept], j[kept], gone[kept], rank[kept]


def scan_list(q: np.ndarray, x: np.ndarray, scan: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query rows, candidate rows and similarities found, and the number of products of dimensions spent.

    Keeps for each query its k + 1 nearest among x that reach min_sim (one
    more than asked, for itself, if it is there): what is held is bounded by
    the queries, however many candidates are near.
    """
    d, spent = scan.dim, 0
    bound = lambda t: np.inf if scan.exact else (1 + scan.epsilon / math.sqrt(t)) ** 2 * t / d
    first = min(scan.column_block, d)
    found = [(np.array([], int), np.array([], int), np.array([], np.float32))]
    right = np.c_[x[:, :first], (x[:, :first] ** 2).sum(1), np.ones(len(x), np.float32)].astype(np.float32).T  # |q|^2 + |x|^2 - 2 qx in one product
    for s in range(0, len(q), 4096):
        own, best = q[s : s + 4096], found[0]
        left = np.c_[-2 * own[:, :first], np.ones(len(own), np.float32), (own[:, :first] ** 2).sum(1)].astype(np.float32)
        limit = np.full(len(own), 2 - 2 * scan.min_sim, np.float32)  # squared distance; sinks as neighbours are found
        for a in range(0, len(x), 512):
            part = x[a : a + 512]
            near = left @ right[:, a : a + 512]
            spent += near.size * first
            i, j = np.divmod(np.flatnonzero(near <= (limit * bound(first) + 1e-6).astype(np.float32)[:, None]), len(part))
            gone = near[i, j]
            for t in range(first, d, scan.column_block):
                to = min(t + scan.column_block, d)
                gone = gone + ((own[i, t:to] - part[j, t:to]) ** 2).sum(1)
                spent += len(i) * (to - t)
                kept = gone <= limit[i] * (bound(to) if to < d else 1) + 1e-6
                i, j, gone = i[kept], j[kept], gone[kept]
            if len(i):
                i, j, gone, rank = _nearest(*map(np.concatenate, zip(best, (i, j + a, gone), strict=True)), scan.k + 1)
                full = rank == scan.k
                limit[i[full]] = np.minimum(limit[i[full]], gone[full])
                best = i, j, gone
        found.append((best[0] + s, *best[1:]))
    i, j, gone = map(np.concatenate, zip(*found, strict=True))
    return i, j, 1 - np.maximum(gone, 0) / 2, spent


def _search_lists(q: np.ndarray, x: np.ndarray, scan: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """scan_list by lists within x, if it is large: their centroids come from a sample of train_per_list rows each."""
    n = min(scan.max_sublists, len(x) // scan.list_rows) if len(x) >= 2 * scan.list_rows and not scan.exact else 1
    if n < 2:
        return scan_list(q, x, scan)[:3]
    place = _placing(_centroids(x[np.random.default_rng(scan.seed).permutation(len(x))[: n * scan.train_per_list]], n), scan)
    homes = place(x)[0]
    _, near, sizes = place(q)
    row = np.repeat(np.arange(len(q), dtype=np.int32), sizes)[(order := np.argsort(near, kind="stable"))]
    ends, best, held = np.searchsorted(near[order], np.arange(n + 1)), [], 0
    for s in range(n):
        asks, holds = row[ends[s] : ends[s + 1]], np.flatnonzero(homes == s)
        if len(asks) and len(holds):
            i, j, sim, _ = scan_list(q[asks], x[holds], scan)
            best.append((asks[i], holds[j], -sim))
            held += len(i)
        if held > max(1 << 20, 2 * len(q) * (scan.k + 1)):  # what is held is bounded by the queries
            best = [_nearest(*map(np.concatenate, zip(*best, strict=True)), scan.k + 1)[:3]]
            held = len(best[0][0])
    if not best:
        return np.array([], int), np.array([], int), np.array([], np.float32)
    i, j, gone, _ = _nearest(*map(np.concatenate, zip(*best, strict=True)), scan.k + 1)
    return i, j, -gone


def _search(scan: Scan):
    def run(group: pa.Table) -> pa.Table:
        rows = _flat(group.column("rows"), _row(scan.dim))
        ids = np.sort(rows["id"])
        rows = rows[np.argsort(rows["id"], kind="stable")]
        asks, holds = np.flatnonzero(rows["role"] & 1), np.flatnonzero(rows["role"] & 2)
        q, x = (np.ascontiguousarray(rows["vec"][at]) for at in (asks, holds))
        del rows
        i, j, sim = _search_lists(q, x, scan) if len(x) else (asks[:0], holds[:0], np.array([], np.float32))
        a, b = ids[asks[i]], ids[holds[j]]
        other = a != b
        a, b, sim = a[other], b[other], sim[other]
        order = np.lexsort((b, -sim, a))
        a, b, sim = a[order], b[order], sim[order]
        kept = np.arange(len(a)) - np.searchsorted(a, a) < scan.k
        return pa.table({"a": a[kept].astype(np.int64), "b": b[kept].astype(np.int64), "sim": sim[kept].astype(np.float32)})

    return run


def _edges(reps: DataFrame, scan: Scan) -> DataFrame:
    """a, b, sim: for each representative its k nearest of similarity min_sim at least. Deletes reps, a written table."""
    spark, n = reps.sparkSession, reps.count()
    if n == 0:
        return spark.createDataFrame([], "a long, b long, sim float")
    lists = 1 if scan.exact else max(1, min(scan.max_lists, n // scan.list_rows))
    want = lists * scan.train_per_list
    # the sample is bounded by max_lists * train_per_list rows
    sample = reps.select("vec").sample(min(1.0, 1.2 * want / n + 50 / n), seed=scan.seed).limit(want).toArrow()
    train = _matrix(sample.column("vec"), scan.dim)
    if len(train) == 0:
        train = _matrix(reps.select("vec").limit(1).toArrow().column("vec"), scan.dim)
    c = _centroids(train, min(lists, len(train)))
    placed = cut(reps.mapInArrow(_assign(c, scan), "id long, vec binary, home int, visits binary"))
    drop(reps)
    # three numbers a list: at most max_lists rows
    sizes = placed.select("home", "visits").mapInArrow(_counted(len(c)), "list int, held long, asked long").groupBy("list").agg(F.sum("held").alias("held"), F.sum("asked").alias("asked")).collect()
    held, asked = np.zeros((2, len(c)), np.int64)
    for r in sizes:
        held[r["list"]], asked[r["list"]] = r["held"], r["asked"]
    plan = _pieces(held, asked, n, scan)

    def wave(begin: int, end: int) -> DataFrame:
        sent = placed.mapInArrow(_sending(plan, len(c), begin, end, scan.dim), "piece long, rows binary")
        return sent.groupBy("piece").applyInArrow(_search(scan), "a long, b long, sim float")

    found = cut_parts(wave(begin, end) for begin, end in pairwise(plan.waves))
    drop(placed)
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    both = both.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.desc("sim"), "b"))).filter(F.col("rank") <= scan.k)


def similar(df: DataFrame, key: str, vector: str, scan: Scan = Scan()) -> DataFrame:
    """a, b, sim: for each id a its (up to) k most similar other ids b of similarity min_sim at least.

    key is a long; vector an array of float. Null, all-zero or non-finite
    vectors and those of another length than dim take no part, nor do null
    ids; length doesn't matter; repeated rows are one; an id with several
    vectors counts by each. Among equally similar ones (as are copies) the
    smaller ids come first. Further columns are ignored; an empty table gives
    no row. Approximate: a neighbour can be missed by the list or the test,
    but with scan.exact.
    """
    at = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vec")).filter(F.col("id").isNotNull() & (F.size("vec") == scan.dim) & ~F.exists("vec", lambda x: x.isNull()))
    with unshuffled(df.sparkSession):
        made = cut(at.mapInArrow(_prepare(scan.dim, scan.seed), "id long, h1 long, h2 long, vec array<float>"))
    copies = ["h1", "h2"]
    reps = made.groupBy(*copies).agg(F.min("id").alias("id"), F.min_by("vec", "id").alias("vec"))
    with unshuffled(df.sparkSession):
        reps = cut(reps.select("id", "vec"))
        members = cut(made.groupBy(*copies, "id").agg(F.lit(1).alias("one")).drop("one"))
    drop(made)
    edges = _edges(reps, scan)
    # the first k + 1 copies of each vector; the limit on the rank reaches below the exchange
    first = members.withColumn("rank", F.row_number().over(W.partitionBy(*copies).orderBy("id"))).filter(F.col("rank") <= scan.k + 1)
    first = first.groupBy(*copies).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    first = cut(first.withColumn("rep", F.element_at("ids", 1)))
    others = edges.join(first.select(F.col("rep").alias("b"), "ids"), "b").groupBy(F.col("a").alias("rep"))
    others = others.agg(F.collect_list(F.struct((-F.col("sim")).alias("order"), F.col("b"), "ids", "sim")).alias("others"))
    near = first.join(others, "rep", "left").filter((F.size("ids") > 1) | F.col("others").isNotNull())
    own = F.transform("ids", lambda x: F.struct(x.alias("b"), F.lit(1.0).cast("float").alias("sim")))
    more = F.flatten(F.transform(F.array_sort("others"), lambda o: F.transform(o["ids"], lambda x: F.struct(x.alias("b"), o["sim"].alias("sim")))))
    near = near.select(*copies, F.concat(own, F.coalesce(more, F.array().cast("array<struct<b:bigint,sim:float>>"))).alias("near"))
    pairs = members.join(near, copies).select(F.col("id").alias("a"), F.explode(F.slice(F.filter("near", lambda x: x["b"] != F.col("id")), 1, scan.k)).alias("to"))
    return pairs.select("a", "to.b", "to.sim")

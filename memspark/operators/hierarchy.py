"""Parent links to trees: root, depth, path, nested-set ranges, descendants, cycles.

Upward, subtree sizes; downward, preorder positions from prefix sums of the
sizes of earlier siblings, and with them depth, root and path. Ancestors and
descendants then follow from the ranges. Both passes quadruple the distance they
bridge in every round, so a tree of depth d takes log4(d) rounds, not d; nodes
that have come to their root stay out of later rounds. What the downward pass
doesn't reach from a root lies on a cycle or below one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.operators.prefix import prefix_sum
from memspark.tables import cut, cut_counting

def _open() -> Column:
    """Whether a node has not come to its root."""
    return F.col("ptr").isNotNull()


def _links(df: DataFrame, key: str, parent: str) -> DataFrame:
    """id, parent: one row per id; the parent null unless it names an id."""
    rows = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(parent).alias("parent"))
    known = rows.select(F.col("id").alias("known"))
    linked = rows.join(known, F.col("parent") == F.col("known"), "left")
    return cut(linked.select("id", F.col("known").alias("parent")))


def _led(at: DataFrame, changes: dict[str, Callable[[str, str], Column]]) -> DataFrame:
    """at with p2, p3 and ptr, where the pointers of open nodes lead in two, three and four of their steps, and with changes.

    Each step joins the same table, whose exchange is reused. A change makes
    of a column's value so far and that of the node pointed to the next.
    """
    up = at.select(F.col("id").alias("_at"), F.col("ptr").alias("_ptr"), *[F.col(c).alias(f"_{c}") for c in changes])
    moved = at.filter(_open()).withColumn("p1", F.col("ptr"))
    for step in ("p2", "p3", "p4"):
        moved = moved.join(up, F.col("ptr") == F.col("_at"), "left")
        moved = moved.select(*[c for c in moved.columns if c not in {"ptr", *changes} and not c.startswith("_")], *[f(c, f"_{c}").alias(c) for c, f in changes.items()], F.col("_ptr").alias("ptr"), F.col("_ptr").alias(step))
    return moved.drop("p4")


def _upward(links: DataFrame) -> tuple[DataFrame, int]:
    """links with the size of each subtree (of no use on or below cycles), and the rounds it took."""
    # sizes on cycles grow with every round: as doubles they can't overflow, below 2^53 they are exact
    at, left = cut_counting(links.select("id", "parent", F.col("parent").alias("ptr"), F.lit(1.0).alias("size")), _open())
    rounds = 0
    while left:
        moved = _led(at, {})
        over = moved.select(F.explode(F.array("p1", "p2", "p3")).alias("id"), "size").filter("id IS NOT NULL").groupBy("id").agg(F.sum("size").alias("more"))
        whole = at.filter(~_open()).unionByName(moved.select(*at.columns))
        grown = whole.join(over, "id", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0.0))).drop("more")
        before, (at, left), rounds = left, cut_counting(grown, _open()), rounds + 1
        if left == before:  # no node has the depths just bridged, so none is deeper
            break
    return at.drop("ptr"), rounds


def _downward(at: DataFrame, rounds: int | None, with_pre: bool, with_path: bool) -> DataFrame:
    """at (id, parent and further columns) with root (null where none leads to it) and depth; with pre, the sum of `step`, and path over the way from the root.

    Without a number of rounds, as many as it takes.
    """
    top = F.col("parent").isNull()
    made = at.withColumns({"ptr": F.col("parent"), "root": F.when(top, F.col("id")), "depth": (~top).cast("long")})
    made = made.withColumn("pre", F.col("step")) if with_pre else made
    made = made.withColumn("path", F.col("id")) if with_path else made
    plus = lambda own, up: F.col(own) + F.coalesce(up, F.lit(0))
    changes = {"root": lambda own, up: F.coalesce(own, up), "depth": plus}
    changes |= {"pre": plus} if with_pre else {}
    changes |= {"path": lambda own, up: F.concat_ws("/", up, own)} if with_path else {}
    made, left = cut_counting(made, _open())
    done = 0
    while left and (rounds is None or done < rounds):
        step = made.filter(~_open()).unionByName(_led(made, changes).select(*made.columns))
        before, (made, left), done = left, cut_counting(step, _open()), done + 1
        if left == before:
            break
    return made.withColumn("root", F.when(~_open(), F.col("root")))


def hierarchy(df: DataFrame, key: str = "id", parent: str = "parent_id", with_path: bool = False, with_ranges: bool = True) -> DataFrame:
    """id, root_id, depth, pre, last, n_descendants (and path, the ids from the root joined by /), one row per key.

    pre is the position in preorder within the tree (siblings by id, the root
    0), last that of the last descendant: b is below a exactly if both have
    one root and a.pre < b.pre <= a.last. A parent that is null or names no
    row makes a root. On a cycle (a row that names itself is one) or below,
    root_id is `cycle`, depth -1 and the rest null. Rows without a key are no
    nodes; rows of one key are one node, with the least of its parents;
    further columns are ignored; an empty table gives no row. Without ranges,
    there are only id, root_id, depth (and path), for less.
    """
    links = _links(df, key, parent)
    if with_ranges:
        sized, rounds = _upward(links)
        below = prefix_sum(sized.filter("parent is not null"), ["parent"], ["id"], "size", "earlier").withColumn("step", F.col("earlier") + 1).drop("earlier")
        links = below.unionByName(sized.filter("parent is null").withColumn("step", F.lit(0.0)))
        at = _downward(links, rounds, True, with_path)
    else:
        at = _downward(links, None, False, with_path)
    known = F.col("root").isNotNull()
    if with_ranges:
        at = at.withColumns({"pre": F.when(known, F.col("pre")).cast("long"), "size": F.when(known, F.col("size")).cast("long")})
        at = at.withColumns({"last": F.col("pre") + F.col("size") - 1, "n_descendants": F.col("size") - 1})
    at = at.withColumn("path", F.when(known, F.col("path"))) if with_path else at
    columns = [*["pre", "last", "n_descendants"] * with_ranges, *["path"] * with_path]
    return at.select("id", F.coalesce("root", F.lit("cycle")).alias("root_id"), F.when(known, F.col("depth")).otherwise(-1).alias("depth"), *columns)


def descendants(nodes: DataFrame) -> DataFrame:
    """id, descendant_id: every pair, from the ranges of hierarchy(); nodes on or below a cycle have none.

    A range is the union of at most two aligned blocks per power of two, and a
    position lies in one block per power: an equi-join on (tree, power, block)
    whose work follows the number of pairs, with no comparison that fails.
    """
    trees = nodes.filter("pre is not null").select("id", "root_id", "pre", "last")
    widest = trees.agg(F.max(F.col("last") - F.col("pre"))).first()[0] or 0
    top = max(1, math.ceil(math.log2(widest + 1)))
    powers = F.sequence(F.lit(0), F.lit(top))

    def blocks(i):
        width = F.pow(F.lit(2.0), i)
        low, high = F.ceil((F.col("pre") + 1) / width), F.floor((F.col("last") + 1) / width)
        first = F.when((low < high) & (low % 2 == 1), low)
        second = F.when((high % 2 == 1) & (low + F.coalesce(low % 2, F.lit(0)) < high), high - 1)
        return F.transform(F.array_distinct(F.array_compact(F.array(first, second))), lambda b: F.struct(i.alias("power"), b.alias("block")))

    above = trees.select("root_id", F.col("id"), F.explode(F.flatten(F.transform(powers, blocks))).alias("at"))
    above = above.select("root_id", "id", F.col("at.power").alias("power"), F.col("at.block").cast("long").alias("block"))
    below = trees.select("root_id", F.col("id").alias("descendant_id"), "pre", F.explode(powers).alias("power"))
    below = below.select("root_id", "descendant_id", "power", F.floor(F.col("pre") / F.pow(F.lit(2.0), "power")).cast("long").alias("block"))
    return above.join(below, ["root_id", "power", "block"]).select("id", "descendant_id")

"""History of changing attributes from updates that arrive in any order.

Insert-only satellites: a row is appended where the hash of the value differs
from that of the update before (or that one had ended), and an end row where
an update ends before the next begins. No row is ever changed; the end of a
version is the time of the next row, read by versions() with lead. Attributes
that change often and those that rarely do go to two satellites, each a table
of its own with a view of its own. A key of any size is spread
over ranges of (key, time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.operators.prefix import neighbour, ranged
from memspark.tables import cut

#: An attribute whose keys change more often than this on average is a fast one.
FAST_CHANGES = 4.0


def satellites(updates: DataFrame, keys: list[str], attribute: str, fast_changes: float = FAST_CHANGES) -> dict[str, DataFrame]:
    """The satellites fast and slow: keys, at_us, hash, value, ended (and _range), the rows appended, `ended` marking ends.

    updates: keys, from_us, to_us, value, rank; attribute is one of the keys.
    Of updates of one key and from_us the one of the greatest rank counts
    (which so must tell them apart); a to_us not after from_us is ignored;
    rows without from_us can't be placed and don't count. Keys and values may
    be null, null values being equal. No update, no row.
    """
    rows = updates.filter("from_us is not null").groupBy(*keys, "from_us").agg(F.max_by(F.struct("to_us", "value"), "rank").alias("at"))
    rows = rows.select(*keys, "from_us", F.when(F.col("at.to_us") > F.col("from_us"), F.col("at.to_us")).alias("until_us"), F.col("at.value").alias("value"))
    rows = ranged(rows.withColumn("hash", F.sha2("value", 256)), keys, ["from_us"])
    rows = neighbour(rows, keys, "from_us", ["hash", "until_us"], "prev", forward=False)
    rows = neighbour(rows, keys, "from_us", ["from_us"], "next", forward=True)
    adjoins = F.col("prev").isNotNull() & F.coalesce(F.col("prev.until_us") >= F.col("from_us"), F.lit(True))
    starts = ~(adjoins & F.col("prev.hash").eqNullSafe(F.col("hash")))
    ends = F.col("until_us").isNotNull() & F.coalesce(F.col("until_us") < F.col("next.from_us"), F.lit(True))
    row = lambda at, ended: F.struct(F.col(at).alias("at_us"), F.lit(ended).alias("ended"))
    emitted = F.array_compact(F.array(F.when(starts, row("from_us", False)), F.when(ends, row("until_us", True))))
    rows = cut(rows.select(*keys, "_range", "hash", "value", F.col("prev").isNull().alias("opens"), F.explode(emitted).alias("row")).select(*keys, "_range", "hash", "value", "opens", "row.*"))
    begun = F.count_if(~F.col("ended"))
    rates = rows.groupBy(F.col(attribute).alias("_attribute")).agg((begun > fast_changes * F.count_if(F.col("opens") & ~F.col("ended"))).alias("_fast"))
    # as many rows as attributes change fast
    fast = cut(rates.filter("_fast").select("_attribute"))
    same = F.col(attribute).eqNullSafe(F.col("_attribute"))
    return {"fast": cut(rows.join(fast, same, "left_semi").drop("opens")), "slow": cut(rows.join(fast, same, "left_anti").drop("opens"))}


def versions(appended: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value, from_us, to_us (null: no end) of every version: the view of one satellite."""
    rows = neighbour(appended, keys, "at_us", ["at_us"], "next", forward=True).filter(~F.col("ended"))
    return rows.select(*keys, "value", F.col("at_us").alias("from_us"), F.col("next.at_us").alias("to_us"))


def history(updates: DataFrame, keys: list[str], attribute: str, fast_changes: float = FAST_CHANGES) -> DataFrame:
    """keys, value, satellite, from_us, to_us of every version, from both satellites."""
    views = [versions(df, keys).withColumn("satellite", F.lit(name)) for name, df in satellites(updates, keys, attribute, fast_changes).items()]
    return views[0].unionByName(views[1]).select(*keys, "value", "satellite", "from_us", "to_us")

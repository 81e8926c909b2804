"""Reading tables, and cutting lineage through the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_US = 86_400_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`, a Parquet file or directory."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset (tests, local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + os.path.join(tempfile.gettempdir(), f"memspark-{os.getpid()}")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df as a written table: its lineage ends there, a lost executor costs no recomputation, and later reads prune columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/memspark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def unshuffled(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files: each write removes its own, not the collector of the driver's garbage some day."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was) if was is not None else spark.conf.unset(name)


def cut_parts(parts: Iterable[DataFrame]) -> DataFrame:
    """The rows of all parts (one at least, of one schema) as one written table; a part is asked for when those before it are written and their shuffles gone."""
    path = ""
    for part in parts:
        spark, schema = part.sparkSession, part.schema
        path = path or f"{shared_folder(spark)}/memspark/{uuid.uuid4().hex}"
        with unshuffled(spark):
            part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the table that cut() or cut_parts() wrote; nothing may read it any more."""
    spark = df.sparkSession
    for name in {f.split("/")[-2] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/memspark/{name}")
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def cut_observing(df: DataFrame, *aggregates: Column) -> tuple[DataFrame, dict]:
    """cut(df), and aggregates (with aliases) over its rows, computed as they are written; of no row, none."""
    seen = Observation()
    at = cut(df.observe(seen, *aggregates))
    return at, seen.get


def cut_counting(df: DataFrame, which: Column) -> tuple[DataFrame, int]:
    """cut(df), and the number of its rows for which `which` holds."""
    at, seen = cut_observing(df, F.count_if(which).alias("n"))
    return at, seen.get("n") or 0


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application: they need not find it on a path of their own."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="memspark-")) / "memspark.zip"  # on the driver only; Spark passes it on
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """df, read straight from files, in as many partitions at least as tasks run at once.

    A table of few small files would otherwise give Python work to a few
    tasks. Larger tables have more splits than that and are left alone.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970-01-01 00:00 of a time column, whatever the session's time zone."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        seconds = F.hour(c) * 3600 + F.minute(c) * 60
        return F.unix_date(c.cast("date")).cast("long") * DAY_US + seconds.cast("long") * 1_000_000 + (F.expr(f"extract(SECOND FROM `{name}`)") * 1_000_000).cast("long")
    return F.unix_micros(c.cast("timestamp"))


def stripped(c: Column) -> Column:
    """c without white space at either end (Unicode white space, not only blanks)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def ref_key(c: Column) -> Column:
    """The form in which references compare: trimmed, letter case ignored; null where nothing is left."""
    key = F.lower(stripped(c))
    return F.when(key != "", key)

"""Structured Streaming versions: current state, error fingerprints, sessions.

All read files as they come and keep one state row per key; with availableNow
they drain what is there and stop, so their result equals the batch result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions.text import error_fingerprint
from memspark.operators.state import KEY, state_rows
from memspark.tables import shared_folder, table


def files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of the files of a table (a file or a directory)."""
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{name}.parque*")


def drained(stream: DataFrame, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """What the stream has when all that is there is read, as a table.

    The sink is written in the shared folder; the checkpoint too, unless one
    is given, with which a later run goes on where this one ended.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/memspark/stream-{uuid.uuid4().hex}"
    # overwritten by batch in complete mode, so that a batch that is run again changes nothing
    put: Callable[[DataFrame, int], None] = lambda df, i: df.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={i}")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def current_state(triples: DataFrame) -> DataFrame:
    """The last write of each key by arrival: a row of state per key, whatever is late."""
    last = F.max_by(F.struct("object_id", "object_value", "valid_from"), F.col("id"))
    return state_rows(triples).groupBy(*KEY).agg(F.max("id").alias("id"), last.alias("s")).select(*KEY, "id", "s.object_id", "s.object_value")


def fingerprints(events: DataFrame, scope: str = "global") -> DataFrame:
    """fingerprint, n, last_ts of errors; from two on an advice is due."""
    errors = events.filter("event_type = 'error'")
    key = error_fingerprint(F.lit(scope), F.col("event_type"), F.col("props"))
    return errors.groupBy(key.alias("fingerprint")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).withColumn("prompt", F.col("n") >= 2)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """user_id, start_ts, end_ts, n of runs of events without a pause of `gap`, for append mode: a session comes out, and its state goes, when the watermark (`late` behind the last event) has passed its end."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    made = timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return made.select("user_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def promotions(fragments: DataFrame, threshold: int = 800) -> DataFrame:
    """Session items (layer L0) long enough for L1, as they come: stateless."""
    from memspark.operators.fusion import token_estimate

    rows = fragments.filter("layer = 'L0'").withColumn("tokens", token_estimate(F.col("content"))).filter(F.col("tokens") > threshold)
    return rows.select("id", "scope", F.lit("L1").alias("layer"), "content", F.coalesce("time_start", "created_at").alias("time_start"), "tokens")

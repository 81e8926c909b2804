"""Small keyed stores and logs over Parquet and JSON: session snapshots, audit log, access counts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.tables import cut

SNAPSHOT = "session_id string, data string, updated_at timestamp, expires_at timestamp"


class Snapshots:
    """Snapshots of sessions as an append-only log: the last entry of a session counts, a null one deletes it."""

    def __init__(self, spark: SparkSession, path: str, ttl: timedelta = timedelta(days=1)):
        self.spark, self.path, self.ttl = spark, path, ttl

    def _append(self, session: str, data: str | None, now: datetime) -> None:
        self.spark.createDataFrame([(session, data, now, now + self.ttl)], SNAPSHOT).coalesce(1).write.mode("append").parquet(self.path)

    def save(self, session: str, data: str, now: datetime) -> None:
        self._append(session, data, now)

    def delete(self, session: str, now: datetime) -> None:
        self._append(session, None, now)

    def listed(self, now: datetime) -> DataFrame:
        """session_id, data, updated_at, expires_at of those that stand at `now`."""
        log = self.spark.read.schema(SNAPSHOT).parquet(self.path)
        last = log.groupBy("session_id").agg(F.max_by(F.struct("data", "updated_at", "expires_at"), "updated_at").alias("s")).select("session_id", "s.*")
        return last.filter(F.col("data").isNotNull() & (F.col("expires_at") > F.lit(now)))

    def cleanup(self, now: datetime) -> None:
        """Writes the log anew with only what stands at `now`: what expired, was deleted or replaced is gone."""
        kept = cut(self.listed(now).select("session_id", "data", "updated_at", "expires_at"))
        kept.coalesce(1).write.mode("overwrite").parquet(self.path)

    def load(self, session: str, now: datetime) -> str | None:
        row = self.listed(now).filter(F.col("session_id") == session).first()
        return row["data"] if row else None


def audit(actions: DataFrame, path: str, content: str = "content") -> None:
    """Appends JSON lines in which a digest stands for the content."""
    actions.withColumn(content, F.sha2(F.col(content), 256)).withColumnRenamed(content, "content_sha256").write.mode("append").json(path)


def with_access(fragments: DataFrame, log: DataFrame) -> DataFrame:
    """fragments with the accesses of a log (id, at) added to access_count and last_accessed_at."""
    hits = log.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    rows = fragments.join(hits, F.col("id") == F.col("_id"), "left")
    return rows.withColumns({"access_count": F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0)), "last_accessed_at": F.greatest("last_accessed_at", "_at")}).drop("_id", "_n", "_at")

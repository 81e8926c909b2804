"""Queries of the streams over the tables of a folder, drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.streaming import streams
from memspark.tables import micros


def stream_current_state(spark, folder):
    return streams.drained(streams.current_state(streams.files(spark, folder, "triples")))


def stream_fingerprints(spark, folder):
    rows = streams.drained(streams.fingerprints(streams.files(spark, folder, "events")))
    return rows.select("fingerprint", "n", micros(rows, "last_ts").alias("last_us"), "prompt")


def stream_sessions(spark, folder):
    """The sessions that have ended by a watermark of an hour."""
    rows = streams.drained(streams.sessions(streams.files(spark, folder, "events"), late="1 hour"), "append")
    return rows.select("user_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "n")


def stream_promotions(spark, folder):
    return streams.drained(streams.promotions(streams.files(spark, folder, "temporal_fragments"), 60), "append").select("id", "tokens").distinct()


QUERIES = {q.__name__: q for q in (stream_current_state, stream_fingerprints, stream_sessions, stream_promotions)}

SQL = {
    "stream_current_state": "SELECT scope, subject_id, predicate, id, object_id, object_value FROM triples WHERE starts_with(scope, 'project:') AND relation_type IN ('project_state', 'task_status', 'config') QUALIFY row_number() OVER (PARTITION BY scope, subject_id, predicate ORDER BY id DESC) = 1",
    "stream_fingerprints": "SELECT substr(sha256('global|error|' || substr(regexp_replace(lower(trim(props)), '\\d+', '#', 'g'), 1, 200)), 1, 16) AS fingerprint, count(*) AS n, epoch_us(max(ts)) AS last_us, count(*) >= 2 AS prompt FROM events WHERE event_type = 'error' GROUP BY 1",
    "stream_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT to_timestamp(floor(epoch_ms(max(ts)) / 1000.0))::TIMESTAMP FROM events) - INTERVAL 1 HOUR""",
    "stream_promotions": "SELECT DISTINCT id, floor(length(content) / 4)::INT AS tokens FROM temporal_fragments WHERE layer = 'L0' AND floor(length(content) / 4) > 60",
}

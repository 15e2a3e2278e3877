"""Extension queries beyond the reference: session windows over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import sessions
from .registry import query, read


@query(
    """WITH l AS (SELECT *, CASE WHEN ts >= lag(ts) OVER q + INTERVAL 2 HOUR OR lag(ts) OVER q IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW q AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM l) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS events, round(sum(value), 4) AS value FROM s GROUP BY user_id, nth"""
)
def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions of each user that end after two hours without an event, as one batch."""
    rows = read(spark, sf_dir, "events")
    made = rows.groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return made.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")


@query()
def stream_step_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the event before each event of a user, by a stateful stream over the events."""
    return sessions.run_once(sessions.step_lag(sessions.source(spark, f"{sf_dir}/events.parquet")))


@query("SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def step_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the same of the whole table, by a window."""
    return sessions.lagged(read(spark, sf_dir, "events"))

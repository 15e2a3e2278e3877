"""Session windows and a stateful step lag over a stream of events (an extension; the reference has no streams)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """Events of a folder or file as a stream, a few files a micro-batch."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(folder)


def session_windows(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Events and value of each user in windows that end after a gap; late rows beyond the watermark are dropped by Spark."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")


def step_lag(events: DataFrame) -> DataFrame:
    """Each event of a user with the type of the one before, kept as state between batches.

    A user's rows of one micro-batch are sorted in one task; the source bounds them by
    its files. For a table that is there as a whole, take lagged().
    """

    def lag(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])  # one user's rows of one micro-batch
        rows["before"] = [before, *rows["event_type"].iloc[:-1]]
        state.update((rows["event_type"].iloc[-1],))
        yield rows[["event_id", "user_id", "event_type", "before"]]

    return events.groupBy("user_id").applyInPandasWithState(lag, "event_id long, user_id long, event_type string, before string", "before string", "append", GroupStateTimeout.NoTimeout)


def lagged(events: DataFrame) -> DataFrame:
    """The same of a table, by a window that Spark sorts and spills."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("event_id", "user_id", "event_type", F.lag("event_type").over(order).alias("before"))


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all that is there into Parquet in the shared folder and read it back."""
    spark = stream.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_streams"
    path = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")

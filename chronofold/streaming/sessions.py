"""Islands of a stream of events: session windows behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """user_id, start, last, n of events (user_id, ts) at most gap apart; also runs on a batch.

    A session closes gap after its last event: unlike the batch islands, an event exactly gap later opens a new one.
    """
    e = events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", gap)).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("session_window")

"""Streaming forms of the session and resume operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_counts(events: DataFrame, ttl: str = "7200 seconds", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream: closed, and sent on, when the watermark has passed their end."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", ttl).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("ended")).select("user_id", F.col("w.start").alias("started"), "ended", "n_events")


def first_rows(requests: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each key once, whatever is sent again within the watermark."""
    return requests.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Append all that is there to a Parquet folder, once and exactly, then stop."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

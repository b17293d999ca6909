"""Streams with timers and capacity against the batch operators on the events table, in batches out of order."""

import pytest
from pyspark.sql import functions as F

from talkweft.operators import state as R
from talkweft.streaming import expiry as X

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{DATA}/events.parquet").select("event_id", F.pmod("user_id", F.lit(12)).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"))


def streamed(spark, rows, folder, made, batches=6):
    """Each row goes to a batch by its time, shifted a little by its id, so that rows come late but within the watermark."""
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first).total_seconds() / batches + 1
    late = F.unix_micros("ts") / 1e6 + F.pmod(F.col("event_id") * 7919, F.lit(3000))
    numbered = rows.withColumn("batch", F.floor((late - first.timestamp()) / step))
    for b in range(batches + 1):
        numbered.where(F.col("batch") == b).drop("batch").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    made(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_sessions_with_timers(spark, events, tmp_path):
    """All sessions but those that the last watermark leaves open, and nothing else."""
    got = {(r.user_id, r.started, r.ended, r.n_events) for r in streamed(spark, events, str(tmp_path), lambda s: X.session_rows(s, 36_000)).collect()}
    want = {(r.user_id, r.started, r.ended, r.n_events) for r in R.sessions(events, "user_id", "ts", 36_000).collect()}
    newest = max(w[2] for w in want)
    closed = {w for w in want if (newest - w[2]).total_seconds() > 36_000 + 3_600 + 4}
    assert closed <= got <= want and len(closed) > 20 and any(w[3] > 5 for w in closed)


def test_cache_with_eviction(spark, events, tmp_path):
    sent = streamed(spark, events.withColumn("user_id", F.pmod(F.col("event_id") * 31, F.lit(200))), str(tmp_path), lambda s: X.recent_rows(s, 10, 3))
    rows = events.withColumn("user_id", F.pmod(F.col("event_id") * 31, F.lit(200)))
    want = [tuple(r) for r in R.least_recent_kept(rows, "user_id", "ts", "event_id", 10).collect()]
    assert [tuple(r) for r in R.least_recent_kept(sent, "user_id", "last_seen", "tie", 10).collect()] == want and sent.count() < rows.count()


def test_empty_stream(spark, events, tmp_path):
    events.where("false").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    X.session_rows(source).writeStream.format("memory").queryName("none_open").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("none_open").count() == 0

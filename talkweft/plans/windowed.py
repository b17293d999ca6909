"""Registered queries of interval joins, with their SQL as nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import windows as N
from .catalog import query

# Jobs: each 25th event starts one of its user that runs for as many minutes as its value says; some never ended.
_JOBS = "j AS (SELECT event_id AS job, user_id, ts AS started, CASE WHEN event_id % 100 <> 75 THEN ts + to_microseconds((value * 60000000)::BIGINT) END AS finished FROM events WHERE event_id % 25 = 0)"


def _jobs(df: DataFrame) -> DataFrame:
    length = F.expr("timestampadd(MICROSECOND, CAST(round(value * 60000000) AS BIGINT), ts)")
    return df.where("event_id % 25 = 0").select(F.col("event_id").alias("job"), "user_id", F.col("ts").alias("started"), F.when(F.col("event_id") % 100 != 75, length).alias("finished"))


@query("events", f"""WITH {_JOBS}, a AS (SELECT event_id, count(*) AS n_open, min(job) AS first_job, count(*) FILTER (e.user_id = j.user_id) AS n_own FROM events e JOIN j ON e.ts >= started AND e.ts <= finished GROUP BY 1)
SELECT event_id, coalesce(n_open, 0) AS n_open, first_job, coalesce(n_own, 0) AS n_own FROM events LEFT JOIN a USING (event_id)""")
def open_jobs(df: DataFrame) -> DataFrame:
    """The jobs that run at the time of every event, and how many of them are its user's."""
    jobs = _jobs(df).select("job", F.col("user_id").alias("owner"), "started", "finished")
    pairs = N.interval_join(df.select("event_id", "user_id", "ts"), "ts", jobs, "started", "finished", how="left")
    return pairs.groupBy("event_id").agg(F.count("job").alias("n_open"), F.min("job").alias("first_job"), F.count_if(F.col("owner") == F.col("user_id")).alias("n_own"))


@query("events", f"""WITH {_JOBS} SELECT event_id, concat_ws('; ', CASE WHEN event_type <> 'click' THEN 'dataset_revision: metadata=''' || event_type || ''', requested=''click''' END, CASE WHEN user_id % 7 = 0 THEN 'base_model: metadata=None, requested=''b''' END) AS mismatches
FROM events e WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.user_id = e.user_id AND e.ts >= started AND e.ts <= finished + INTERVAL 1 SECOND)""")
def outside_windows(df: DataFrame) -> DataFrame:
    """Events in no window of their user's jobs, and what their other marks of origin get wrong."""
    out = N.outside_windows(df.select("event_id", "user_id", "ts", "event_type"), "ts", _jobs(df), "user_id", "started", "finished")
    base = F.when(F.col("user_id") % 7 != 0, "b")
    wrong = N.mismatches({"dataset_revision": (F.col("event_type"), F.lit("click")), "base_model": (base, F.lit("b"))})
    return out.select("event_id", F.array_join(wrong, "; ").alias("mismatches"))

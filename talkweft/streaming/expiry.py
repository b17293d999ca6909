"""State of a stream with a time to live and with a capacity: sessions closed by timers, and a cache that forgets the least recent.

Both give what the batch operators ``state.sessions`` and ``state.least_recent_kept`` give of the same rows, whatever the
micro-batches are, for rows that come no later than the watermark allows. State is kept by Spark's state store and checkpointed
with the query: a few small rows a user, or at most the capacity a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SESSION = "user_id long, started timestamp, ended timestamp, n_events long"
SEEN = "user_id long, last_seen timestamp, tie long"


def with_state_store(spark: SparkSession) -> None:
    """Arbitrary state needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _longs(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


class Sessions(StatefulProcessor):
    """A user's sessions that the watermark hasn't closed: started and ended in microseconds, and rows. Late rows may join two of them."""

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _longs("started", "ended", "n"))

    def _held(self) -> list[tuple]:
        return [tuple(s) for s in self.open.get()] if self.open.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        merged: list[tuple] = []
        for started, ended, n in sorted(self._held() + [(t, t, 1) for batch in rows for t in batch["at"].tolist()]):
            if merged and started - merged[-1][1] <= self.ttl:
                merged[-1] = (merged[-1][0], max(ended, merged[-1][1]), merged[-1][2] + n)
            else:
                merged.append((started, ended, n))
        self.open.put(merged)
        set_ = {t for t in self.handle.listTimers()}
        for _, ended, _ in merged:
            at = (ended + self.ttl) // 1000 + 1  # the first millisecond after which no row can join
            if at not in set_:
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs()
        held = self._held()
        closed = [s for s in held if (s[1] + self.ttl) // 1000 + 1 <= passed]
        if len(closed) == len(held):
            self.open.clear()
        elif closed:
            self.open.put([s for s in held if s not in closed])
        if closed:
            started, ended, n = zip(*closed, strict=True)
            yield pd.DataFrame({"user_id": [key[0]] * len(closed), "started": pd.to_datetime(list(started), unit="us"), "ended": pd.to_datetime(list(ended), unit="us"), "n_events": list(n)})

    def close(self) -> None:
        pass


def session_rows(events: DataFrame, ttl_seconds: int = 7200, late: str = "1 hour", user: str = "user_id", at: str = "ts") -> DataFrame:
    """Closed sessions of a stream of (user, time) rows: SESSION rows, sent on when the watermark passes their end by the time to live."""
    with_state_store(events.sparkSession)
    rows = events.where(F.col(user).isNotNull() & F.col(at).isNotNull()).select(F.col(user).cast("long").alias("user_id"), F.col(at).cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.withColumn("at", F.unix_micros("ts")).groupBy("user_id").transformWithStateInPandas(Sessions(ttl_seconds), SESSION, "append", "EventTime")


class Recent(StatefulProcessor):
    """A shard's most recent users, at most ``most`` of them; each batch's users that stay are sent on."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.users = handle.getMapState("users", _longs("user_id"), _longs("at", "tie"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: tuple(v) for k, v in self.users.iterator()} if self.users.exists() else {}
        fresh: dict[int, tuple] = {}
        for batch in rows:
            for u, at, tie in zip(batch["user_id"].tolist(), batch["at"].tolist(), batch["tie"].tolist(), strict=True):
                fresh[u] = max(fresh.get(u, (at, tie)), (at, tie))
        both = held | {u: max(v, held.get(u, v)) for u, v in fresh.items()}
        kept = dict(sorted(both.items(), key=lambda x: x[1], reverse=True)[: self.most])
        for u in held.keys() - kept.keys():
            self.users.removeKey((u,))
        sent = [u for u in fresh if u in kept and kept[u] != held.get(u)]
        for u in sent:
            self.users.updateValue((u,), kept[u])
        if sent:
            yield pd.DataFrame({"user_id": sent, "last_seen": pd.to_datetime([kept[u][0] for u in sent], unit="us"), "tie": [kept[u][1] for u in sent]})

    def close(self) -> None:
        pass


def recent_rows(events: DataFrame, most: int = 32, shards: int = 64, user: str = "user_id", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """SEEN rows of a stream: a user is sent on with each batch that sees it, if it is among its shard's ``most`` most recent.

    The cache after any number of batches is ``state.least_recent_kept`` of what was sent: a user that a shard has let go has
    at least ``most`` users before it.
    """
    with_state_store(events.sparkSession)
    rows = events.where(F.col(user).isNotNull() & F.col(at).isNotNull()).select(F.col(user).cast("long").alias("user_id"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(tie).cast("long").alias("tie"))
    return rows.withColumn("shard", F.pmod(F.xxhash64("user_id"), F.lit(shards))).groupBy("shard").transformWithStateInPandas(Recent(most), SEEN, "append", "None")

"""State over event logs: last write, sessions by time to live, least recently used, top rows, resume, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold, norm_spaces


def last_write(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Each key's values after its last row: a grouped maximum, combined before the shuffle."""
    return df.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v"), F.count(F.lit(1)).alias("n_writes")).select(key, "v.*", "n_writes")


def sessions(df: DataFrame, user: str, at: str, ttl: int) -> DataFrame:
    """Runs of a user's rows with no gap over ``ttl`` seconds."""
    w = Window.partitionBy(user).orderBy(at)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    rows = df.withColumn("_new", F.when(gap <= ttl * 1_000_000, 0).otherwise(1)).withColumn("session_no", F.sum("_new").over(w))
    return rows.groupBy(user, "session_no").agg(F.count(F.lit(1)).alias("n_events"), F.min(at).alias("started"), F.max(at).alias("ended"))


def least_recent_kept(df: DataFrame, user: str, at: str, tie: str, most: int) -> DataFrame:
    """The users that a cache of ``most`` holds after all rows: those last seen latest (ties: larger row id)."""
    last = df.groupBy(user).agg(F.max(F.struct(at, tie)).alias("seen"))
    return last.orderBy(F.desc("seen")).limit(most).select(user, F.col(f"seen.{at}").alias("last_seen"))


def top_rows(df: DataFrame, key: str, order: list[Column], k: int, name: str = "row_no") -> DataFrame:
    """The first k rows of every key; Spark keeps k rows a key before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def selected(requests: DataFrame, rows: DataFrame, owner: str, row_id: str, text: str, newest: str, eligible: Column, what: str, by: str) -> DataFrame:
    """Of each request (request_id, owner, wanted_id, wanted_text) the row it selects, or why there is none.

    By id: that row of its owner. By text: the one eligible row whose text is the same but for case; more or none fail. By neither:
    the newest eligible row (ties: the larger id). By both: refused. Requests that repeat are rows of their own.
    """
    good = rows.where(eligible)
    both = F.col("wanted_id").isNotNull() & F.col("wanted_text").isNotNull()
    by_id = requests.where(F.col("wanted_id").isNotNull() & ~both).join(rows.select(owner, F.col(row_id).alias("wanted_id"), F.lit(1).alias("_n")), [owner, "wanted_id"], "left").select("request_id", F.when(F.col("_n").isNotNull(), F.col("wanted_id")).alias(row_id), F.when(F.col("_n").isNull(), f"no matching synthetic {what}").alias("failure"))
    texts = good.groupBy(owner, casefold(F.col(text)).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.min(row_id).alias(row_id))
    by_text = requests.where(F.col("wanted_text").isNotNull() & ~both).withColumn("_key", casefold(F.col("wanted_text"))).join(texts, [owner, "_key"], "left")
    found = F.coalesce("_n", F.lit(0))
    by_text = by_text.select("request_id", F.when(found == 1, F.col(row_id)).alias(row_id), F.when(found != 1, F.concat(F.lit(f"expected exactly one matching synthetic {what}; found "), found.cast("string"))).alias("failure"))
    last = good.groupBy(owner).agg(F.max_by(row_id, F.struct(newest, row_id)).alias(row_id))
    neither = requests.where(F.col("wanted_id").isNull() & F.col("wanted_text").isNull()).join(last, owner, "left").select("request_id", row_id, F.when(F.col(row_id).isNull(), f"no matching synthetic {what}").alias("failure"))
    refused = requests.where(both).select("request_id", F.lit(None).cast(rows.schema[row_id].dataType).alias(row_id), F.lit(f"select a {what} by ID or {by}, not both").alias("failure"))
    return by_id.unionByName(by_text).unionByName(neither).unionByName(refused)


def pending(requests: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return requests.join(done.select(*key).distinct(), key, "left_anti")


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, key, "full_outer").where("_l IS NULL OR _r IS NULL")
    return both.select(key, F.when(F.col("_l").isNull(), "extra").otherwise("missing").alias("problem"))


def conflicts(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose rows differ."""
    row = F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in columns]), 256)
    return df.groupBy(key).agg(F.min(row).alias("a"), F.max(row).alias("b"), F.count(F.lit(1)).alias("n_rows")).where("a <> b").select(key, "n_rows")


def replayed(calls: Column, cards: Column, transfers: Column) -> Column:
    """Cards and transfers after a list of calls (name, selector); a null selector takes the first row."""

    def first(rows: Column, field: str, selector: Column) -> Column:
        same = (lambda r: r[field] == selector) if field == "last4" else (lambda r: norm_spaces(r[field]) == norm_spaces(selector))
        return F.array_position(F.transform(rows, lambda r: selector.isNull() | F.coalesce(same(r), F.lit(False))), True)

    def with_status(rows: Column, field: str, at: Column, status: str) -> Column:
        return F.transform(rows, lambda r, i: F.struct(r[field].alias(field), F.when(i + 1 == at, F.lit(status)).otherwise(r["status"]).alias("status")))

    def step(s, c):
        card, transfer = first(s["cards"], "last4", c["selector"]), first(s["transfers"], "recipient", c["selector"])
        cards = F.when(c["name"] == "freeze_card", with_status(s["cards"], "last4", card, "frozen")).when(c["name"] == "replace_card", with_status(s["cards"], "last4", card, "replacement_pending")).otherwise(s["cards"])
        moved = F.when(c["name"] == "cancel_transfer", with_status(s["transfers"], "recipient", transfer, "cancelled")).otherwise(s["transfers"])
        return F.struct(cards.alias("cards"), moved.alias("transfers"))

    return F.aggregate(calls, F.struct(cards.alias("cards"), transfers.alias("transfers")), step)


def ordered_turn_violations(messages: DataFrame) -> DataFrame:
    """conv_id with the list of what is wrong: roles, order, blanks, no final answer, short final answer."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.withColumn("_before", F.lag("role").over(w)).withColumn("_no", F.row_number().over(w))
    ends = F.struct(F.col("turn"), F.col("role"), F.size(F.filter(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " "), lambda x: x != "")).alias("words"))
    found = rows.groupBy("conv_id").agg(F.bool_or(~F.col("role").isin("system", "user", "assistant")).alias("a"), F.bool_or((F.col("role") == "system") & (F.col("_no") > 1)).alias("b"), F.bool_or(F.coalesce((F.col("role") == F.col("_before")), F.lit(False))).alias("c"), F.bool_or(F.trim("text") == "").alias("d"), F.max(ends).alias("last"))
    marks = F.array_compact(F.array(F.when(F.col("a"), "unknown role"), F.when(F.col("b"), "system turn not first"), F.when(F.col("c"), "role repeats"), F.when(F.col("d"), "blank turn"), F.when(F.col("last.role") != "assistant", "no final answer"), F.when((F.col("last.role") == "assistant") & (F.col("last.words") < 7), "final answer too short")))
    return found.select("conv_id", F.array_join(marks, "; ").alias("violations"))

"""Rows made from rows: alignment and router expansions, topic shifts, targeted rows; unions in order; records made whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_rank, strip
from .corpus import ranked
from .router_rows import history_of, split_wording

# How many realizations an alignment record has in each split.
REALIZATIONS = {"train": 32, "validation": 8, "test": 4}
# Prompts that follow every anchor, with their kind and relations.
FOLLOW_UPS = [
    ("Could you tell me when that item was recorded", "contextual_followup", "context_dependent"),
    ("What happened with the other one you mentioned", "contextual_followup", "context_dependent"),
    ("Actually I meant the banking item from before", "agent_repair", "context_dependent,agent_repair"),
    ("That answer missed my question, please try it again", "agent_repair", "context_dependent,agent_repair"),
    ("Yes, use the first option you listed", "clarification_answer", "context_dependent,clarification_answer"),
    ("The second one, please", "clarification_answer", "context_dependent,clarification_answer"),
    ("Can yu show that agian", "typo_contextual_followup", "context_dependent"),
    ("wht happened with it", "typo_contextual_followup", "context_dependent"),
]
OUTSIDE_ANSWER = "That topic is outside this synthetic retail-bank demo."


def realizations(records: DataFrame, split: str, contexts: list[str], requests: list[str]) -> DataFrame:
    """Each record (record_id, text, calls of ids, requires_tool, family) once for every context and request; ids follow the new record's."""
    pairs = [(i, c, r) for i, (c, r) in enumerate((c, r) for c in contexts for r in requests)]
    if len(pairs) != REALIZATIONS[split]:
        raise ValueError(f"realization configuration mismatch for {split}")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.lit(c).alias("context"), F.lit(r).alias("request")) for i, c, r in pairs]))
    rows = records.withColumn("_r", each).withColumn("_new", F.concat(F.col("record_id"), F.lit("-r"), F.lpad(F.col("_r.n").cast("string"), 3, "0")))
    rows = rows.withColumn("_calls", F.transform("calls", lambda c: F.replace(c, F.col("record_id"), F.col("_new"))))
    digest = lambda c: F.concat(F.lit("sha256:"), F.sha2(c, 256))
    return rows.select(
        F.col("_new").alias("record_id"), F.concat(strip(F.col("text")), F.lit(" "), "_r.context", F.lit(". "), "_r.request", F.lit(".")).alias("text"), F.col("_calls").alias("calls"), F.col("record_id").alias("template_id"),
        F.concat(F.lit(f"servicing-alignment-{split}-"), F.lpad(F.col("_r.n").cast("string"), 3, "0")).alias("realization_seed"), F.when(F.col("requires_tool"), digest(F.col("_new"))).alias("final_state_hash"),
        digest(F.concat("_new", F.lit("|replay"))).alias("replay_hash"), F.concat_ws("|", "family", "_new").alias("split_group"),
    )


def _in_order(anchors: DataFrame, seed: str, split: str) -> DataFrame:
    """Anchors with their place (from 0) in seeded order of their texts."""
    rows = ranked(anchors.withColumn("_all", F.lit(0)), stable_rank(seed, F.lit(split), F.col("text")), ["_all"], "text")
    return rows.withColumn("anchor_index", (F.col("rank_no") - 1).cast("long")).drop("_all", "rank_no")


def follow_ups(anchors: DataFrame, seed: str, split: str) -> DataFrame:
    """Every anchor (text, current_text, history, capability, group_id) before each of FOLLOW_UPS."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.lit(t).alias("text"), F.lit(k).alias("kind"), F.lit(r).alias("relations")) for i, (t, k, r) in enumerate(FOLLOW_UPS)]))
    rows = _in_order(anchors, seed, split).withColumn("_p", each)
    group = F.concat_ws("|", "group_id", F.lit("router-v4"), "_p.kind", F.concat_ws("-", F.col("anchor_index").cast("string"), F.col("_p.n").cast("string")))
    return rows.select(split_wording(F.col("_p.text"), F.lit(split)).alias("current_text"), history_of(F.col("history"), F.col("current_text"), F.col("capability")).alias("history"), "capability", F.col("_p.kind").alias("example_kind"), F.col("_p.relations").alias("relations"), group.alias("group_id"))


def topic_shifts(external: DataFrame, anchors: DataFrame, seed: str, split: str, at: str) -> DataFrame:
    """The i-th outside row (in order of ``at``, from 0) with the i-th ranked anchor, as far as both go: two rows each."""
    outside = ranked(external.withColumn("_all", F.lit(0)), F.lpad(F.hex(at), 16, "0"), ["_all"], at).select((F.col("rank_no") - 1).cast("long").alias("anchor_index"), F.col("current_text").alias("outside"))
    both = _in_order(anchors, seed, split).join(outside, "anchor_index")
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    away = F.struct(F.col("outside").alias("current_text"), history_of(F.col("history"), F.col("current_text"), F.col("capability")).alias("history"), F.lit(0).alias("domain_label"), F.lit(None).cast("string").alias("capability"), F.lit("external_topic_shift").alias("example_kind"), F.lit("topic-shift").alias("tag"))
    back = F.struct(F.col("current_text").alias("current_text"), F.array(said("user", F.col("outside")), said("assistant", F.lit(OUTSIDE_ANSWER))).alias("history"), F.lit(1).alias("domain_label"), F.col("capability").alias("capability"), F.lit("banking_topic_shift").alias("example_kind"), F.lit("banking-topic-shift").alias("tag"))
    rows = both.select("group_id", "anchor_index", F.explode(F.array(away, back)).alias("r"))
    return rows.select("r.current_text", "r.history", "r.domain_label", "r.capability", "r.example_kind", F.concat_ws("|", "group_id", F.lit("router-v4"), "r.tag", F.col("anchor_index").cast("string")).alias("group_id"))


def targeted(prompts: DataFrame, key: str, modifiers: list[str], histories: list[str]) -> DataFrame:
    """Every prompt with every modifier after every history: id of their places, current_text, history."""
    rows = prompts.select(key, "prompt", F.posexplode(F.array(*[F.lit(m) for m in modifiers])).alias("m", "modifier")).select("*", F.posexplode(F.array(*[F.lit(h) for h in histories])).alias("h", "history"))
    return rows.select(F.concat_ws("-", key, "m", "h").alias("id"), strip(F.concat_ws(" ", "prompt", "modifier")).alias("current_text"), "history")


def in_order(sources: list[DataFrame], ordinal: str) -> DataFrame:
    """All rows of several sources, with the source's place and the row's own ordinal: ordering by both is their order of old."""
    return reduce(lambda a, b: a.unionByName(b), [s.withColumn("source_rank", F.lit(i)).withColumn("ordinal", F.col(ordinal)) for i, s in enumerate(sources)])


def repeated_keys(df: DataFrame, by: list[str]) -> DataFrame:
    """Keys found more than once: an assertion holds where there are none."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def with_predictions(records: DataFrame, predictions: DataFrame, key: str, value: str) -> DataFrame:
    """Records with their prediction; one without fails the query, named."""
    both = records.join(predictions.select(key, value), key, "left")
    return both.withColumn(value, F.when(F.col(value).isNull(), F.raise_error(F.concat(F.lit("no prediction of "), F.col(key).cast("string")))).otherwise(F.col(value)))


def expected_calls(current: Column, legacy: Column) -> Column:
    """A record's expected calls, or those under the older key, or none."""
    return F.coalesce(current, legacy, F.array().cast("array<struct<name:string,arguments:string>>"))


def rebound(result: Column, call: Column) -> Column:
    """A recorded tool result under the id and name of the call that was emitted."""
    return F.struct(F.lit("tool").alias("role"), call["id"].alias("tool_call_id"), F.coalesce(call["name"], result["name"]).alias("name"), result["content"].alias("content"), F.lit(False).alias("loss"))


def first_passing(attempts: DataFrame, by: list[str], order: str, failure: str) -> DataFrame:
    """Of each group the first attempt without a failure (none where every one failed), and all attempts with what failed as one text.

    A group's candidates are few: they are a retry list, kept in one row.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, "candidate", failure))), lambda a: F.concat_ws(": ", a["candidate"], F.coalesce(a[failure], F.lit("passed"))))
    passed = lambda c: F.when(F.col(failure).isNull(), F.col(c))
    return attempts.groupBy(*by).agg(F.min_by(passed("candidate"), passed(order)).alias("candidate"), F.array_join(listed, "; ").alias("attempts"))

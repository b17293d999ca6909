"""Conversation shape: current turn, visible history, complete exchanges, rendered classifier input.

Rows are (conv_id, turn, role, text). Every operator partitions by conv_id once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, words

# Words that point back, correct or confirm.
POINTING = ["it", "that", "this", "those", "them", "one", "again", "there"]
CORRECTING = ["no", "not", "wrong", "instead", "asked"]
CONFIRMING = ["yes", "yeah", "yep", "4821", "that", "one"]
CONTEXTUAL = ["again", "else", "it", "next", "that", "them", "then", "there", "these", "they", "this", "those"]


def visible(messages: DataFrame) -> DataFrame:
    """Non-blank user and assistant turns, stripped."""
    text = strip(F.col("text"))
    return messages.where(F.col("role").isin("user", "assistant") & (text != "")).select("conv_id", "turn", "role", text.alias("text"))


def _with_current(messages: DataFrame) -> DataFrame:
    whole = Window.partitionBy("conv_id")
    return visible(messages).withColumn("current_turn", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(whole))


def complete_exchanges(messages: DataFrame, before_current: bool = False) -> DataFrame:
    """User texts answered by the next visible turn. A later user turn replaces one that waits for an answer."""
    rows = _with_current(messages) if before_current else visible(messages)
    if before_current:
        rows = rows.where("turn < current_turn")
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumn("before", F.lag(F.struct("role", "text")).over(order))
    pairs = rows.where("role = 'assistant' AND before.role = 'user'").select("conv_id", "turn", F.col("before.text").alias("user_text"), F.col("text").alias("assistant_text"))
    return pairs.withColumn("exchange_no", F.row_number().over(order)).drop("turn")


def current_turns(messages: DataFrame) -> DataFrame:
    return visible(messages).where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("current"), F.max("turn").alias("current_turn"))


def router_input(messages: DataFrame, max_exchanges: int = 3) -> DataFrame:
    """The current user text, then the last exchanges, newest first, the answer before its question."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = _with_current(messages).withColumn("before", F.lag(F.struct("role", "text")).over(order))
    is_pair = (F.col("role") == "assistant") & (F.col("before.role") == "user") & (F.col("turn") < F.col("current_turn"))
    part = F.when(is_pair, F.struct((-F.col("turn")).alias("at"), F.concat(F.lit("[PREVIOUS_ASSISTANT]\n"), "text", F.lit("\n[PREVIOUS_USER]\n"), "before.text").alias("said")))
    grouped = rows.where("current_turn IS NOT NULL").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == F.col("current_turn"), F.col("text"))).alias("current"), F.array_sort(F.collect_list(part)).alias("parts"))
    said = F.transform(F.slice("parts", 1, max(1, max_exchanges)), lambda p: p["said"]) if max_exchanges else F.array().cast("array<string>")
    return grouped.select("conv_id", F.array_join(F.concat(F.array(F.concat(F.lit("[CURRENT_USER]\n"), "current")), said), "\n").alias("router_input"), (F.size(said) > 0).alias("context_applied"))


def previous_user_input(messages: DataFrame) -> DataFrame:
    """The last user text with the one before it, if there is one."""
    users = messages.where("role = 'user'").select("conv_id", "turn", strip(F.col("text")).alias("text"))
    last = users.groupBy("conv_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("turn", "text")), False), 1, 2).alias("two"))
    now, before = F.get("two", F.lit(0))["text"], F.get("two", F.lit(1))["text"]
    return last.select("conv_id", F.concat(F.lit("[CURRENT]\n"), now, F.when(before != "", F.concat(F.lit("\n[PREVIOUS_USER]\n"), before)).otherwise("")).alias("router_input"))


def relations(current: str = "current", has_history: str = "has_history") -> list:
    """context_dependent, agent_repair, clarification_answer, points_back; limits count distinct words."""
    w = F.array_distinct(words(F.col(current)))
    hits = lambda found: F.arrays_overlap(w, F.array(*[F.lit(x) for x in found]))
    few, history = F.size(w) <= 6, F.col(has_history)
    return [
        (history & (few | hits(POINTING))).alias("context_dependent"),
        hits(CORRECTING).alias("agent_repair"),
        (history & hits(CONFIRMING) & few).alias("clarification_answer"),
        hits(CONTEXTUAL).alias("points_back"),
    ]


def capability(text):
    """The first rule that fits, in this order."""
    t = F.lower(text)
    has = lambda *found: F.coalesce(*[F.when(t.contains(x), True) for x in found], F.lit(False))
    return (
        F.when(has("account", "balance"), "accounts")
        .when(has("freeze_card", "replace_card", "stolen"), "card_actions")
        .when(has("card"), "cards")
        .when(has("transaction", "dispute", "purchase"), "transactions")
        .when(has("transfer"), "transfers")
        .when(has("case", "address"), "service_cases")
        .when(has("faq", "mortgage", "open "), "faq")
        .otherwise("conversation")
    )


def judged_turns(messages: DataFrame) -> DataFrame:
    """Each conversation's current turn with its relations, capability and kind."""
    rows = _with_current(messages)
    now = rows.groupBy("conv_id").agg(F.max(F.when((F.col("turn") == F.col("current_turn")) & (F.col("role") == "user"), F.col("text"))).alias("current"), F.coalesce(F.max((F.col("turn") < F.col("current_turn"))), F.lit(False)).alias("has_history")).where("current IS NOT NULL")
    full = now.select("conv_id", "current", "has_history", *relations(), capability(F.col("current")).alias("capability"))
    kind = F.when(F.col("agent_repair"), "agent_repair").when(F.col("clarification_answer"), "clarification_answer").when(F.col("context_dependent"), "contextual_followup").when(F.col("has_history"), "visible_multiturn").otherwise("sft_single_turn")
    return full.drop("current").withColumn("example_kind", kind)


def budget_suffix(messages: DataFrame, budget: int) -> DataFrame:
    """The longest run of newest turns that begins with a user turn and fits the budget with the leading system turns.

    conv_id, first_turn (null if none fits) and the tokens kept. Tokens are words here.
    """
    tokens = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long")
    rows = messages.select("conv_id", "turn", "role", tokens.alias("tokens"))
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = rows.withColumn("run", F.sum(F.when(F.col("role") != "system", F.col("tokens")).otherwise(0)).over(newest))
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumn("system", F.sum(F.when(F.col("role") == "system", F.col("tokens")).otherwise(0)).over(whole))
    fits = (F.col("role") == "user") & (F.col("run") + F.col("system") <= budget)
    return rows.groupBy("conv_id").agg(F.min(F.when(fits, F.col("turn"))).alias("first_turn"), F.max(F.when(fits, F.col("run") + F.col("system"))).alias("tokens_kept"))


def budget_groups(messages: DataFrame, budget: int) -> DataFrame:
    """Turn groups (a user turn and what follows it) kept newest first; one that doesn't fit is left out, older ones still may.

    A conversation whose newest group is over the budget keeps it, marked by ``over``.
    """
    tokens = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long")
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.where("role <> 'system'").select("conv_id", "turn", "role", tokens.alias("tokens"))
    rows = rows.withColumn("grp", F.sum((F.col("role") == "user").cast("long")).over(order))
    groups = rows.groupBy("conv_id", "grp").agg(F.sum("tokens").alias("tokens"))
    listed = groups.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("grp", "tokens")), False).alias("groups"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def step(a, g):
        take = (F.size(a["kept"]) == 0) | (a["used"] + g["tokens"] <= budget)
        return F.struct(F.when(take, a["used"] + g["tokens"]).otherwise(a["used"]).alias("used"), F.when(take, F.concat(a["kept"], F.array(g["grp"]))).otherwise(a["kept"]).alias("kept"))

    done = listed.select("conv_id", F.size("groups").cast("long").alias("n_groups"), F.aggregate("groups", start, step).alias("r"))
    return done.select("conv_id", "n_groups", F.size("r.kept").cast("long").alias("n_kept"), F.col("r.used").alias("tokens_kept"), F.array_min("r.kept").alias("oldest_kept"), (F.col("r.used") > budget).alias("over"))

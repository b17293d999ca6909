"""Teacher prompts and answers, immutable and replay digests, shown history, run limits and settings, collected predictions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_revision, softmax, stable_int, strip
from .evaluation import ascii_json
from .toolcalls import canonical

# The teacher's instruction, its version, and how wordings begin that need no opener.
TEACHER_VERSION = "banking-tool-sft-teacher/v1"
TEACHER_TEXT = (
    "You rewrite synthetic retail-banking training examples.\n"
    "Return one JSON object only. Required keys: record_id, immutable_hash, user_content, final_response.\n"
    "You may rewrite only user_content and final_response. Preserve all banking facts, amounts, card digits, statuses, tool semantics, and action outcomes. Do not ask for or reveal account numbers, customer IDs, passwords, PINs, or private backend IDs. Do not add markdown.\n"
    "Request:\n"
)
OPENERS = ["Please", "Can you", "Could you"]
CHECKED = ["done.", "i checked", "here is"]
CHECKED_PREFIX = "I checked the banking result. "
# Settings of an evaluation that are 1 at least, and what is said otherwise.
AT_LEAST_ONE = ["max_new_tokens_first", "max_new_tokens_final", "max_tool_passes", "max_tool_calls", "limit"]

RECOVERED = "failure string, payload string"


def quoted(c: Column) -> Column:
    """A string as a JSON string; null is null."""
    inner = F.to_json(F.array(c))
    return F.when(c.isNull(), "null").otherwise(inner.substr(F.lit(2), F.length(inner) - 2))


def teacher_prompt(record_id: Column, immutable_hash: Column, user_content: Column, final_response: Column, immutable_fields: Column | None = None) -> Column:
    """The instruction and the request as JSON with sorted keys, ASCII only."""
    names = F.lit("[]") if immutable_fields is None else F.concat(F.lit("["), F.array_join(F.transform(immutable_fields, quoted), ", "), F.lit("]"))
    pairs = [("allowed_edits", F.lit('["user_content", "final_response"]')), ("final_response", quoted(final_response)), ("immutable_fields", names), ("immutable_hash", quoted(immutable_hash)), ("record_id", quoted(record_id)), ("user_content", quoted(user_content))]
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in pairs])
    return F.concat(F.lit(TEACHER_TEXT), ascii_json(F.concat(F.lit("{"), body, F.lit("}"))))


def prompt_version() -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.lit(TEACHER_VERSION), 256))


def begins(text: Column, starts: list[str]) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for s in starts:
        found |= low.startswith(s)
    return found


def rehearsed(record_id: Column, user_content: Column, final_response: Column, seed: int) -> tuple[Column, Column]:
    """What a stand-in for the teacher answers: an opener picked by the record's digest, and a checked answer.

    The pick depends on seed and record alone, so it is the same in any order and on any partition.
    """
    user, final = strip(user_content), strip(final_response)
    nth = stable_int(F.concat(F.lit(f"{seed}:"), record_id)) % len(OPENERS)
    opener = F.element_at(F.array(*map(F.lit, OPENERS)), (nth + 1).cast("int"))
    asked = F.concat(opener, F.lit(" "), F.lower(F.substring(user, 1, 1)), user.substr(F.lit(2), F.length(user)))
    return F.when(begins(user, [o.lower() for o in OPENERS]), user).otherwise(asked), F.when(begins(final, CHECKED), final).otherwise(F.concat(F.lit(CHECKED_PREFIX), final))


_FENCE = re.compile(r"\A```(?:json)?\s*(.*?)\s*(?:```)?\Z", re.DOTALL)
_BRACED = re.compile(r"\{.*\}", re.DOTALL)


def recover(text: str | None) -> tuple[str | None, str | None]:
    """(failure, canonical object) of an answer that may stand in a fence or among other words."""
    inside = (text or "").strip()
    if fenced := _FENCE.match(inside):
        inside = fenced[1]
    braced = _BRACED.search(inside)
    for candidate in (inside, braced[0] if braced else None):
        try:
            value = None if candidate is None else json.loads(candidate)
        except ValueError:
            continue
        if candidate is not None:
            return (None, canonical(value)) if isinstance(value, dict) else ("teacher output JSON must be an object", None)
    return ("teacher output did not contain JSON" if braced is None else "teacher output is not JSON"), None


def recovered(raw: Column) -> Column:
    """failure and payload of a teacher's raw answers."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([recover(t) for t in s], columns=["failure", "payload"], dtype=object)

    return F.pandas_udf(run, RECOVERED)(raw)


def last_index(messages: Column, holds) -> Column:
    """Index from 0 of the last message for which ``holds``, else -1."""
    return F.coalesce(F.array_max(F.filter(F.transform(messages, lambda m, i: F.when(holds(m), i)), lambda i: i.isNotNull())), F.lit(-1))


def immutable_messages(messages: Column) -> Column:
    """All messages but the last user turn and the last assistant turn without calls. Messages have role and tool_calls (JSON or null)."""
    user = last_index(messages, lambda m: m["role"] == "user")
    final = last_index(messages, lambda m: (m["role"] == "assistant") & F.coalesce(m["tool_calls"], F.lit("[]")).isin("[]", "null"))
    return F.filter(messages, lambda m, i: (i != user) & (i != final))


def message_json(m: Column) -> Column:
    """A message (content, role, tool_calls as canonical JSON or null) as canonical JSON."""
    calls = F.when(m["tool_calls"].isNotNull(), F.concat(F.lit(',"tool_calls":'), m["tool_calls"])).otherwise("")
    return F.concat(F.lit('{"content":'), quoted(m["content"]), F.lit(',"role":'), quoted(m["role"]), calls, F.lit("}"))


def listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def immutable_hash(messages: Column, record_id: Column, schema_version: Column, expected: Column, split_keys: Column, manifest_hash: Column, replayed: Column) -> Column:
    """Digest of what a teacher may not change. ``expected`` and ``split_keys`` are canonical JSON or null."""
    parts = [
        ("expected", F.coalesce(expected, F.lit("null"))), ("messages_except_final_assistant", listed(F.transform(immutable_messages(messages), message_json))), ("record_id", quoted(record_id)),
        ("schema_version", quoted(schema_version)), ("split_keys", F.coalesce(split_keys, F.lit("null"))),
        ("validation", F.concat(F.lit('{"replay_hash":'), quoted(replayed), F.lit(',"tool_manifest_hash":'), quoted(manifest_hash), F.lit("}"))),
    ]
    body = F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in parts])
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256))


def call_ids(record_id: Column, n_calls: Column) -> Column:
    """Ids of a record's calls in order."""
    return F.when(n_calls > 0, F.transform(F.sequence(F.lit(0), n_calls - 1), lambda i: F.concat_ws("_", F.lit("call"), record_id, i))).otherwise(F.array().cast("array<string>"))


def envelope(result: Column, error: Column) -> Column:
    """Canonical JSON of what a tool gave: its result (canonical JSON), or the message of its error."""
    failed = F.concat(F.lit('{"error":{"code":"backend_error","message":'), quoted(error), F.lit('},"ok":false}'))
    return F.when(error.isNotNull(), failed).otherwise(F.concat(F.lit('{"ok":true,"result":'), F.coalesce(result, F.lit("null")), F.lit("}")))


def replay_hash(events: Column) -> Column:
    """Digest of replayed events (tool_call_id, name, content as canonical JSON) in order."""
    one = lambda e: F.concat(F.lit('{"content":'), e["content"], F.lit(',"name":'), quoted(e["name"]), F.lit(',"tool_call_id":'), quoted(e["tool_call_id"]), F.lit("}"))
    return F.concat(F.lit("sha256:"), F.sha2(listed(F.transform(events, one)), 256))


def final_state_hash(events: Column, snapshot: Column) -> Column:
    """Digest of the state after the events (canonical JSON); null where nothing was called."""
    return F.when(F.size(events) > 0, F.concat(F.lit("sha256:"), F.sha2(snapshot, 256)))


def visible_history(messages: Column) -> Column:
    """Turns of user and assistant with words in them, by role and content; no list is an empty one."""
    shown = F.filter(messages, lambda m: m["role"].isin("user", "assistant") & (strip(F.coalesce(m["content"], F.lit(""))) != ""))
    plain = F.transform(shown, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return F.coalesce(plain, F.array().cast("array<struct<role:string,content:string>>"))


def selected_stages(stages: DataFrame, selected: str) -> DataFrame:
    """Release stages by name, or all."""
    return stages if selected == "all" else stages.where(F.col("name") == selected)


def limited(records: DataFrame, order: str, limit: int | None) -> DataFrame:
    """The first ``limit`` records in their order; all without a limit."""
    if limit is None:
        return records
    if limit < 1:
        raise ValueError("--limit must be at least 1")
    return records.orderBy(order).limit(limit)


def settings_problem(settings: DataFrame) -> Column:
    """The first problem of evaluation settings: revisions of 40 hex digits, counts of 1 at least, a limit if there is one."""
    said = F.lit(None).cast("string")
    for name in reversed(AT_LEAST_ONE):
        said = F.when(settings[name] < 1, f"--{name.replace('_', '-')} must be at least 1").otherwise(said)
    for name in ("dataset_revision", "model_revision"):
        said = F.when(~F.coalesce(is_revision(settings[name]), F.lit(False)), f"--{name.replace('_', '-')} must be an exact 40-character lowercase Git revision").otherwise(said)
    return said


def resumable(found: Column, expected: Column) -> Column:
    """Whether a checkpoint's inputs are the present ones, nulls included."""
    return found.eqNullSafe(expected)


def collected(df: DataFrame, order: str) -> DataFrame:
    """Model outputs as eight aligned columns, in loader order: logits become probabilities and the first greatest index."""
    best = lambda c: F.array_position(c, F.array_max(c)) - 1
    return df.select(
        order, F.element_at(softmax(F.col("domain_logits")), 2).alias("domain_probability"), F.col("domain_label"), best(F.col("capability_logits")).alias("capability_prediction"), F.col("capability_label"),
        F.transform("relation_logits", lambda x: 1 / (1 + F.exp(-x))).alias("relation_probabilities"), F.col("relation_labels"), F.col("example_kind"), F.col("current_text"),
    )

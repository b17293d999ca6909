"""Records checked: answers by path, message lists by their rules, corpora by gates; and the parts of message lists that prompts use."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_ascii, strip
from .toolcalls import PUBLIC_ARGUMENTS

CALL = "struct<id:string,index:int,name:string,arguments:map<string,string>>"
MESSAGE = f"struct<role:string,content:string,loss:boolean,tool_calls:array<{CALL}>,tool_call_id:string,name:string,ok:boolean,keys:array<string>>"
MESSAGES = f"array<{MESSAGE}>"  # of a tool's message ``ok`` and ``keys`` are its envelope's

# What an answer must hold by path, and by template for FAQs.
PATH_MARKERS = {"clarification": ["last four digits"], "ood": ["retail banking"], "hard_negative": ["account numbers", "customer ids"]}
FAQ_MARKERS = {
    "faq-overdraft-v1": ["overdraft"],
    "faq-mortgage-opening-v1": ["mortgage", "cannot open"],
    "faq-mortgage-age-v1": ["mortgage", "18", "cannot determine"],
    "faq-deposit-opening-v1": ["account", "cannot open"],
    "faq-savings-interest-v1": ["interest"],
}
REQUIRED_PATHS = ["tool_success", "tool_error", "clarification", "no_tool_banking_faq", "ood", "hard_negative", "multi_turn"]


def answer_violations(answer: Column, path: Column, template: Column) -> Column:
    """What is wrong with a final answer, as a list."""
    said = norm_ascii(F.coalesce(answer, F.lit("")))
    wanted = F.array().cast("array<string>")
    for rules, key in ((PATH_MARKERS, path), (FAQ_MARKERS, F.when(path == "no_tool_banking_faq", template))):
        for k, markers in rules.items():
            wanted = F.when(key == k, F.array(*[F.lit(m) for m in markers])).otherwise(wanted)
    short = F.size(F.filter(F.split(said, " "), lambda w: w != "")) < 7
    return F.array_compact(F.array(F.when(short, "final assistant response is missing semantic content"), F.when(F.exists(wanted, lambda m: ~said.contains(norm_ascii(m))), "final assistant response is missing path markers")))


def corpus_gates(records: DataFrame, calls: DataFrame, splits: list[str]) -> DataFrame:
    """gate, n and passed for a corpus: what each gate counts, and whether that is as it must be.

    ``records`` has record_id, split, path and accepted; ``calls`` has a row for each call of each message, with its name and
    whether its result is ok (null: no result). Both are aggregates of fixed size, but for ids, which are counted by key.
    """
    has = lambda c, values, kind: [F.coalesce(F.bool_or(F.col(c) == v), F.lit(False)).cast("long").alias(f"{kind}{i}") for i, v in enumerate(values)]
    held = lambda values, kind: sum((F.col(f"{kind}{i}") for i in range(len(values))), F.lit(0).cast("long"))
    tools = list(PUBLIC_ARGUMENTS)
    called = calls.agg(*has("name", tools, "tool"), F.count_if(~F.col("name").isin(tools)).alias("unknown"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("error"))
    one = records.agg(*has("path", REQUIRED_PATHS, "path"), *has("split", splits, "split"), F.count(F.lit(1)).alias("total"), F.count_if("accepted").alias("accepted"))
    ids = records.groupBy("record_id").agg(F.lit(1).alias("one")).agg(F.count("record_id").alias("ids"))
    gates = {
        "all_accepted": (F.col("accepted"), F.col("accepted") == F.col("total")),
        "all_tools_covered": (held(tools, "tool"), (held(tools, "tool") == len(tools)) & (F.col("unknown") == 0)),
        "ok_present": (F.col("ok"), F.col("ok") > 0),
        "error_present": (F.col("error"), F.col("error") > 0),
        "required_paths": (held(REQUIRED_PATHS, "path"), held(REQUIRED_PATHS, "path") == len(REQUIRED_PATHS)),
        "no_empty_split": (held(splits, "split"), held(splits, "split") == len(splits)),
        "unique_records": (F.col("ids"), F.col("ids") == F.col("total")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("gate"), n.alias("n"), passed.alias("passed")) for k, (n, passed) in gates.items()])
    return one.join(F.broadcast(called)).join(F.broadcast(ids)).select(F.inline(rows))  # one row each


def is_call(m: Column) -> Column:
    return (m["role"] == "assistant") & (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0)


def message_violation(record_id: Column, messages: Column) -> Column:
    """The first rule that a message list breaks, as text; null if none.

    A call stands alone in its message, is answered by the very next message, and is numbered by its kind (target
    or context). Each message is judged by itself and the one before it; calls before it are counted by kind.
    """
    at = lambda i: F.get(messages, i)
    one = lambda m: F.get(m["tool_calls"], F.lit(0))
    known = F.create_map(*[x for k, v in PUBLIC_ARGUMENTS.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]).cast("array<string>"))])
    wrong = F.lit("tool result correlation mismatch")

    def judged(m: Column, i: Column) -> Column:
        before = at(i - 1)
        waiting = F.coalesce(is_call(before), F.lit(False))
        call, loss = one(m), F.coalesce(m["loss"], F.lit(False))
        earlier = F.filter(F.slice(messages, 1, i), is_call)
        same_kind = F.size(F.filter(earlier, lambda x: F.coalesce(x["loss"], F.lit(False)) == loss))
        expected = F.concat_ws("_", F.when(loss, "call").otherwise("context"), record_id, same_kind.cast("string"))
        arguments = F.coalesce(F.map_keys(call["arguments"]), F.array().cast("array<string>"))
        allowed = F.coalesce(F.try_element_at(known, call["name"]), F.array().cast("array<string>"))
        as_call = (
            F.when(waiting, wrong)
            .when(F.size(m["tool_calls"]) != 1, "tool-call assistant must contain exactly one call")
            .when(m["content"].isNotNull(), "tool-call assistant has content")
            .when(m["loss"].isNull(), "assistant call has invalid loss label")
            .when(F.coalesce(call["id"] == "", F.lit(True)), "missing call id")
            .when(F.exists(earlier, lambda x: one(x)["id"] == call["id"]), "duplicate tool call id")
            .when(~F.coalesce(call["index"] == 0, F.lit(False)), "tool call index must restart at zero per assistant message")
            .when(call["id"] != expected, F.when(loss, "unstable tool call id").otherwise("unstable context tool call id"))
            .when(~F.coalesce(F.map_contains_key(known, F.coalesce(call["name"], F.lit(""))), F.lit(False)), "unknown tool")
            .when(call["arguments"].isNull(), "tool arguments must be object")
            .when(F.size(F.array_except(arguments, allowed)) > 0, "unsupported arguments")
        )
        keys = F.array_sort(m["keys"])
        as_result = (
            F.when(~F.coalesce(~m["loss"], F.lit(False)), "tool result is labeled")
            .when(m["keys"].isNull(), "tool content must be object")
            .when(m["ok"] & (keys != F.array(F.lit("ok"), F.lit("result"))), "success envelope is invalid")
            .when(~m["ok"] & (keys != F.array(F.lit("error"), F.lit("ok"))), "error envelope is invalid")
            .when(m["ok"].isNull(), "tool envelope missing ok")
            .when(~F.coalesce(waiting & (one(before)["id"] == m["tool_call_id"]), F.lit(False)), wrong)
        )
        as_answer = F.when(waiting, wrong).when(m["loss"].isNull(), "assistant message has invalid loss label")
        as_context = F.when(waiting, wrong).when(~F.coalesce(~m["loss"], F.lit(False)), "context message is labeled")
        role = m["role"]
        return F.when(is_call(m), as_call).when(role == "tool", as_result).when(role == "assistant", as_answer).when(role.isin("system", "user"), as_context).otherwise("invalid role")

    first = F.get(F.filter(F.transform(messages, judged), lambda v: v.isNotNull()), F.lit(0))
    unanswered = F.when(is_call(F.get(messages, F.size(messages) - 1)), wrong)
    return F.coalesce(first, unanswered)


def agreement_violations(messages: Column, ordered: Column, expected: Column, requires_tool: Column) -> Column:
    """Whether target calls, their results and what the record expects agree; ``expected`` are names, ``ordered`` ids."""
    targets = F.filter(messages, lambda m: is_call(m) & F.coalesce(m["loss"], F.lit(False)))
    ids = F.transform(targets, lambda m: F.get(m["tool_calls"], F.lit(0))["id"])
    names = F.transform(targets, lambda m: F.get(m["tool_calls"], F.lit(0))["name"])
    results = F.transform(target_results(messages), lambda m: m["tool_call_id"])
    return F.array_compact(F.array(F.when(ids != ordered, "ordered_calls mismatch"), F.when(names != expected, "expected tool_calls mismatch"), F.when(results != ids, "tool result correlation mismatch"), F.when((F.size(ids) > 0) != requires_tool, "requires_tool mismatch")))


def last_of(messages: Column, wanted) -> Column:
    """The last message that fits; null if none."""
    return F.try_element_at(F.filter(messages, wanted), F.lit(-1))


def _position(messages: Column, wanted) -> Column:
    """0-based place of the first message that fits; null if none."""
    return F.nullif(F.array_position(F.transform(messages, wanted), True), F.lit(0)) - 1


def is_target(m: Column) -> Column:
    return is_call(m) & F.coalesce(m["loss"], F.lit(True))


def is_final(m: Column) -> Column:
    return (m["role"] == "assistant") & ~is_call(m)


def final_position(messages: Column) -> Column:
    """0-based place of the last assistant message without calls; null if none."""
    return F.size(messages) - 1 - _position(F.reverse(messages), is_final)


def first_prefix(messages: Column) -> Column:
    """What comes before the first target call, or before the final answer where there is none."""
    return F.slice(messages, 1, F.coalesce(_position(messages, is_target), final_position(messages)).cast("int"))


def grounded_prefix(messages: Column) -> Column:
    """What comes before the final answer."""
    return F.slice(messages, 1, final_position(messages).cast("int"))


def target_results(messages: Column) -> Column:
    """Tool messages that answer target calls."""
    ids = F.flatten(F.transform(F.filter(messages, is_target), lambda m: F.transform(m["tool_calls"], lambda c: c["id"])))
    return F.filter(messages, lambda m: (m["role"] == "tool") & F.array_contains(ids, m["tool_call_id"]))


def message_lists(turns: DataFrame) -> DataFrame:
    """A list of role and content for each conversation, in order of turns. A conversation is one row, as a prompt is one text: its turns must fit one task."""
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def last_user_text(messages: Column) -> Column:
    """The last user text that isn't blank, stripped."""
    return strip(last_of(messages, lambda m: (m["role"] == "user") & (strip(m["content"]) != ""))["content"])


def visible_before_current(messages: Column) -> Column:
    """User and assistant texts, stripped and not blank, before the last user message, whether that is blank or not."""
    cut = F.size(messages) - 1 - _position(F.reverse(messages), lambda m: (m["role"] == "user") & m["content"].isNotNull())
    before = F.slice(messages, 1, F.coalesce(cut, F.size(messages)).cast("int"))
    return F.transform(F.filter(before, lambda m: m["role"].isin("user", "assistant") & (strip(m["content"]) != "")), lambda m: F.struct(m["role"].alias("role"), strip(m["content"]).alias("content")))


def canonical_conversation(messages: Column) -> Column:
    """What of a stored conversation goes on: user texts stripped and not blank; answers likewise, or as they are where they call
    tools; tools' results with a name and a text, and their call's id stripped, if there is one. All else is dropped."""
    user = lambda m: (m["role"] == "user") & (strip(m["content"]) != "")
    calls = lambda m: (m["role"] == "assistant") & m["content"].isNotNull() & (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0)
    answer = lambda m: (m["role"] == "assistant") & (strip(m["content"]) != "") & ~calls(m)
    tool = lambda m: (m["role"] == "tool") & m["name"].isNotNull() & m["content"].isNotNull()
    good = F.filter(messages, lambda m: F.coalesce(user(m) | calls(m) | answer(m) | tool(m), F.lit(False)))
    blank = lambda c: F.when(strip(c) != "", strip(c))
    return F.transform(good, lambda m: F.struct(m["role"].alias("role"), F.when(calls(m) | tool(m), m["content"]).otherwise(strip(m["content"])).alias("content"), F.when(calls(m), m["tool_calls"]).alias("tool_calls"), F.when(tool(m), blank(m["tool_call_id"])).alias("tool_call_id"), F.when(tool(m), m["name"]).alias("name")))


def _fixture(*messages: dict) -> str:
    return json.dumps(list(messages))


def _user(text: str = "Freeze it", loss: bool | None = False) -> dict:
    return {"role": "user", "content": text, "loss": loss}


def _calls(*calls: tuple, content=None, loss: bool | None = True) -> dict:
    return {"role": "assistant", "content": content, "loss": loss, "tool_calls": [{"id": i, "index": n, "name": name, "arguments": a} for i, n, name, a in calls]}


def _result(of: str, ok: bool | None = True, keys=("ok", "result"), loss: bool | None = False) -> dict:
    return {"role": "tool", "tool_call_id": of, "name": "x", "loss": loss, "ok": ok, "keys": None if keys is None else list(keys)}


def _answer(loss: bool | None = True) -> dict:
    return {"role": "assistant", "content": "It is done.", "loss": loss}


_FREEZE = ("call_r1_0", 0, "freeze_card", {"last4": "4821"})
# Message lists of a record r1, and what is wrong with each.
FIXTURES: list[tuple[str, str]] = [
    (_fixture({"role": "system", "content": "s", "loss": False}, _user(), _calls(_FREEZE), _result("call_r1_0"), _answer()), ""),
    (_fixture(_user(), _calls(("context_r1_0", 0, "list_cards", {}), loss=False), _result("context_r1_0"), _answer(False), _user(), _calls(_FREEZE), _result("call_r1_0", False, ("ok", "error")), _answer()), ""),
    (_fixture(_user(), _calls(_FREEZE, _FREEZE), _answer()), "tool-call assistant must contain exactly one call"),
    (_fixture(_user(), _calls(_FREEZE, content="x"), _answer()), "tool-call assistant has content"),
    (_fixture(_user(), _calls(_FREEZE, loss=None), _answer()), "assistant call has invalid loss label"),
    (_fixture(_user(), _calls(_FREEZE), _result("call_r1_0"), _calls(_FREEZE), _result("call_r1_0"), _answer()), "duplicate tool call id"),
    (_fixture(_user(), _calls(("call_r1_0", 1, "freeze_card", {})), _result("call_r1_0"), _answer()), "tool call index must restart at zero per assistant message"),
    (_fixture(_user(), _calls(("call_r1_1", 0, "freeze_card", {})), _result("call_r1_1"), _answer()), "unstable tool call id"),
    (_fixture(_user(), _calls(("call_r1_0", 0, "freeze_card", {}), loss=False), _result("call_r1_0"), _answer()), "unstable context tool call id"),
    (_fixture(_user(), _calls(("call_r1_0", 0, "get_account_balance", {})), _result("call_r1_0"), _answer()), "unknown tool"),
    (_fixture(_user(), _calls(("call_r1_0", 0, "freeze_card", None)), _result("call_r1_0"), _answer()), "tool arguments must be object"),
    (_fixture(_user(), _calls(("call_r1_0", 0, "freeze_card", {"pin": "1"})), _result("call_r1_0"), _answer()), "unsupported arguments"),
    (_fixture(_user(), _calls(_FREEZE), _answer()), "tool result correlation mismatch"),
    (_fixture(_user(), _calls(_FREEZE), _result("call_r1_9"), _answer()), "tool result correlation mismatch"),
    (_fixture(_user(), _result("call_r1_0"), _answer()), "tool result correlation mismatch"),
    (_fixture(_user(), _calls(_FREEZE)), "tool result correlation mismatch"),
    (_fixture(_user(), _calls(_FREEZE), _result("call_r1_0", loss=True), _answer()), "tool result is labeled"),
    (_fixture(_user(), _calls(_FREEZE), _result("call_r1_0", keys=None), _answer()), "tool content must be object"),
    (_fixture(_user(), _calls(_FREEZE), _result("call_r1_0", keys=("ok", "error")), _answer()), "success envelope is invalid"),
    (_fixture(_user(), _calls(_FREEZE), _result("call_r1_0", ok=False), _answer()), "error envelope is invalid"),
    (_fixture(_user(), _calls(_FREEZE), _result("call_r1_0", ok=None), _answer()), "tool envelope missing ok"),
    (_fixture(_user(), _answer(None)), "assistant message has invalid loss label"),
    (_fixture(_user(loss=True), _answer()), "context message is labeled"),
    (_fixture({"role": "critic", "content": "x", "loss": False}), "invalid role"),
]
# Message lists with the lengths of both prefixes, the ids of target results, and the last user text.
PREFIX_FIXTURES: list[tuple[str, int, int, str, str]] = [
    (_fixture({"role": "system", "content": "s"}, _user("a"), _calls(_FREEZE), _result("call_r1_0"), _answer()), 2, 4, "call_r1_0", "a"),
    (_fixture(_user("a"), _calls(("context_r1_0", 0, "list_cards", {}), loss=False), _result("context_r1_0"), _answer(False), _user("b"), _calls(_FREEZE), _result("call_r1_0"), _answer()), 5, 7, "call_r1_0", "b"),
    (_fixture(_user("a"), _answer(), _user("  "), _answer()), 3, 3, "", "  "),
    (_fixture(_answer()), 0, 0, "", ""),
]

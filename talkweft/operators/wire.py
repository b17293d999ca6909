"""Assistant outputs on the wire: strict and serving parses, argument schemas, correlation, trajectories, label masks.

JSON must be read as strictly as Python does, which no built-in function does, so parses are Arrow-batched UDFs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import TOOL_BLOCK
from .toolcalls import canonical, loaded

# Public tools, what they say of themselves, and their arguments.
TOOLS: dict[str, tuple[str, dict]] = {
    "list_accounts": ("List the signed-in synthetic customer's accounts and balances.", {}),
    "list_cards": ("List the signed-in synthetic customer's cards and statuses.", {}),
    "list_service_cases": ("List recent synthetic service cases.", {}),
    "list_transactions": ("List recent synthetic account transactions.", {"limit": {"type": "integer", "minimum": 1, "maximum": 20}}),
    "list_transfers": ("List the signed-in synthetic customer's transfers and statuses.", {}),
    "freeze_card": ("Freeze a synthetic card, optionally selected by last four digits.", {"last4": {"type": ["string", "null"]}}),
    "replace_card": ("Request replacement of a synthetic card.", {"last4": {"type": ["string", "null"]}}),
    "dispute_transaction": ("Dispute a synthetic transaction by description.", {"description": {"type": ["string", "null"]}}),
    "cancel_transfer": ("Cancel a synthetic pending transfer by recipient.", {"recipient": {"type": ["string", "null"]}}),
}
MOST_CALLS = 8
KINDS = {type(None): "null", bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}


def manifest() -> list[dict]:
    """The tools as a model is told of them."""
    return [{"type": "function", "function": {"name": n, "description": d, "parameters": {"type": "object", "properties": p, "additionalProperties": False}}} for n, (d, p) in TOOLS.items()]


def manifest_hash() -> str:
    return "sha256:" + hashlib.sha256(json.dumps(manifest(), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


class Refused(ValueError):
    """An output that isn't what the wire allows."""


def need(holds: bool, message: str) -> None:
    if not holds:
        raise Refused(message)


def value_problem(value: object, schema: object) -> tuple[str, str] | None:
    """How a value breaks its schema: which rule (type, minimum, maximum, enum), and what a type should be; null if it doesn't.

    A schema that is no object asks nothing; an integer is a number too, a boolean neither.
    """
    if not isinstance(schema, dict):
        return None
    kinds = schema.get("type")
    kinds = {kinds} if isinstance(kinds, str) else {str(k) for k in kinds} if isinstance(kinds, (list, tuple)) else set()
    own = KINDS[type(value)]
    if kinds and own not in kinds and not (own == "integer" and "number" in kinds):
        return "type", f"expected {sorted(kinds)}, got {own}"
    if own in ("integer", "number"):
        for rule, broken in (("minimum", lambda m: value < m), ("maximum", lambda m: value > m)):
            if schema.get(rule) is not None and broken(schema[rule]):
                return rule, ""
    return ("enum", "") if schema.get("enum") is not None and value not in schema["enum"] else None


# What the strict parse says of a value.
VALUE_MESSAGES = {
    "type": "invalid type for {place}: {detail}",
    "minimum": "value below minimum for {place}",
    "maximum": "value above maximum for {place}",
    "enum": "value not in enum for {place}",
}


def schema_problem(tool: str, schema: dict) -> str | None:
    """What keeps a schema from being that of an object with named properties; null if nothing does."""
    if schema.get("type", "object") != "object":
        return f"tool schema for {tool} must be an object"
    if not isinstance(schema.get("properties", {}), dict):
        return f"tool schema for {tool} has invalid properties"
    if not isinstance(schema.get("required", []), (list, tuple)):
        return f"tool schema for {tool} has invalid required list"
    return None


def arguments_problem(tool: str, arguments: dict, schema: dict) -> str | None:
    """First way in which arguments break an object schema: the schema itself, required, unknown, then values in their order."""
    wrong = schema_problem(tool, schema)
    if wrong:
        return wrong
    known = schema.get("properties", {})
    missing = [n for n in schema.get("required", ()) if n not in arguments]
    if missing:
        return f"missing required arguments for {tool}: {missing}"
    unknown = sorted({str(k) for k in arguments} - {str(k) for k in known})
    if unknown and schema.get("additionalProperties", True) is False:
        return f"unsupported arguments for {tool}: {unknown}"
    for name, value in arguments.items():
        found = value_problem(value, known.get(name))
        if found:
            return VALUE_MESSAGES[found[0]].format(place=f"{tool}.{name}", detail=found[1])
    return None


SCHEMAS = {n: {"properties": p, "additionalProperties": False} for n, (_, p) in TOOLS.items()}


def checked_calls(calls: list[tuple]) -> list[tuple]:
    """Calls (id, index, name, arguments) whose ids differ, whose indexes count from 0, and whose arguments fit their tool."""
    for place, (call_id, index, name, arguments) in enumerate(calls):
        need(call_id not in [c[0] for c in calls[:place]], f"duplicate tool call id: {call_id}")
        need(index == place, "tool call indexes must be ordered from zero")
        need(name in TOOLS, f"unknown tool name: {name}")
        need(isinstance(arguments, dict), f"tool arguments for {name} must be a JSON object")
        problem = arguments_problem(name, arguments, SCHEMAS[name])
        need(problem is None, problem or "")
    return calls


def _own_id(payload: dict, otherwise: Callable[[], str]) -> str:
    given = payload.get("id")
    return given if isinstance(given, str) and given.strip() else otherwise()


def _wire_call(payload: object, place: int, raw: str, said: str) -> tuple:
    need(isinstance(payload, dict), said)
    name, arguments = payload.get("name"), payload.get("arguments")
    need(isinstance(name, str) and bool(name.strip()), "tool call requires a function name")
    need(isinstance(arguments, dict), "tool call arguments must be a JSON object")
    made = lambda: f"call_generated_{place}_{hashlib.sha256(f'{raw}\n{place}\n{name}'.encode()).hexdigest()[:16]}"
    return _own_id(payload, made), int(payload.get("index", place)), name, arguments


def listed_call(call: object) -> tuple:
    """A call as chat formats write it, with its function inside; arguments may be JSON text."""
    function = call.get("function") if isinstance(call, dict) else None
    need(isinstance(function, dict), "tool call missing function object")
    arguments = function.get("arguments", {})
    if isinstance(arguments, str):
        good, arguments = loaded(arguments)
        need(good, "assistant output is not parseable JSON")
    need(isinstance(arguments, dict), "tool call arguments must be a JSON object")
    return str(call["id"]), int(call.get("index", 0)), str(function["name"]), arguments


def read_wire(raw: str) -> tuple[str | None, list[tuple]]:
    """content and calls of an output: tagged blocks alone, or one JSON object, or text."""
    raw = raw.strip()
    need(bool(raw), "assistant output is empty")
    blocks = list(re.finditer(TOOL_BLOCK, raw))
    if blocks:
        need(not (raw[: blocks[0].start()].strip() or raw[blocks[-1].end() :].strip()), "tool-call output must not contain prose outside tool_call blocks")
        read = [loaded(b.group(1)) for b in blocks]
        need(all(good for good, _ in read), "assistant output is not parseable JSON")
        return None, checked_calls([_wire_call(p, i, raw, "tool_call block must contain a JSON object") for i, (_, p) in enumerate(read)])
    need("<tool_call" not in raw and "</tool_call>" not in raw, "assistant output contains malformed tool_call block")
    if not raw.startswith("{"):
        return raw, []
    good, payload = loaded(raw)
    need(good, "assistant output is not parseable JSON")
    if "tool_calls" in payload:
        return payload.get("content"), checked_calls([listed_call(c) for c in payload["tool_calls"]])
    if "name" in payload and "arguments" in payload:
        return None, checked_calls([_wire_call(payload, int(payload.get("index", 0)), raw, "")])
    need("content" in payload, "assistant payload contains neither tool_calls nor content")
    return str(payload["content"]), []


SERVING_WORDS = {"type": "invalid type for", "minimum": "value below minimum for", "maximum": "value above maximum for"}  # fixed values: likewise of the serving parse


def read_serving(raw: str, turn: str | None) -> tuple[str | None, list[tuple]]:
    """Calls of the tagged blocks; text around them is passed over."""
    blocks = re.findall(TOOL_BLOCK, raw)
    need(bool(blocks) or ("<tool_call" not in raw and "</tool_call>" not in raw), "model returned a malformed tool-call block")
    need(len(blocks) <= MOST_CALLS, f"model returned more than {MOST_CALLS} tool calls")
    key, calls = hashlib.sha256(f"{turn or ''}\0{raw}".encode()).hexdigest()[:10], []
    for place, block in enumerate(blocks):
        good, p = loaded(block)
        need(good, "model tool call is not valid JSON")
        need(isinstance(p, dict), "model tool call must be a JSON object")
        name, arguments, index = p.get("name"), p.get("arguments"), p.get("index")
        need(isinstance(name, str) and bool(name.strip()), "model tool call requires a function name")
        need(isinstance(arguments, dict), "model tool-call arguments must be an object")
        need(index is None or type(index) is int, "model tool-call index must be an integer")
        slug = re.sub(r"[^a-zA-Z0-9_]+", "_", name.strip()).strip("_") or "tool"
        made = f"call_{key}_{place}_{slug}"
        calls.append((_own_id(p, lambda made=made: made).strip(), place if index is None else index, name.strip(), arguments))
    ids = [c[0] for c in calls]
    for place, (call_id, index, name, arguments) in enumerate(calls):
        need(index == place, "model tool-call indexes must be ordered from zero")
        need(call_id not in ids[:place], "model tool-call IDs must be unique")
        need(name in TOOLS, f"model selected unsupported tool: {name}")
        need(not set(arguments) - set(TOOLS[name][1]), f"model supplied unsupported arguments for {name}")
        for n, v in arguments.items():
            rule = (value_problem(v, TOOLS[name][1][n]) or ("",))[0]
            need(rule not in SERVING_WORDS, f"model supplied {SERVING_WORDS.get(rule)} {name}.{n}")
    return (None if calls else raw), calls


def rendered_calls(calls: Column) -> Column:
    """The assistant message of calls (id, index, name, arguments): as a message, with no text."""
    made = F.transform(calls, lambda c: F.struct(c["id"].alias("id"), c["index"].alias("index"), F.lit("function").alias("type"), F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function")))
    return F.struct(F.lit("assistant").alias("role"), F.lit("").alias("content"), made.alias("tool_calls"))


def rendered_result(call: Column, content: Column) -> Column:
    """The tool message of a call's result, whose content is JSON text."""
    return F.struct(F.lit("tool").alias("role"), call["id"].alias("tool_call_id"), call["name"].alias("name"), content.alias("content"))


def tagged(calls: Column) -> Column:
    """Calls as a model writes them: a tagged block each, which the parses read back."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.char_length(F.to_json(F.array(c))) - 2)
    return F.array_join(F.transform(calls, lambda c: F.concat(F.lit('<tool_call>{"id": '), quoted(c["id"]), F.lit(', "name": '), quoted(c["name"]), F.lit(', "arguments": '), c["arguments"], F.lit(', "index": '), c["index"].cast("string"), F.lit("}</tool_call>"))), "\n")


READ = "failure string, content string, calls array<struct<id:string,index:int,name:string,arguments:string>>"


def _row(read: Callable[[], tuple]) -> dict:
    try:
        content, calls = read()
    except Refused as e:
        return {"failure": str(e), "content": None, "calls": []}
    return {"failure": None, "content": content, "calls": [{"id": i, "index": n, "name": t, "arguments": canonical(a)} for i, n, t, a in calls]}


def _wire(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for raw in batches:
        yield pd.DataFrame([_row(lambda r=r: read_wire(r or "")) for r in raw], columns=["failure", "content", "calls"])


def _serving(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for raw, turn in batches:
        yield pd.DataFrame([_row(lambda r=r, t=t: read_serving(r or "", t)) for r, t in zip(raw, turn, strict=True)], columns=["failure", "content", "calls"])


def parsed_wire(raw: Column) -> Column:
    return F.pandas_udf(_wire, READ)(raw)


def parsed_serving(raw: Column, turn: Column) -> Column:
    return F.pandas_udf(_serving, READ)(raw, turn)


def trajectory(passes: Column, expected: Column, n_results: Column, most_passes: int, most_calls: int) -> Column:
    """Where a run of parsed passes (READ structs) stops: stop_reason, matched and emitted calls, passes read.

    Each emitted call must be the next expected one (name, canonical arguments) and have a recorded result.
    """
    state = "struct<stop:string,matched:int,emitted:int,passes:int>"
    start = F.struct(F.lit(None).cast("string").alias("stop"), F.lit(0).alias("matched"), F.lit(0).alias("emitted"), F.lit(0).alias("passes")).cast(state)

    def call(s: Column, c: Column) -> Column:
        want = F.get(expected, s["matched"])
        stop = (
            F.when(s["emitted"] + 1 > most_calls, "max_tool_calls")
            .when(F.coalesce((want["name"] != c["name"]) | (want["arguments"] != c["arguments"]), F.lit(True)), "unmatched_tool_call")
            .when(s["matched"] >= n_results, "missing_canonical_tool_result")
        )
        after = F.struct(stop.alias("stop"), (s["matched"] + stop.isNull().cast("int")).alias("matched"), (s["emitted"] + 1).alias("emitted"), s["passes"].alias("passes")).cast(state)
        return F.when(s["stop"].isNotNull(), s).otherwise(after)

    def one(s: Column, p: Column) -> Column:
        now = F.struct(F.when(p["failure"].isNotNull(), "parse_error").when(F.size(p["calls"]) == 0, "final_answer").alias("stop"), s["matched"].alias("matched"), s["emitted"].alias("emitted"), (s["passes"] + 1).alias("passes")).cast(state)
        return F.when(s["stop"].isNotNull(), s).otherwise(F.aggregate(p["calls"], now, call))

    done = F.aggregate(F.slice(passes, 1, most_passes), start, one)
    return F.struct(F.coalesce(done["stop"], F.lit("max_tool_passes")).alias("stop_reason"), done["matched"].alias("matched"), done["emitted"].alias("emitted"), done["passes"].alias("passes"))


def plain_lines(messages: Column) -> Column:
    """Each message (role, content) as a line of the plain chat format."""
    return F.transform(messages, lambda m: F.concat_ws(":", m["role"], F.coalesce(m["content"], F.lit(""))))


def label_mask(messages: Column, tokens: Callable[[Column], Column], ignore: int = -100) -> Column:
    """input_ids and labels of a conversation in the plain format: only texts of assistant messages with loss are labelled.

    Tokens are characters here, so what comes before a message is the same tokens with and without it.
    """
    sep = lambda i: F.when(i > 0, "\n").otherwise("")
    parts = F.transform(messages, lambda m, i: F.struct(F.concat(sep(i), m["role"], F.lit(":")).alias("head"), F.coalesce(m["content"], F.lit("")).alias("body"), ((m["role"] == "assistant") & F.coalesce(m["loss"], F.lit(True))).alias("target")))
    ids = F.flatten(F.transform(parts, lambda p: tokens(F.concat(p["head"], p["body"]))))
    hidden = lambda c: F.transform(tokens(c), lambda t: F.lit(ignore))
    labels = F.flatten(F.transform(parts, lambda p: F.concat(hidden(p["head"]), F.when(p["target"], tokens(p["body"])).otherwise(hidden(p["body"])))))
    return F.struct(ids.alias("input_ids"), labels.alias("labels"))


# Outputs with what is wrong with them (empty: nothing) and the names of their calls, on the wire and in serving.
_F = '{"name": "freeze_card", "arguments": {"last4": "4821"}}'
_B = "<tool_call>%s</tool_call>"
FIXTURES: list[tuple[str, str, str, str, str]] = [
    ("Your card is frozen.", "", "", "", ""),
    (_B % _F, "", "freeze_card", "", "freeze_card"),
    (_B % _F + "\n" + _B % '{"name": "list_cards", "arguments": {}}', "", "freeze_card,list_cards", "", "freeze_card,list_cards"),
    ("Sure. " + _B % _F, "tool-call output must not contain prose outside tool_call blocks", "", "", "freeze_card"),
    (_F, "", "freeze_card", "", ""),
    ('{"content": "Hello"}', "", "", "", ""),
    ('{"tool_calls": [{"id": "a", "function": {"name": "list_transactions", "arguments": "{\\"limit\\": 5}"}}]}', "", "list_transactions", "", ""),
    ('{"tool_calls": [{"id": "a"}]}', "tool call missing function object", "", "", ""),
    ('{"x": 1}', "assistant payload contains neither tool_calls nor content", "", "", ""),
    ("{x", "assistant output is not parseable JSON", "", "", ""),
    ("   ", "assistant output is empty", "", "", ""),
    ("<tool_call>" + _F, "assistant output contains malformed tool_call block", "", "model returned a malformed tool-call block", ""),
    (_B % "{'a'}", "assistant output is not parseable JSON", "", "model tool call is not valid JSON", ""),
    (_B % "[1]", "tool_call block must contain a JSON object", "", "model tool call must be a JSON object", ""),
    (_B % '{"name": " ", "arguments": {}}', "tool call requires a function name", "", "model tool call requires a function name", ""),
    (_B % '{"name": "list_cards"}', "tool call arguments must be a JSON object", "", "model tool-call arguments must be an object", ""),
    (_B % '{"name": "pay", "arguments": {}}', "unknown tool name: pay", "", "model selected unsupported tool: pay", ""),
    (_B % '{"name": "list_cards", "arguments": {"pin": 1}}', "unsupported arguments for list_cards: ['pin']", "", "model supplied unsupported arguments for list_cards", ""),
    (_B % '{"name": "list_transactions", "arguments": {"limit": 0}}', "value below minimum for list_transactions.limit", "", "model supplied value below minimum for list_transactions.limit", ""),
    (_B % '{"name": "list_transactions", "arguments": {"limit": 21}}', "value above maximum for list_transactions.limit", "", "model supplied value above maximum for list_transactions.limit", ""),
    (_B % '{"name": "list_transactions", "arguments": {"limit": true}}', "invalid type for list_transactions.limit: expected ['integer'], got boolean", "", "model supplied invalid type for list_transactions.limit", ""),
    (_B % '{"name": "freeze_card", "arguments": {"last4": 4821}}', "invalid type for freeze_card.last4: expected ['null', 'string'], got integer", "", "model supplied invalid type for freeze_card.last4", ""),
    (_B % '{"name": "freeze_card", "arguments": {"last4": null}}', "", "freeze_card", "", "freeze_card"),
    (_B % '{"id": "a", "name": "list_cards", "arguments": {}}' * 2, "duplicate tool call id: a", "", "model tool-call IDs must be unique", ""),
    (_B % '{"name": "list_cards", "arguments": {}, "index": 1}', "tool call indexes must be ordered from zero", "", "model tool-call indexes must be ordered from zero", ""),
    (_B % '{"name": "list_cards", "arguments": {}}' * 9, "", "list_cards," * 8 + "list_cards", "model returned more than 8 tool calls", ""),
]
# Passes of a run with expected calls, recorded results, and where it stops: reason, matched, emitted, passes.
RUNS: list[tuple[list[str], list[tuple[str, str]], int, str, int, int, int]] = [
    ([_B % _F, "It is frozen."], [("freeze_card", '{"last4":"4821"}')], 1, "final_answer", 1, 1, 2),
    (["No."], [("freeze_card", "{}")], 1, "final_answer", 0, 0, 1),
    ([_B % _F, "Oh " + _B % _F], [("freeze_card", '{"last4":"4821"}')], 1, "parse_error", 1, 1, 2),
    ([_B % _F, _B % _F], [("freeze_card", '{"last4":"4821"}')], 1, "unmatched_tool_call", 1, 2, 2),
    ([_B % _F], [("freeze_card", '{"last4":"1"}')], 1, "unmatched_tool_call", 0, 1, 1),
    ([_B % _F], [("freeze_card", '{"last4":"4821"}')], 0, "missing_canonical_tool_result", 0, 1, 1),
    ([_B % _F] * 3, [("freeze_card", '{"last4":"4821"}')] * 3, 3, "max_tool_calls", 2, 3, 3),
    ([_B % '{"name": "list_cards", "arguments": {}}', _B % _F], [("list_cards", "{}"), ("freeze_card", '{"last4":"4821"}')], 2, "max_tool_passes", 2, 2, 2),
]

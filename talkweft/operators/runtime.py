"""What a running assistant does with stored conversations: classify the current turn, assemble rows, show what happened."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .messages import router_input, visible
from .scoring import route
from .seeds import canned_result

# What is said where there is nothing to classify, and messages of the two context histories.
NO_USER = "at least one non-empty user message is required"
CASE_ASKED, CASE_TOLD = "Show my recent service cases", "You have one recent service case: Confirm mailing address update. It is closed and was created on 2026-06-18 at 14:00 UTC."
CARD_ASKED, CARD_TOLD = "Show my cards", "You have an active Everyday Visa Debit card ending in 4821."
PREDICTED = "struct<domain_probability:double,capability_probabilities:array<double>,relation_probabilities:array<double>>"


def classified(turns: DataFrame, predict: Callable[[Column], Column], capabilities: list[str], relations: list[str], thresholds: list[float], rescue: str, ood: float, inside: float, rescue_at: float, max_exchanges: int = 3, most: int = 3) -> DataFrame:
    """Every conversation's current turn through a router: route, candidates, active relations, or why there is none.

    The last user text that isn't blank is rendered with the exchanges before it, and ``predict`` gives PREDICTED of the rendered
    text (a column, or a vectorised UDF around a model). Only accepted turns get a capability; candidates are the ``most`` likely.
    """
    rendered = router_input(turns, max_exchanges)
    scored = rendered.withColumn("p", predict(F.col("router_input")).cast(PREDICTED))
    domain, relation = F.col("p.domain_probability"), F.col("p.relation_probabilities")
    taken = route(domain, relation[relations.index(rescue)], ood, inside, rescue_at)
    named = F.transform("p.capability_probabilities", lambda p, i: F.struct((-p).alias("order"), i.alias("i"), F.get(F.array(*[F.lit(c) for c in capabilities]), i).alias("capability"), p.alias("probability")))
    candidates = F.transform(F.slice(F.array_sort(named), 1, min(most, len(capabilities))), lambda c: F.struct(c["capability"].alias("capability"), c["probability"].alias("probability")))
    marks = F.arrays_zip(F.array(*[F.lit(r) for r in relations]).alias("name"), relation.alias("p"), F.array(*[F.lit(t) for t in thresholds]).alias("t"))
    active = F.transform(F.filter(marks, lambda x: x["p"] >= x["t"]), lambda x: x["name"])
    rows = scored.select("conv_id", "context_applied", domain.alias("domain_probability"), taken.alias("route"), candidates.alias("candidates"), active.alias("relations"))
    rows = rows.withColumn("capability", F.when(F.col("route") == "in_domain", F.col("candidates")[0]["capability"]))
    without = turns.select("conv_id").distinct().join(visible(turns).where("role = 'user'").select("conv_id").distinct(), "conv_id", "left_anti")
    return rows.withColumn("failure", F.lit(None).cast("string")).unionByName(without.withColumn("failure", F.lit(NO_USER)), allowMissingColumns=True)


def first_router_example(current: Column, previous_user: Column, domain_label: Column, intent_label: Column, intent: Column, kind: Column, source: Column, source_split: Column, source_label: Column, license_name: Column) -> Column:
    """A row of the first router's training set, its text rendered with the user text before."""
    text = F.concat(F.lit("[CURRENT]\n"), strip(current), F.when(F.coalesce(strip(previous_user), F.lit("")) != "", F.concat(F.lit("\n[PREVIOUS_USER]\n"), strip(previous_user))).otherwise(""))
    named = {"text": text, "current_text": current, "previous_user": previous_user, "domain_label": domain_label, "intent_label": intent_label, "intent": intent, "example_kind": kind, "source": source, "source_split": source_split, "source_label": source_label, "license": license_name}
    return F.struct(*[c.alias(n) for n, c in named.items()])


def message(role: str, content: Column, loss: bool) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"), F.lit(loss).alias("loss"))


def context_history(kind: Column, suffix: Column) -> Column:
    """user and assistant messages that stand before an alignment request about a case or a card; other kinds have none."""
    asked = lambda said: F.concat(strip(F.concat_ws(" ", F.lit(said), suffix)), F.lit("."))
    pair = lambda a, b: F.array(message("user", asked(a), False), message("assistant", F.lit(b), False))
    none = F.array().cast("array<struct<role:string,content:string,loss:boolean>>")
    return F.when(kind == "case", pair(CASE_ASKED, CASE_TOLD)).when(kind == "card", pair(CARD_ASKED, CARD_TOLD)).otherwise(none)


def tool_message(call_id: Column, tool: Column) -> Column:
    """The message of a tool's canned result."""
    return F.struct(F.lit("tool").alias("role"), call_id.alias("tool_call_id"), tool.alias("name"), canned_result(tool).alias("content"), F.lit(False).alias("loss"))


def key_value(fact: Column) -> Column:
    """key and value of ``key=value``, cut at the first ``=``; a fact without one has no key."""
    at = F.position(F.lit("="), fact)
    return F.struct(F.when(at > 0, F.left(fact, at - 1)).alias("key"), F.when(at > 0, F.substring(fact, at + 1, F.char_length(fact))).otherwise(fact).alias("value"))


def _shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def _lines(rows: Column, line: Callable[[Column], Column], none: str) -> Column:
    text = F.array_join(F.transform(rows, line), "\n")
    return F.when(F.coalesce(text, F.lit("")) == "", none).otherwise(text)


def diagnostics(found: dict[str, Column], calls: Column, results: Column, passes: Column, visible_response: Column, model: dict[str, str]) -> Column:
    """What an operator is shown of a turn, as markdown.

    ``found``: route, in_domain, ood, context_applied, relations (JSON), reason, failure_type, response_path, and candidates
    (capability, probability). Calls (id, name, arguments as JSON) and results (ok, code) are paired in order; what is left over
    of the longer list is not shown. ``passes``: label, input_tokens, prompt_sha256, output_chars, output_sha256. ``model``:
    name, revision, router_revision, commit.
    """
    tick = lambda c: F.concat(F.lit("`"), _shown(c), F.lit("`"))
    candidates = _lines(found["candidates"], lambda c: F.concat(F.lit("- "), tick(c["capability"]), F.lit(": "), F.format_string("%.3f", c["probability"])), "- None")
    called = _lines(calls, lambda c: F.concat(F.lit("- "), tick(c["id"]), F.lit(" "), tick(c["name"]), F.lit(" "), tick(c["arguments"])), "- None")
    pairs = F.slice(F.arrays_zip(calls.alias("call"), results.alias("result")), F.lit(1), F.least(F.size(calls), F.size(results)))
    code = lambda r: F.when(~r["ok"] & (F.coalesce(r["code"], F.lit("")) != ""), F.concat(F.lit(" ("), tick(r["code"]), F.lit(")"))).otherwise("")
    told = _lines(pairs, lambda p: F.concat(F.lit("- "), tick(p["call"]["id"]), F.lit(" "), tick(p["call"]["name"]), F.lit(": "), F.when(p["result"]["ok"], "success").otherwise("error"), code(p["result"])), "- None")
    ran = _lines(passes, lambda p: F.concat(F.lit("- "), tick(p["label"]), F.lit(": input tokens "), tick(p["input_tokens"]), F.lit(", prompt SHA-256 "), tick(p["prompt_sha256"]), F.lit(", output characters "), tick(p["output_chars"]), F.lit(", raw output SHA-256 "), tick(p["output_sha256"])), "- None; the generator was not invoked.")
    digest = F.coalesce(F.sha2(visible_response, 256), F.lit("not recorded"))
    bullets = [("Route", found["route"]), ("In-domain probability", found["in_domain"]), ("OOD probability", found["ood"]), ("Conversation context applied", found["context_applied"]), ("Relation probabilities", found["relations"]), ("Router reason", F.coalesce(found["reason"], F.lit("not provided"))), ("Router failure type", F.coalesce(found["failure_type"], F.lit("none"))), ("Response path", found["response_path"])]
    ends = [("Generation calls", F.size(passes)), ("Model", F.lit(model["name"])), ("Exact model revision", F.lit(model["revision"])), ("Exact router revision", F.lit(model["router_revision"])), ("Commit", F.lit(model["commit"])), ("Visible response SHA-256", digest)]
    bullet = lambda name, c: F.concat(F.lit(f"- {name}: "), tick(c))
    parts = [
        F.lit("### Experiment diagnostics"),
        F.concat_ws("\n", *[bullet(*b) for b in bullets]),
        F.concat(F.lit("**Diagnostic servicing capabilities**\n"), candidates),
        F.concat(F.lit("**Tool calls**\n"), called),
        F.concat(F.lit("**Tool results**\n"), told),
        F.concat(F.lit("**Generation provenance**\n"), ran),
        F.concat_ws("\n", *[bullet(*b) for b in ends]),
    ]
    return F.concat_ws("\n\n", *parts)

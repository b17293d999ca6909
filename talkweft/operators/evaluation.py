"""The evaluation of tool-use predictions: grounding, replayed state, flags of thirteen metrics, a report for each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import asks_credentials, norm_spaces
from .toolcalls import parsed, unsupported

CALLS = "array<struct<name:string,arguments:string>>"
STATE = "struct<cards:array<struct<last4:string,status:string>>,transactions:array<struct<description:string,disputed:boolean>>,transfers:array<struct<recipient:string,status:string>>>"
EXPECTED = f"struct<tool_calls:{CALLS},executable:boolean,final_state_hash:string,multi_tool:boolean,grounding_facts:array<string>,forbidden_facts:array<string>,faq_facts:array<string>,response_path:string,path:string,path_markers:array<string>,clarification_missing_field:string,credential_check:boolean,requires_tool:boolean>"


def _any(content: Column, found: list[str]) -> Column:
    out = F.lit(False)
    for x in found:
        out = out | content.contains(x)
    return out


def created_at_said(content: Column, raw: Column) -> Column:
    """Whether normalized ``content`` names date, minute and, for ``Z``, the zone of an ISO time; other values must be there as they are."""
    form = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?::\d{2}(?:[.,]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    day = F.regexp_extract(raw, form, 1).try_cast("date")
    minute = F.coalesce(F.nullif(F.regexp_extract(raw, form, 2), F.lit("")), F.lit("00:00"))
    there = (content.contains(F.date_format(day, "yyyy-MM-dd")) | content.contains(F.lower(F.date_format(day, "MMMM d, yyyy")))) & content.contains(minute)
    zone = content.rlike(r"\butc\b") | F.rlike(content, F.concat(minute, F.lit(r"(:\d{2})?z\b")))
    return F.when(day.isNull(), content.contains(norm_spaces(raw))).otherwise(there & (~raw.endswith("Z") | zone))


def fact_said(content: Column, fact: Column) -> Column:
    """Whether normalized ``content`` bears out a fact ``key=value``, by the rule of its key; a fact without ``=`` must be there."""
    key = F.substring_index(fact, "=", 1)
    raw = F.substr(fact, F.length(key) + 2)
    value = norm_spaces(F.replace(raw, F.lit("_"), F.lit(" ")))
    there = content.contains(value)
    refused = _any(content, ["cannot", "can't", "unable", "will not"]) & _any(content, ["account number", "customer id"])
    status = F.when(value == "replacement pending", content.contains("replacement") & content.contains("pending")).when(value == "frozen", _any(content, ["frozen", "froze"])).otherwise(there)
    return (
        F.when(~fact.contains("="), content.contains(norm_spaces(fact)))
        .when(key.isin("accounts.count", "transactions.limit"), True)
        .when(key.endswith(".status"), status)
        .when(key == "transaction.disputed", (value != "true") | content.contains("disput"))
        .when(key == "missing_field", (value != "last4") | content.contains("last four"))
        .when(key == "error.code", (value != "backend error") | _any(content, ["could not", "couldn't", "unable", "not able"]))
        .when(key == "private_data_refused", (value != "true") | refused)
        .when(key == "domain", (value != "out of domain") | _any(content, ["retail banking", "financial services"]))
        .when(key == "case.created_at", created_at_said(content, raw))
        .otherwise(there)
    )


def grounded(said: Column, facts: Column, forbidden: Column) -> Column:
    """No forbidden fact is in a normalized text and every fact is; where one of them has a key, all go by the rules of keys."""
    none = F.array().cast("array<string>")
    facts, forbidden = F.coalesce(facts, none), F.coalesce(forbidden, none)
    plain = F.forall(facts, lambda f: said.contains(norm_spaces(f)))
    ruled = F.forall(facts, lambda f: fact_said(said, f))
    return ~F.exists(forbidden, lambda f: said.contains(norm_spaces(f))) & F.when(F.exists(facts, lambda f: f.contains("=")), ruled).otherwise(plain)


# Calls that change a state, with its section, the argument that selects a row, the row's field, and the new value.
WRITES = {
    "freeze_card": ("cards", "last4", "status", "frozen"),
    "replace_card": ("cards", "last4", "status", "replacement_pending"),
    "cancel_transfer": ("transfers", "recipient", "status", "cancelled"),
    "dispute_transaction": ("transactions", "description", "disputed", True),
}


def replayed_state(state: Column, calls: Column) -> Column:
    """A state after its calls in order: of the section a call is for, the first row that it selects changes; no selector selects any."""

    def after(s: Column, c: Column) -> Column:
        out = {}
        for section, fields in (("cards", ("last4", "status")), ("transactions", ("description", "disputed")), ("transfers", ("recipient", "status"))):
            rows, new = s[section], s[section]
            for name, (where, argument, field, value) in WRITES.items():
                if where == section:
                    wanted = F.get_json_object(c["arguments"], f"$.{argument}")
                    fold = (lambda x: x) if argument == "last4" else norm_spaces
                    at = F.array_position(F.transform(rows, lambda r: wanted.isNull() | F.coalesce(fold(r[argument]) == fold(wanted), F.lit(False))), True)  # noqa: B023
                    changed = F.transform(rows, lambda r, i: F.struct(*[(F.when(i + 1 == at, F.lit(value)).otherwise(r[f]) if f == field else r[f]).alias(f) for f in fields]))  # noqa: B023
                    new = F.when(c["name"] == name, changed).otherwise(new)
            out[section] = new
        return F.struct(*[v.alias(k) for k, v in out.items()]).cast(STATE)

    return F.aggregate(calls, state.cast(STATE), after)


def ascii_json(text: Column) -> Column:
    """JSON text with everything beyond ASCII escaped."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    cp = F.ascii
    high, low = (lambda c: F.lit(0xD800) + F.shiftright(cp(c) - 0x10000, 10)), (lambda c: F.lit(0xDC00) + (cp(c) - 0x10000) % 1024)
    escaped = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(cp(c) < 128, c).when(cp(c) < 0x10000, unit(cp(c))).otherwise(F.concat(unit(high(c)), unit(low(c))))), "")
    return F.when(text.rlike("[^\\x00-\\x7f]"), escaped).otherwise(text)


def state_hash(state: Column) -> Column:
    """Digest of a state as canonical JSON: sorted keys, compact, ASCII; what is null isn't in it."""
    return F.concat(F.lit("sha256:"), F.sha2(ascii_json(F.to_json(state)), 256))


def response_path(expected: str = "expected") -> Column:
    path = F.coalesce(F.col(f"{expected}.response_path"), F.col(f"{expected}.path"))
    return F.when(path == "no_tool_banking_faq", "faq").otherwise(path)


def evaluated(df: DataFrame) -> DataFrame:
    """Report of each record. ``df`` has record_id, raw_output, initial_state (STATE) and expected (EXPECTED).

    Names and arguments are all or nothing for a record and weigh as many calls as it expects. Where a flag doesn't
    apply it is null.
    """
    rows = parsed(df).withColumn("said", norm_spaces(F.col("content")))  # once, not in every rule
    e = lambda name: F.col(f"expected.{name}")
    none, calls_none = F.array().cast("array<string>"), F.array().cast(CALLS)
    fine = F.col("failure").isNull()
    wanted, content, said = F.coalesce(e("tool_calls"), calls_none), F.col("content"), F.col("said")
    n = F.size(wanted)
    names = (F.transform("calls", lambda c: c["name"]) == F.transform(wanted, lambda c: c["name"])) & fine
    same = (F.col("calls") == wanted) & fine
    bad = F.size(F.filter("calls", unsupported))
    quiet = (F.size("calls") == 0) & fine
    path, facts, forbidden = response_path(), F.coalesce(e("grounding_facts"), none), F.coalesce(e("forbidden_facts"), none)
    replays = F.coalesce(e("executable"), F.lit(False))
    final_hash = F.when(replays, state_hash(replayed_state(F.col("initial_state"), F.col("calls"))))
    executable = F.when(replays | ((n > 0) & e("final_state_hash").isNotNull()), same & (bad == 0) & (~replays | F.coalesce(final_hash == e("final_state_hash"), F.lit(False))))
    asks = asks_credentials(content)
    missing = F.coalesce(F.nullif(e("clarification_missing_field"), F.lit("")), F.substr(F.get(F.filter(facts, lambda f: f.startswith("missing_field=")), F.lit(0)), F.lit(15)))
    marker = F.when(missing == "last4", "last four").otherwise(norm_spaces(missing))
    clarifies = F.coalesce(quiet & said.contains(marker) & (missing != "") & ~asks, F.lit(False))
    faq = grounded(said, F.coalesce(e("faq_facts"), facts), forbidden)
    given = F.coalesce(e("path_markers"), none)
    markers = F.when((F.size(given) == 0) & (path == "ood"), F.array(F.lit("retail banking"))).otherwise(given)
    on_path = quiet & F.forall(markers, lambda m: said.contains(norm_spaces(m))) & ~F.exists(forbidden, lambda f: said.contains(norm_spaces(f)))
    return rows.select(
        "record_id", "failure", "calls", n.alias("n_expected"), bad.alias("n_unsupported"), path.alias("response_path"), final_hash.alias("final_state_hash"), F.sha2("raw_output", 256).alias("raw_sha256"),
        F.when(n > 0, names).alias("names"), F.when(n > 0, same).alias("arguments"), executable.alias("executable"), F.when((n > 1) | F.coalesce(e("multi_tool"), F.lit(False)), same).alias("sequence"),
        F.when(path == "clarification", clarifies).alias("clarification"), F.when(F.size(facts) > 0, grounded(said, facts, forbidden) & fine).alias("grounding"),
        F.when(F.coalesce(e("credential_check"), F.lit(True)), asks).alias("credential"), F.when(path == "faq", faq & quiet).alias("faq"), F.when(path.isin("ood", "small_talk"), on_path).alias("on_path"),
        F.when(e("requires_tool"), quiet).alias("false_refusal"), F.when(path == "ood", F.size("calls") > 0).alias("false_accept"),
    )


def metrics_of(report: DataFrame) -> DataFrame:
    """The thirteen metrics: numerator, denominator and score, null where nothing was to be judged."""
    flag = lambda c: (F.count_if(F.col(c)), F.count(c))
    weighed = lambda c: (F.coalesce(F.sum(F.when(F.col(c), F.col("n_expected")).cast("long")), F.lit(0)), F.coalesce(F.sum("n_expected"), F.lit(0)))
    parts = {
        "tool_name_accuracy": weighed("names"), "tool_argument_accuracy": weighed("arguments"), "executable_tool_success": flag("executable"), "multi_tool_exact_sequence": flag("sequence"),
        "clarification_appropriateness": flag("clarification"), "grounded_final_factuality": flag("grounding"), "malformed_tool_call_rate": (F.count("failure"), F.count(F.lit(1))),
        "unsupported_private_arguments": (F.coalesce(F.sum("n_unsupported"), F.lit(0)), F.coalesce(F.sum(F.size("calls")), F.lit(0))), "credential_request_rate": flag("credential"), "no_tool_faq_quality": flag("faq"),
        "ood_small_talk_response_path": flag("on_path"), "in_domain_false_refusal": flag("false_refusal"), "ood_false_accept": flag("false_accept"),
    }
    one = report.agg(*[F.struct(a.cast("long").alias("numerator"), b.cast("long").alias("denominator")).alias(k) for k, (a, b) in parts.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k)["numerator"].alias("numerator"), F.col(k)["denominator"].alias("denominator"), F.try_divide(F.col(k)["numerator"].cast("double"), F.col(k)["denominator"]).alias("score")) for k in parts])
    return one.select(F.inline(rows))

"""Bank payloads as tables, shown states, canned tool results, held-out router rows, sign-in secrets."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip, usd

# What a tool gives in alignment records, as canonical JSON of its result.
CANNED = {
    "list_service_cases": '{"service_cases":[{"case_type":"address_update","created_at":"2026-06-18T14:00:00Z","status":"closed","subject":"Confirm mailing address update"}]}',
    "replace_card": '{"card":{"last4":"4821","name":"Everyday Visa Debit","status":"replacement_pending"}}',
    "freeze_card": '{"card":{"last4":"4821","name":"Everyday Visa Debit","status":"frozen"}}',
    "dispute_transaction": '{"transaction":{"description":"North Harbor Market","disputed":true,"status":"posted"}}',
}
# Histories (user, assistant) and the held-out rows: current, history, domain, capability, relations, group.
HISTORIES = {
    "case": ("Show my recent service cases.", "You have a closed mailing-address update case."),
    "card": ("Show me the cards on my profile.", "You have a debit card ending in 4821 and another ending in 7319."),
    "wrong": ("Tell me when my mailing-address case was opened.", "Mortgage applicants are typically at least 18."),
}
HELD_OUT = [
    ("When was that created?", "case", 1, "service_cases", ["context_dependent"], "heldout|service-case-created"),
    ("what is that all about? when was it created?", "case", 1, "service_cases", ["context_dependent"], "heldout|service-case-details"),
    ("was the mailing address updated recently?", None, 1, "service_cases", [], "heldout|mailing-address-standalone"),
    ("ok, thats the one i want to replace", "card", 1, "card_actions", ["context_dependent", "clarification_answer"], "heldout|card-selection"),
    ("why are you repeating yourself", "wrong", 1, "service_cases", ["context_dependent", "agent_repair"], "heldout|agent-repetition-repair"),
    ("I didn't ask about mortgage", "wrong", 1, "service_cases", ["context_dependent", "agent_repair", "topic_shift"], "heldout|wrong-topic-repair"),
    ("what about the weather there?", "case", 0, None, ["topic_shift"], "heldout|weather-topic-shift"),
]
NESTED = ("accounts", "cards", "transactions", "transfers", "service_cases")
SHOWN = {"transfers": 3, "service_cases": 4}


def bank_tables(payload: DataFrame) -> dict[str, DataFrame]:
    """Seed rows (a customer each, with nested arrays) as six tables; every nested row carries its customer_id."""
    own = [c for c in payload.columns if c not in NESTED]
    tables = {"customer": payload.select(*own)}
    for name in NESTED:
        if name in payload.columns:
            tables[name] = payload.select("customer_id", F.explode(name).alias("_r")).select("customer_id", "_r.*")
    return tables


def _bullets(items: Column, line) -> Column:
    text = F.coalesce(F.array_join(F.transform(items, line), "\n"), F.lit(""))
    return F.when(text == "", "- None").otherwise(text)


def shown_state(accounts: Column, cards: Column, transfers: Column, cases: Column) -> Column:
    """A bank state as Markdown: all accounts and cards, the first three transfers and four cases."""
    parts = [
        ("Accounts", _bullets(accounts, lambda a: F.concat(F.lit("- **"), a["name"], F.lit(" ····"), a["last4"], F.lit("** — "), usd(a["available_balance_cents"]), F.lit(" available; "), usd(a["current_balance_cents"]), F.lit(" current")))),
        ("Cards", _bullets(cards, lambda c: F.concat(F.lit("- **"), c["name"], F.lit(" ····"), c["last4"], F.lit("** — `"), c["status"], F.lit("`")))),
        ("Transfers", _bullets(F.slice(transfers, 1, SHOWN["transfers"]), lambda t: F.concat(F.lit("- "), t["recipient"], F.lit(" — "), usd(t["amount_cents"]), F.lit(" `"), t["status"], F.lit("`")))),
        ("Service cases", _bullets(F.slice(cases, 1, SHOWN["service_cases"]), lambda c: F.concat(F.lit("- "), c["subject"], F.lit(" — `"), c["status"], F.lit("`")))),
    ]
    return F.concat(F.lit("### Synthetic backend state\n\n"), F.concat_ws("\n\n", *[F.concat(F.lit(f"#### {title}\n"), text) for title, text in parts]))


def canned_result(tool: Column) -> Column:
    """The envelope of a tool in alignment records; another tool is an error."""
    known = F.create_map(*[F.lit(x) for pair in CANNED.items() for x in pair])
    found = F.concat(F.lit('{"ok":true,"result":'), F.try_element_at(known, tool), F.lit("}"))
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("unsupported alignment tool: "), tool))).otherwise(found)


def held_out_rows(spark: SparkSession) -> DataFrame:
    """The seven regression rows of the router, test only."""
    rows = [(i, text, *(HISTORIES[h] if h else (None, None)), domain, capability, relations, group) for i, (text, h, domain, capability, relations, group) in enumerate(HELD_OUT)]
    df = spark.createDataFrame(rows, "row_no int, current string, asked string, answered string, domain_label int, capability string, relations array<string>, group_id string")
    return df.withColumns({"example_kind": F.lit("heldout_screenshot_regression"), "source": F.lit("self-authored-heldout-regression"), "source_split": F.lit("test")})


def secret_problem(payload: str | None, users: tuple[str, ...]) -> str | None:
    """What is wrong with sign-in secrets: a JSON object of exactly these users and different passwords of 12 characters at least."""
    try:
        found = json.loads(payload or "")
    except ValueError:
        return "sign-in secrets must be a JSON object"
    if not isinstance(found, dict) or found.keys() != set(users):
        return "sign-in secrets must define exactly the demo users"
    if not all(isinstance(p, str) and len(p) >= 12 for p in found.values()):
        return "each demo password must contain at least 12 characters"
    return None if len(set(found.values())) == len(users) else "demo accounts must use different passwords"


def secret_problems(payload: Column, users: tuple[str, ...]) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([secret_problem(p, users) for p in s], dtype=object)

    return F.pandas_udf(run, "string")(strip(payload))

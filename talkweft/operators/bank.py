"""A synthetic bank: seed rows, ordered tool calls of a session, and what they answer and change.

Calls of a session depend on each other, so a session's calls are read in order by one task, as a stream: what is held
is the session's own state, never its calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Arguments that the bank takes (ids among them, which the public tools forbid).
BANK_ARGUMENTS = {"list_accounts": [], "list_cards": [], "list_service_cases": [], "list_transactions": ["limit"], "list_transfers": [], "freeze_card": ["last4"], "replace_card": ["last4"], "dispute_transaction": ["transaction_id", "description"], "cancel_transfer": ["transfer_id", "recipient"]}
ANSWERED = "session string, seq long, tool string, ok boolean, answer string, cases int"


class BankError(ValueError):
    """A call that the bank refuses; its state stays as it was."""


def seeded() -> dict:
    """The rows every session begins with."""
    return {
        "cards": [{"last4": "7319", "status": "frozen"}, {"last4": "4821", "status": "active"}, {"last4": "5500", "status": "active"}],
        "transactions": [  # newest first
            {"id": "t3", "description": "Payroll", "cents": 90_000, "disputed": False},
            {"id": "t2", "description": "North Harbor Market", "cents": -4_210, "disputed": False},
            {"id": "t1", "description": "CloudStream", "cents": -999, "disputed": False},
            {"id": "t0", "description": "CLOUDSTREAM", "cents": -999, "disputed": False},
        ],
        "transfers": [{"id": "f1", "recipient": "River Consulting", "status": "pending"}, {"id": "f0", "recipient": "Jamie Lee", "status": "completed"}],
        "cases": [],
    }


def _only(rows: list[dict], kind: str) -> dict:
    if len(rows) != 1:
        raise BankError(f"expected exactly one matching synthetic {kind}; found {len(rows)}")
    return rows[0]


def _first(rows: list[dict]) -> dict:
    if not rows:
        raise BankError("no matching synthetic banking record")
    return rows[0]


def chosen(rows: list[dict], by_id: str | None, by_text: str | None, field: str, kind: str, open_to_id: bool, is_open) -> dict:
    """The row of an id, the only open one of a text, or the newest open one."""
    if by_id is not None and by_text is not None:
        raise BankError(f"select a {kind} by ID or {field}, not both")
    live = [r for r in rows if is_open(r)]
    if by_text is not None:
        return _only([r for r in live if r[field].lower() == str(by_text).lower()], kind)
    return _first(live if by_id is None else [r for r in (rows if open_to_id else live) if r["id"] == str(by_id)])


def execute(state: dict, tool: str, arguments: dict) -> str:
    """What a call answers; writes change ``state`` and open cases."""
    if tool not in BANK_ARGUMENTS:
        raise BankError(f"unsupported tool: {tool}")
    extra = sorted(set(arguments) - set(BANK_ARGUMENTS[tool]))
    if extra:
        raise BankError(f"unsupported arguments for {tool}: {extra}")
    if tool == "list_transactions":
        limit = int(arguments.get("limit", 5))
        return ",".join(r["id"] for r in (state["transactions"] if limit < 0 else state["transactions"][:limit]))
    if tool.startswith("list_"):
        return str(len(state.get({"list_cards": "cards", "list_transfers": "transfers", "list_service_cases": "cases"}.get(tool, ""), [])))
    if tool in ("freeze_card", "replace_card"):
        last4 = arguments.get("last4")
        ordered = sorted(state["cards"], key=lambda c: c["status"] != "active") if last4 is None else [c for c in state["cards"] if c["last4"] == str(last4)]
        card = _first(ordered)
        card["status"] = "frozen" if tool == "freeze_card" else "replacement_pending"
        state["cases"].append("stolen_card" if tool == "freeze_card" else "replacement_card")
        return f"{card['last4']} {card['status']}"
    if tool == "dispute_transaction":
        row = chosen(state["transactions"], arguments.get("transaction_id"), arguments.get("description"), "description", "transaction", True, lambda r: r["cents"] < 0 and not r["disputed"])
        row["disputed"] = True
        state["cases"].append("transaction_dispute")
        return f"{row['id']} disputed"
    row = chosen(state["transfers"], arguments.get("transfer_id"), arguments.get("recipient"), "recipient", "transfer", False, lambda r: r["status"] == "pending")
    row["status"] = "cancelled"
    return f"{row['id']} cancelled"


def executed(calls: DataFrame, n_partitions: int) -> DataFrame:
    """Answers of calls (session, seq, tool, arguments as JSON). ``reset`` brings a session's seed back."""
    import json

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ANSWERED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, seeded()
        for batch in batches:
            out: list[tuple] = []
            for session, seq, tool, arguments in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if session != own or tool == "reset":
                    own, state = session, seeded()
                try:
                    ok, answer = True, "seed" if tool == "reset" else execute(state, tool, json.loads(arguments or "{}"))
                except BankError as e:
                    ok, answer = False, str(e)
                out.append((session, seq, tool, ok, answer, len(state["cases"])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    dealt = calls.select("session", "seq", "tool", "arguments").repartition(n_partitions, "session").sortWithinPartitions("session", "seq")
    return dealt.mapInArrow(run, ANSWERED)


def session_key(user: Column, session: Column) -> Column:
    return F.sha2(F.concat(user.cast("string"), F.lit("\0"), session.cast("string")), 256)


# A session's calls with their answers, stated by hand: tool, arguments, ok, answer, cases after it.
SESSION: list[tuple[str, str, bool, str, int]] = [
    ("list_cards", "{}", True, "3", 0),
    ("freeze_card", "{}", True, "4821 frozen", 1),
    ("freeze_card", "{}", True, "5500 frozen", 2),
    ("freeze_card", '{"last4":"0000"}', False, "no matching synthetic banking record", 2),
    ("replace_card", '{"last4":"7319"}', True, "7319 replacement_pending", 3),
    ("freeze_card", '{"pin":"1"}', False, "unsupported arguments for freeze_card: ['pin']", 3),
    ("list_transactions", '{"limit":2}', True, "t3,t2", 3),
    ("list_transactions", '{"limit":-1}', True, "t3,t2,t1,t0", 3),
    ("dispute_transaction", '{"description":"cloudstream"}', False, "expected exactly one matching synthetic transaction; found 2", 3),
    ("dispute_transaction", '{"transaction_id":"t0"}', True, "t0 disputed", 4),
    ("dispute_transaction", '{"description":"cloudstream"}', True, "t1 disputed", 5),
    ("dispute_transaction", '{"description":"x","transaction_id":"t1"}', False, "select a transaction by ID or description, not both", 5),
    ("dispute_transaction", "{}", True, "t2 disputed", 6),
    ("dispute_transaction", "{}", False, "no matching synthetic banking record", 6),
    ("cancel_transfer", '{"recipient":"JAMIE LEE"}', False, "expected exactly one matching synthetic transfer; found 0", 6),
    ("cancel_transfer", '{"transfer_id":"f0"}', False, "no matching synthetic banking record", 6),
    ("cancel_transfer", '{"recipient":"river consulting"}', True, "f1 cancelled", 6),
    ("list_service_cases", "{}", True, "6", 6),
    ("pay", "{}", False, "unsupported tool: pay", 6),
    ("reset", "{}", True, "seed", 0),
    ("cancel_transfer", "{}", True, "f1 cancelled", 0),
]

"""Registered queries of the full evaluator. Rows of conversations draw their record from FIXTURES; the SQL judges the rows by itself."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import scoring as S
from ..operators import toolcalls as K
from .catalog import query


def _call(name: str, arguments: str) -> str:
    return f'<tool_call>\n{{"name": "{name}", "arguments": {arguments}}}\n</tool_call>'


def _hash(**state) -> str:
    return "sha256:" + hashlib.sha256(json.dumps(state, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


ACTIVE = {"cards": [{"last4": "1111", "status": "active"}, {"last4": "4821", "status": "active"}]}
FROZEN = _hash(cards=[{"last4": "1111", "status": "active"}, {"last4": "4821", "status": "frozen"}])
PENDING = {"transfers": [{"recipient": "Sam Roe", "status": "pending"}, {"recipient": "Alex Kim", "status": "pending"}]}
BOUGHT = {"transactions": [{"description": "Café Nord", "disputed": False}]}
FREEZE = [{"name": "freeze_card", "arguments": '{"last4":"4821"}'}]
READ = [{"name": "list_accounts", "arguments": "{}"}]

# raw output, expected, initial state
FIXTURES: list[tuple[str, dict, dict]] = [
    (_call("freeze_card", '{"last4": "4821"}') + "\nYour card ending in 4821 is frozen.", {"requires_tool": True, "tool_calls": FREEZE, "executable": True, "final_state_hash": FROZEN, "grounding_facts": ["4821", "frozen"], "path": "tool_success"}, ACTIVE),
    (_call("freeze_card", '{"last4": "1111"}') + "I froze it.", {"requires_tool": True, "tool_calls": FREEZE, "executable": True, "final_state_hash": FROZEN, "grounding_facts": ["card.status=frozen"], "path": "tool_success"}, ACTIVE),
    (_call("freeze_card", '{"last4": "4821"}'), {"requires_tool": True, "tool_calls": FREEZE, "executable": True, "final_state_hash": _hash(cards=[]), "path": "tool_success"}, ACTIVE),
    (_call("cancel_transfer", '{"recipient": "ALEX  kim"}'), {"tool_calls": [{"name": "cancel_transfer", "arguments": '{"recipient":"ALEX  kim"}'}], "executable": True, "final_state_hash": _hash(transfers=[{"recipient": "Sam Roe", "status": "pending"}, {"recipient": "Alex Kim", "status": "cancelled"}])}, PENDING),
    (_call("dispute_transaction", "{}") + "We opened the dispute", {"tool_calls": [{"name": "dispute_transaction", "arguments": "{}"}], "executable": True, "final_state_hash": _hash(transactions=[{"description": "Café Nord", "disputed": True}]), "grounding_facts": ["transaction.disputed=true", "accounts.count=2"]}, BOUGHT),
    (_call("list_accounts", "{}") + " Two accounts.", {"requires_tool": True, "tool_calls": READ, "final_state_hash": "sha256:any", "multi_tool": True}, {}),
    (_call("get_account_balance", '{"account_id": "a"}'), {"requires_tool": True, "tool_calls": READ}, {}),
    (_call("list_accounts", '{"pin": 1}'), {"tool_calls": READ + FREEZE}, {}),
    ("<tool_call>{'name': 1}</tool_call>", {"tool_calls": READ, "requires_tool": True}, {}),
    ("<tool_call>[1]</tool_call>", {"path": "ood"}, {}),
    ('<tool_call>{"name": " "}</tool_call>', {"path": "ood"}, {}),
    ('<tool_call>{"name": "list_cards", "arguments": [1]}</tool_call>', {}, {}),
    ("<tool_call>{}", {"tool_calls": READ}, {}),
    ("Which card? Share the last  four digits.", {"path": "clarification", "grounding_facts": ["missing_field=last4"]}, {}),
    ("Which recipient? And your PIN?", {"path": "clarification", "clarification_missing_field": "recipient"}, {}),
    ("What now?", {"path": "clarification"}, {}),
    ("An overdraft fee may apply.", {"path": "no_tool_banking_faq", "grounding_facts": ["faq=overdraft"]}, {}),
    ("Mortgages take time", {"path": "no_tool_banking_faq", "faq_facts": ["mortgage"], "forbidden_facts": ["take time"], "credential_check": False}, {}),
    ("I can only help with Retail Banking.", {"response_path": "ood", "path": "tool_success"}, {}),
    ("Sure, a poem.", {"path": "ood", "grounding_facts": ["domain=out_of_domain"]}, {}),
    (_call("list_cards", "{}"), {"path": "ood", "path_markers": []}, {}),
    ("Hello!", {"response_path": "small_talk"}, {}),
    ("Bye", {"response_path": "small_talk", "path_markers": ["hello"]}, {}),
    ("It was made on July 4, 2026 at 09:05 UTC.", {"grounding_facts": ["case.created_at=2026-07-04T09:05:00Z"]}, {}),
    ("It was made on 2026-07-04 at 09:05.", {"grounding_facts": ["case.created_at=2026-07-04T09:05:00Z"]}, {}),
    ("It was made on 2026-07-04 at 09:05:10z.", {"grounding_facts": ["case.created_at=2026-07-04T09:05:00Z", "case.status=closed"]}, {}),
    ("Made long ago; replacement is pending", {"grounding_facts": ["case.created_at=long ago", "card.status=replacement_pending"]}, {}),
    ("I could not do that; I can't share a customer ID.", {"grounding_facts": ["error.code=backend_error", "private_data_refused=true"], "path": "tool_error"}, {}),
]

_ROWS = ", ".join("({}, '{}', '{}', '{}')".format(i, raw.replace("'", "''"), json.dumps(e).replace("'", "''"), json.dumps(s, ensure_ascii=False).replace("'", "''")) for i, (raw, e, s) in enumerate(FIXTURES))
_N = len(FIXTURES)


def records(df: DataFrame) -> DataFrame:
    k = ((F.col("conv_id") + F.col("turn")) % _N + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), k)
    return df.select(F.concat_ws("-", "conv_id", "turn").alias("record_id"), pick([f[0] for f in FIXTURES]).alias("raw_output"), F.from_json(pick([json.dumps(f[1]) for f in FIXTURES]), E.EXPECTED).alias("expected"), F.from_json(pick([json.dumps(f[2]) for f in FIXTURES]), E.STATE).alias("initial_state"))


_NORM = lambda x: f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"
_WRITE = """CASE name WHEN 'cancel_transfer' THEN json_object('transfers', list_transform(t, lambda r, i: json_object('recipient', r->>'recipient', 'status', CASE WHEN i = hit THEN 'cancelled' ELSE r->>'status' END)))
WHEN 'dispute_transaction' THEN json_object('transactions', list_transform(t, lambda r, i: json_object('description', r->>'description', 'disputed', CASE WHEN i = hit THEN true ELSE (r->>'disputed')::BOOLEAN END)))
ELSE json_object('cards', list_transform(t, lambda r, i: json_object('last4', r->>'last4', 'status', CASE WHEN i = hit THEN 'frozen' ELSE r->>'status' END))) END"""
_SAID = f"""CASE WHEN NOT contains(f, '=') THEN contains(said, {_NORM('f')}) WHEN f LIKE 'accounts.count=%' OR f LIKE 'transactions.limit=%' THEN true
WHEN regexp_matches(f, '^[^=]*[.]status=replacement_pending$') THEN contains(said, 'replacement') AND contains(said, 'pending') WHEN regexp_matches(f, '^[^=]*[.]status=frozen$') THEN regexp_matches(said, 'frozen|froze')
WHEN f = 'transaction.disputed=true' THEN contains(said, 'disput') WHEN f = 'missing_field=last4' THEN contains(said, 'last four') WHEN f = 'error.code=backend_error' THEN regexp_matches(said, 'could not|couldn''t|unable|not able')
WHEN f = 'private_data_refused=true' THEN regexp_matches(said, 'cannot|can''t|unable|will not') AND regexp_matches(said, 'account number|customer id') WHEN f = 'domain=out_of_domain' THEN regexp_matches(said, 'retail banking|financial services')
WHEN regexp_matches(f, '^case[.]created_at=[0-9]') THEN (contains(said, substr(f, 17, 10)) OR contains(said, lower(strftime(substr(f, 17, 10)::DATE, '%B %-d, %Y')))) AND contains(said, substr(f, 28, 5)) AND (NOT ends_with(f, 'Z') OR regexp_matches(said, '\\butc\\b') OR regexp_matches(said, substr(f, 28, 5) || '(:[0-9][0-9])?z\\b'))
ELSE contains(said, {_NORM("replace(substr(f, strpos(f, '=') + 1), '_', ' ')")}) END"""
_JUDGED = f"""WITH fx AS (SELECT k, raw, e::JSON AS e, s::JSON AS s FROM (VALUES {_ROWS}) v(k, raw, e, s)),
bl AS (SELECT k, unnest(regexp_extract_all(raw, '(?s)<tool_call>\\s*(.*?)\\s*</tool_call>', 1)) AS b, generate_subscripts(regexp_extract_all(raw, '(?s)<tool_call>\\s*(.*?)\\s*</tool_call>', 1), 1) AS i FROM fx),
pb AS (SELECT k, i, b, CASE WHEN NOT json_valid(b) THEN 'tool call is not valid JSON' WHEN json_type(b) <> 'OBJECT' THEN 'tool call must be a JSON object' WHEN coalesce(json_type(b, '$.name'), '') <> 'VARCHAR' OR trim(b->>'$.name') = '' THEN 'tool call requires a function name' WHEN coalesce(json_type(b, '$.arguments'), 'OBJECT') <> 'OBJECT' THEN 'tool-call arguments must be an object' END AS f FROM bl),
pf AS (SELECT k, arg_min(f, i) FILTER (f IS NOT NULL) AS f FROM pb GROUP BY 1),
ok AS (SELECT pb.k, i, trim(b->>'$.name') AS name, coalesce((b->'$.arguments'), '{{}}'::JSON) AS a FROM pb JOIN pf USING (k) WHERE pf.f IS NULL),
g AS (SELECT k, list({{'name': name, 'arguments': json(a)::VARCHAR}} ORDER BY i) AS calls, count(*) FILTER (name NOT IN ('list_accounts', 'list_cards', 'list_service_cases', 'list_transactions', 'list_transfers', 'cancel_transfer', 'dispute_transaction', 'freeze_card', 'replace_card') OR len(list_filter(json_keys(a), lambda x: x <> CASE WHEN name = 'list_transactions' THEN 'limit' WHEN name = 'cancel_transfer' THEN 'recipient' WHEN name = 'dispute_transaction' THEN 'description' WHEN name IN ('freeze_card', 'replace_card') THEN 'last4' ELSE '' END)) > 0) AS bad FROM ok GROUP BY 1),
st AS (SELECT ok.k, name, from_json(CASE WHEN name = 'cancel_transfer' THEN s->'transfers' WHEN name = 'dispute_transaction' THEN s->'transactions' ELSE s->'cards' END, '["JSON"]') AS t, CASE WHEN name = 'cancel_transfer' THEN 'recipient' WHEN name = 'dispute_transaction' THEN 'description' ELSE 'last4' END AS field, coalesce(a->>'recipient', a->>'description', a->>'last4') AS sel FROM ok JOIN fx USING (k) WHERE (e->>'executable') = 'true'),
sh AS (SELECT k, 'sha256:' || sha256(replace({_WRITE}::VARCHAR, 'é', '\\u00e9')) AS final FROM (SELECT *, list_position(list_transform(t, lambda r: sel IS NULL OR {_NORM("json_extract_string(r, '$.' || field)")} = {_NORM('sel')}), true) AS hit FROM st)),
r AS (SELECT fx.k, raw, e, CASE WHEN pf.k IS NULL AND (contains(raw, '<tool_call') OR contains(raw, '</tool_call>')) THEN 'malformed tool-call block' ELSE pf.f END AS failure, coalesce(calls, []) AS calls, coalesce(bad, 0) AS bad, final, coalesce(from_json(e->'tool_calls', '[{{"name":"VARCHAR","arguments":"VARCHAR"}}]'), []) AS want, coalesce(from_json(e->'grounding_facts', '["VARCHAR"]'), []) AS facts, coalesce(from_json(e->'forbidden_facts', '["VARCHAR"]'), []) AS forb, coalesce(e->>'response_path', e->>'path') AS p0 FROM fx LEFT JOIN pf USING (k) LEFT JOIN g USING (k) LEFT JOIN sh USING (k)),
c AS (SELECT *, CASE WHEN p0 = 'no_tool_banking_faq' THEN 'faq' ELSE p0 END AS p, CASE WHEN failure IS NOT NULL THEN raw ELSE regexp_replace(raw, '(?s)<tool_call>\\s*(.*?)\\s*</tool_call>', '', 'g') END AS said0 FROM r),
d AS (SELECT *, {_NORM('said0')} AS said, regexp_matches(said0, '(?i)\\b(account number|customer id|password|pin|verify your identity|social security|ssn)\\b') AS asks, len(calls) = 0 AND failure IS NULL AS quiet, coalesce(from_json(e->'faq_facts', '["VARCHAR"]'), facts) AS ff, from_json(e->'path_markers', '["VARCHAR"]') AS pm, coalesce(e->>'clarification_missing_field', substr(list_filter(facts, lambda f: starts_with(f, 'missing_field='))[1], 15)) AS mf FROM c),
j AS (SELECT *, failure IS NULL AND calls = want AS same, NOT list_bool_or(list_transform(forb, lambda f: contains(said, {_NORM('f')}))) IS TRUE AND list_bool_and(list_transform(facts, lambda f: {_SAID})) IS NOT FALSE AS gr, NOT list_bool_or(list_transform(forb, lambda f: contains(said, {_NORM('f')}))) IS TRUE AND list_bool_and(list_transform(ff, lambda f: {_SAID})) IS NOT FALSE AS fq FROM d),
z AS (SELECT k, failure, calls, len(want) AS n, bad, p, final, sha256(raw) AS raw_sha256, CASE WHEN len(want) > 0 THEN failure IS NULL AND list_transform(calls, lambda x: x.name) = list_transform(want, lambda x: x.name) END AS names, CASE WHEN len(want) > 0 THEN same END AS arguments,
CASE WHEN (e->>'executable') = 'true' OR (len(want) > 0 AND (e->>'final_state_hash') IS NOT NULL) THEN same AND bad = 0 AND ((e->>'executable') IS NULL OR final = (e->>'final_state_hash')) END AS executable, CASE WHEN len(want) > 1 OR (e->>'multi_tool') = 'true' THEN same END AS sequence,
CASE WHEN p = 'clarification' THEN mf IS NOT NULL AND quiet AND contains(said, CASE WHEN mf = 'last4' THEN 'last four' ELSE mf END) AND NOT asks END AS clarification, CASE WHEN len(facts) > 0 THEN gr AND failure IS NULL END AS grounding, CASE WHEN (e->>'credential_check') IS NULL THEN asks END AS credential, CASE WHEN p = 'faq' THEN fq AND quiet END AS faq,
CASE WHEN p IN ('ood', 'small_talk') THEN quiet AND list_bool_and(list_transform(CASE WHEN coalesce(len(pm), 0) = 0 AND p = 'ood' THEN ['retail banking'] ELSE coalesce(pm, []) END, lambda m: contains(said, m))) IS NOT FALSE END AS on_path, CASE WHEN (e->>'requires_tool') = 'true' THEN quiet END AS false_refusal, CASE WHEN p = 'ood' THEN len(calls) > 0 END AS false_accept FROM j),
x AS (SELECT conv_id || '-' || turn AS record_id, z.* FROM conversations JOIN z ON z.k = (conv_id + turn) % {_N})"""

_FLAGS = ["names", "arguments", "executable", "sequence", "clarification", "grounding", "credential", "faq", "on_path", "false_refusal", "false_accept"]


@query("conversations", _JUDGED + f" SELECT record_id, failure, array_to_string(list_transform(calls, lambda c: c.name || c.arguments), ';') AS calls, n::INT AS n_expected, bad::INT AS n_unsupported, p AS response_path, final AS final_state_hash, raw_sha256, {', '.join(_FLAGS)} FROM x")
def evaluated_records(df: DataFrame) -> DataFrame:
    calls = F.array_join(F.transform("calls", lambda c: F.concat(c["name"], c["arguments"])), ";")
    return E.evaluated(records(df)).withColumn("calls", calls)


_METRICS = [("tool_name_accuracy", "sum(CASE WHEN names THEN n ELSE 0 END)", "sum(n)"), ("tool_argument_accuracy", "sum(CASE WHEN arguments THEN n ELSE 0 END)", "sum(n)"), ("malformed_tool_call_rate", "count(failure)", "count(*)"), ("unsupported_private_arguments", "sum(bad)", "sum(len(calls))")]
_METRICS += [(m, f"count(*) FILTER ({c})", f"count({c})") for m, c in [("executable_tool_success", "executable"), ("multi_tool_exact_sequence", "sequence"), ("clarification_appropriateness", "clarification"), ("grounded_final_factuality", "grounding"), ("credential_request_rate", "credential"), ("no_tool_faq_quality", "faq"), ("ood_small_talk_response_path", "on_path"), ("in_domain_false_refusal", "false_refusal"), ("ood_false_accept", "false_accept")]]


@query("conversations", _JUDGED + " ".join(f"{' UNION ALL' if i else ''} SELECT '{m}' AS metric, ({a})::BIGINT AS numerator, ({b})::BIGINT AS denominator, ({a})::DOUBLE / nullif({b}, 0) AS score FROM x" for i, (m, a, b) in enumerate(_METRICS)))
def evaluated_metrics(df: DataFrame) -> DataFrame:
    return E.metrics_of(E.evaluated(records(df)))


@query("conversations", _JUDGED + " ".join(f"{' UNION ALL' if i else ''} SELECT '{m}' AS metric, ({a})::DOUBLE / nullif({b}, 0) AS value, coalesce(({a})::DOUBLE / nullif({b}, 0) {'>= 1 - 1e-12' if m in K.AT_ONE else '<= 1e-12'}, false) AS passed FROM x" for i, (m, a, b) in enumerate(_METRICS)))
def evaluated_gates(df: DataFrame) -> DataFrame:
    """The gates over all records; a gate that the records fail is shown as failed."""
    table = E.metrics_of(E.evaluated(records(df))).select("metric", F.col("score").alias("value"))
    return S.gates(table, [(m, "min", 1.0) for m in K.AT_ONE] + [(m, "max", 0.0) for m in K.AT_ZERO])

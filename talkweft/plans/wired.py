"""Registered queries of the wire, the router's rows and the bank, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bank as B
from ..operators import measures as A
from ..operators import messages as M
from ..operators import router_rows as R
from ..operators import wire as W
from .catalog import CURRENT, NORM_B, P, VISIBLE, query
from .measured import _PATH_SQL, _PATHS

_q = lambda s: "'" + s.replace("'", "''") + "'"
_NAMES = ["list_transactions", "list_cards", "freeze_card", "pay", "list_transactions", " "]

# An output is made of a turn's text: its length picks the tool, the argument, its value, an index, and what stands around the call.
_RAW = f"""SELECT conv_id, turn, length(text) AS n, left(text, 12) AS prose, {"[" + ", ".join(map(_q, _NAMES)) + "]"}[length(text) % 6 + 1] AS name, CASE WHEN length(text) % 10 = 7 THEN 'pin' WHEN length(text) % 6 = 2 THEN 'last4' ELSE 'limit' END AS argument, length(text) % 25 AS value, CASE length(text) % 8 WHEN 5 THEN 'string' WHEN 6 THEN 'boolean' ELSE 'integer' END AS kind, length(text) % 9 = 8 AS indexed, length(text) % 7 = 3 AS spoken, length(text) % 11 = 4 AS broken, length(text) % 13 = 6 AS plain FROM conversations"""


def _raw(df: DataFrame) -> DataFrame:
    n = F.char_length("text")
    name = F.element_at(F.array(*[F.lit(x) for x in _NAMES]), (n % 6 + 1).cast("int"))
    value = (n % 25).cast("string")
    said = F.when(n % 8 == 5, F.concat(F.lit('"'), value, F.lit('"'))).when(n % 8 == 6, "true").otherwise(value)
    argument = F.when(n % 10 == 7, "pin").when(n % 6 == 2, "last4").otherwise("limit")
    call = F.concat(F.lit('{"name": "'), name, F.lit('", "arguments": {"'), argument, F.lit('": '), said, F.lit("}"), F.when(n % 9 == 8, ', "index": 3').otherwise(""), F.when(n % 11 == 4, "").otherwise("}"))
    block = F.concat(F.when(n % 7 == 3, F.concat(F.left("text", F.lit(12)), F.lit(" "))).otherwise(""), F.lit("<tool_call>"), call, F.lit("</tool_call>"))
    return df.select("conv_id", "turn", F.when(n % 13 == 6, F.col("text")).otherwise(block).alias("raw"))


@query("conversations", f"""WITH r AS ({_RAW}), v AS (SELECT *, CASE WHEN argument = 'pin' THEN 'unknown' WHEN name = 'list_transactions' AND argument = 'limit' THEN CASE WHEN kind <> 'integer' THEN 'type' WHEN value < 1 THEN 'minimum' WHEN value > 20 THEN 'maximum' END WHEN name = 'freeze_card' AND argument = 'last4' THEN CASE WHEN kind <> 'string' THEN 'type' END WHEN name IN ('list_cards', 'freeze_card', 'list_transactions') THEN 'unknown' END AS wrong, name || '.' || argument AS place FROM r),
w AS (SELECT *, CASE WHEN plain THEN '' WHEN spoken THEN 'tool-call output must not contain prose outside tool_call blocks' WHEN broken THEN 'assistant output is not parseable JSON' WHEN name = ' ' THEN 'tool call requires a function name' WHEN indexed THEN 'tool call indexes must be ordered from zero' WHEN name = 'pay' THEN 'unknown tool name: pay' WHEN wrong = 'unknown' THEN 'unsupported arguments for ' || name || ': [''' || argument || ''']' WHEN wrong = 'type' THEN 'invalid type for ' || place || ': expected ' || CASE argument WHEN 'limit' THEN '[''integer'']' ELSE '[''null'', ''string'']' END || ', got ' || kind WHEN wrong IS NOT NULL THEN 'value ' || CASE wrong WHEN 'minimum' THEN 'below minimum' ELSE 'above maximum' END || ' for ' || place ELSE '' END AS strict,
CASE WHEN plain THEN '' WHEN broken THEN 'model tool call is not valid JSON' WHEN name = ' ' THEN 'model tool call requires a function name' WHEN indexed THEN 'model tool-call indexes must be ordered from zero' WHEN name = 'pay' THEN 'model selected unsupported tool: pay' WHEN wrong = 'unknown' THEN 'model supplied unsupported arguments for ' || name WHEN wrong = 'type' THEN 'model supplied invalid type for ' || place WHEN wrong IS NOT NULL THEN 'model supplied value ' || CASE wrong WHEN 'minimum' THEN 'below minimum' ELSE 'above maximum' END || ' for ' || place ELSE '' END AS serving FROM v)
SELECT conv_id || '-' || turn AS record_id, strict AS wire_failure, CASE WHEN strict = '' AND NOT plain THEN name ELSE '' END AS wire_calls, serving AS serving_failure, CASE WHEN serving = '' AND NOT plain THEN name ELSE '' END AS serving_calls FROM w""")
def wire_outputs(df: DataFrame) -> DataFrame:
    """Outputs made of every turn's text through both parses."""
    rows = _raw(df).select(F.concat_ws("-", "conv_id", "turn").alias("record_id"), W.parsed_wire(F.col("raw")).alias("w"), W.parsed_serving(F.col("raw"), F.lit("t")).alias("s"))
    names = lambda c: F.array_join(F.transform(F.col(c)["calls"], lambda x: x["name"]), ",")
    return rows.select("record_id", F.coalesce("w.failure", F.lit("")).alias("wire_failure"), names("w").alias("wire_calls"), F.coalesce("s.failure", F.lit("")).alias("serving_failure"), names("s").alias("serving_calls"))


@query("conversations", """WITH a AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations),
s AS (SELECT *, CASE WHEN n % 11 = 4 THEN 'parse_error' WHEN k = m AND n % 2 = 0 THEN 'final_answer' WHEN k > 5 THEN 'max_tool_calls' WHEN n % 7 = 3 THEN 'unmatched_tool_call' WHEN k > m - conv_id % 3 THEN 'missing_canonical_tool_result' END AS stop FROM a WHERE k <= 6),
f AS (SELECT conv_id, min(k) FILTER (stop IS NOT NULL) AS halt, arg_min(stop, k) FILTER (stop IS NOT NULL) AS stop, max(k) AS last FROM s GROUP BY 1)
SELECT conv_id, coalesce(stop, 'max_tool_passes') AS stop_reason, (coalesce(halt - 1, last))::INT AS matched, (coalesce(CASE WHEN stop IN ('parse_error', 'final_answer') THEN halt - 1 ELSE halt END, last))::INT AS emitted, coalesce(halt, last)::INT AS passes FROM f""")
def trajectories(df: DataFrame) -> DataFrame:
    """A conversation is a run: each turn a pass that calls a tool with the turn's number, some broken, some of another number than was expected, some an answer; the last results may be missing."""
    n = F.char_length("text")
    whole = Window.partitionBy("conv_id")
    ends = F.col("turn") == F.max("turn").over(whole)
    number = F.lpad(F.col("turn").cast("string"), 4, "0")
    emitted = F.when(n % 7 == 3, "9999").otherwise(number)
    call = F.concat(F.lit('<tool_call>{"name": "freeze_card", "arguments": {"last4": "'), emitted, F.lit('"}'), F.when(n % 11 == 4, "").otherwise("}"), F.lit("</tool_call>"))
    raw = F.when(ends & (n % 2 == 0) & (n % 11 != 4), F.col("text")).otherwise(call)
    expected = F.struct(F.lit("freeze_card").alias("name"), F.concat(F.lit('{"last4":"'), number, F.lit('"}')).alias("arguments"))
    passes = df.select("conv_id", "turn", raw.alias("raw"), expected.alias("expected")).withColumn("p", W.parsed_wire(F.col("raw")))
    runs = passes.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "p", "expected"))).alias("x"))
    made = W.trajectory(F.transform("x", lambda r: r["p"]), F.transform("x", lambda r: r["expected"]), F.size("x") - (F.col("conv_id") % 3).cast("int"), 6, 5)
    return runs.select("conv_id", made.alias("t")).select("conv_id", "t.*")


@query("conversations", """WITH m AS (SELECT conv_id, turn, role, text, role || ':' || text AS line, role = 'assistant' AND turn % 3 <> 0 AS target FROM conversations),
c AS (SELECT conv_id, target, unnest(list_filter(string_split(line || chr(10), ''), lambda x: x <> '')) AS ch, generate_subscripts(list_filter(string_split(line || chr(10), ''), lambda x: x <> ''), 1) AS i, length(role) + 1 AS head, length(line) AS n FROM m),
t AS (SELECT conv_id, target AND i > head AND i <= n AS lab, least(255, greatest(3, ord(ch))) AS code FROM c)
SELECT conv_id, (count(*) - 1)::BIGINT AS n_tokens, count(*) FILTER (lab) AS n_labelled, (sum(code) - 10)::BIGINT AS id_sum, coalesce(sum(code) FILTER (lab), 0)::BIGINT AS label_sum FROM t GROUP BY 1""")
def label_masks(df: DataFrame) -> DataFrame:
    lists = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"), (F.col("turn") % 3 != 0).alias("loss")))).alias("m"))
    made = lists.select("conv_id", W.label_mask(F.col("m"), A.toy_tokens).alias("x"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    shown = F.filter("x.labels", lambda v: v != -100)
    return made.select("conv_id", F.size("x.input_ids").cast("long").alias("n_tokens"), F.size(shown).cast("long").alias("n_labelled"), total("x.input_ids").alias("id_sum"), total(shown).alias("label_sum"))


_LABELS = R.BANKING_LABELS + R.CONVERSATION_LABELS + R.OUTSIDE_LABELS + ["jokes", "movies"]
_LSQL = "[" + ", ".join(map(_q, _LABELS)) + "]"
_IN = lambda names: "(" + ", ".join(map(_q, names)) + ")"


@query("documents", f"""WITH d AS (SELECT doc_id, {_LSQL}[doc_id % {len(_LABELS)} + 1] AS label, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE ' t' || doc_id END AS t FROM documents), c AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM d))
SELECT doc_id, label, code::INT AS code, (label IN {_IN(R.BANKING_LABELS)} OR label IN {_IN(R.CONVERSATION_LABELS)})::INT AS domain_label, CASE WHEN label IN {_IN(R.BANKING_LABELS)} THEN 'clinc_supported_banking' WHEN label IN {_IN(R.CONVERSATION_LABELS)} THEN 'clinc_conversational_in_domain' WHEN label = 'oos' THEN 'clinc_oos' ELSE 'clinc_nonbanking' END AS example_kind FROM d JOIN c USING (label)""")
def label_domains(df: DataFrame) -> DataFrame:
    rows = df.select("doc_id", F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (F.col("doc_id") % len(_LABELS) + 1).cast("int")).alias("label"))
    return rows.join(R.intent_codes(rows, "label"), "label").select("doc_id", "label", "code", *R.label_domain(F.col("label")))


@query("documents", f"WITH d AS (SELECT doc_id, {_LSQL}[doc_id % {len(_LABELS)} + 1] AS label, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE ' t' || doc_id END AS t FROM documents) SELECT trim(t) AS current_text, 0 AS domain_label, 'clinc150|test|' || label || '|' || doc_id AS group_id FROM d WHERE label IN {_IN(R.OUTSIDE_LABELS)} AND trim(t) <> ''")
def external_rows(df: DataFrame) -> DataFrame:
    rows = df.select("doc_id", F.lit("test").alias("key"), F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (F.col("doc_id") % len(_LABELS) + 1).cast("int")).alias("label"), F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.concat(F.lit(" t"), "doc_id")).alias("t"))
    return R.external_rows(rows, "key", "doc_id", "t", "label")


_FAMILY = "CASE conv_id % 4 WHEN 0 THEN 'read_cards' WHEN 1 THEN 'faq_mortgage' WHEN 2 THEN '' ELSE 'backend_error' END"


@query("conversations", rf"""WITH {VISIBLE}, {CURRENT},
h AS (SELECT conv_id, CASE WHEN conv_id % 6 = 0 THEN 'When was that created?' ELSE current END AS current, EXISTS (SELECT 1 FROM vis v WHERE v.conv_id = cur.conv_id AND v.turn < ct) AS hist FROM cur),
w AS (SELECT *, list_distinct(list_filter(string_split({NORM_B.replace('text', 'current')}, ' '), lambda x: x <> '')) AS w, {_PATH_SQL}[conv_id % 7 + 1] AS path, {_FAMILY} AS family, CASE WHEN conv_id % 5 = 0 THEN 'freeze_card' ELSE '' END AS tool FROM h),
r AS (SELECT *, lower(family || ' ' || current || ' ' || tool) AS t, hist AND (len(w) <= 6 OR list_has_any(w, ['it','that','this','those','them','one','again','there'])) AS a, list_has_any(w, ['no','not','wrong','instead','asked']) AS b, hist AND list_has_any(w, ['yes','yeah','yep','4821','that','one']) AND len(w) <= 6 AS c FROM w WHERE {NORM_B.replace('text', 'current')} <> 'when was that created')
SELECT conv_id AS record_id, current || CASE conv_id % 3 WHEN 1 THEN ', please' WHEN 2 THEN ', thanks' ELSE '' END AS current_text, (path <> 'ood')::INT AS domain_label,
CASE WHEN path NOT IN ('ood', 'hard_negative') THEN CASE WHEN contains(t, 'account') OR contains(t, 'balance') THEN 'accounts' WHEN contains(t, 'freeze_card') OR contains(t, 'replace_card') OR contains(t, 'stolen') THEN 'card_actions' WHEN contains(t, 'card') THEN 'cards' WHEN contains(t, 'transaction') OR contains(t, 'dispute') OR contains(t, 'purchase') THEN 'transactions' WHEN contains(t, 'transfer') THEN 'transfers' WHEN contains(t, 'case') OR contains(t, 'address') THEN 'service_cases' WHEN contains(t, 'faq') OR contains(t, 'mortgage') OR contains(t, 'open ') THEN 'faq' ELSE 'conversation' END END AS capability,
a::INT || ',' || b::INT || ',' || c::INT || ',0' AS relation_labels, CASE WHEN b THEN 'agent_repair' WHEN c THEN 'clarification_answer' WHEN a THEN 'contextual_followup' WHEN hist THEN 'visible_multiturn' ELSE path END AS example_kind, CASE WHEN family = '' THEN path ELSE family || '|' || path END AS group_id FROM r""")
def router_rows(df: DataFrame) -> DataFrame:
    cid = F.col("conv_id")
    turns = M._with_current(df)
    is_now = (F.col("turn") == F.col("current_turn")) & (F.col("role") == "user")
    now = turns.groupBy("conv_id").agg(F.max(F.when(is_now, F.col("text"))).alias("current"), F.coalesce(F.max(F.col("turn") < F.col("current_turn")), F.lit(False)).alias("has_history")).where("current IS NOT NULL")
    now = now.withColumn("current", F.when(cid % 6 == 0, "When was that created?").otherwise(F.col("current")))
    family = F.when(cid % 4 == 0, "read_cards").when(cid % 4 == 1, "faq_mortgage").when(cid % 4 == 2, "").otherwise("backend_error")
    split = F.when(cid % 3 == 1, "validation").when(cid % 3 == 2, "test").otherwise("train")
    rows = now.select(cid.alias("record_id"), "current", "has_history", *M.relations(), F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (cid % 7 + 1).cast("int")).alias("path"), family.alias("family"), F.when(cid % 5 == 0, F.array(F.lit("freeze_card"))).otherwise(F.array().cast("array<string>")).alias("tools"), split.alias("split"))
    return R.assembled(rows).withColumn("relation_labels", F.array_join("relation_labels", ","))


_STUBS = "CASE cap " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in R.STUBS.items()) + " END"


@query("labels", f"WITH a AS (SELECT doc_id, 'row ' || doc_id AS current, {list(R.STUBS)}[doc_id % 8 + 1] AS cap FROM labels) SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'user:before' ELSE 'user:' || current || '|assistant:' || {_STUBS} END AS history FROM a")
def anchor_histories(df: DataFrame) -> DataFrame:
    pairs = "array<struct<role:string,content:string>>"
    own = F.when(F.col("doc_id") % 3 == 0, F.array(F.struct(F.lit("user").alias("role"), F.lit("before").alias("content")))).otherwise(F.array().cast(pairs))
    cap = F.element_at(F.array(*[F.lit(k) for k in R.STUBS]), (F.col("doc_id") % 8 + 1).cast("int"))
    made = R.history_of(own, F.concat(F.lit("row "), "doc_id"), cap)
    return df.select("doc_id", F.array_join(W.plain_lines(made), "|").alias("history"))


_CALLS = ", ".join(f"({i}, {_q(t)}, {ok}, {_q(a)}, {c})" for i, (t, _, ok, a, c) in enumerate(B.SESSION))


@query("customer", f"SELECT sha256(c_custkey || chr(0) || 's') AS session, k::BIGINT AS seq, tool, ok, answer, cases FROM customer CROSS JOIN (VALUES {_CALLS}) v(k, tool, ok, answer, cases)")
def bank_sessions(df: DataFrame) -> DataFrame:
    """The same calls by every customer; each answer is stated by hand."""
    calls = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("seq"), F.lit(t).alias("tool"), F.lit(a).alias("arguments")) for i, (t, a, *_) in enumerate(B.SESSION)]))
    rows = df.select(B.session_key(F.col("c_custkey"), F.lit("s")).alias("session"), calls.alias("c")).select("session", "c.*")
    return B.executed(rows, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


@query("labels", f"SELECT doc_id, CASE WHEN {P} >= 0.2 THEN ['accounts', 'cards', 'faq'][doc_id % 3 + 1] END AS capability, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE '' END AS active FROM labels")
def projected_routes(df: DataFrame) -> DataFrame:
    """Capability of accepted rows alone, and the relations that are over their threshold."""
    from .catalog import _scores

    cap = F.element_at(F.array(F.lit("accounts"), F.lit("cards"), F.lit("faq")), (F.col("doc_id") % 3 + 1).cast("int"))
    scores = F.array(F.struct(F.lit("a").alias("name"), F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.1).alias("p")))
    return df.select("doc_id", F.when(_scores(df) >= 0.2, cap).alias("capability"), F.array_join(F.transform(F.filter(scores, lambda s: s["p"] >= 0.5), lambda s: s["name"]), ",").alias("active"))

"""Registered queries of the runtime operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import measures as A
from ..operators import runtime as R
from ..operators import scoring as S
from ..operators import state as B
from ..operators import validation as V
from ..operators import wire as W
from .catalog import CURRENT, STRIP, VISIBLE, P, Q, _scores, query
from .trained import stored_messages

_CAPS = ["accounts", "cards", "faq"]
_RELATIONS = ["context_dependent", "agent_repair"]


def _hashed_model(text: Column) -> Column:
    """Stands for a model: probabilities read off the text's digest."""
    part = lambda i: F.conv(F.substring(F.sha2(text, 256), 8 * i + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return F.struct(part(0), F.array(part(1), part(2), part(3)), F.array(part(4), part(5)))


_PART = lambda i: f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE"


@query("conversations", f"""WITH {VISIBLE}, {CURRENT},
seq AS (SELECT v.*, ct, lag(role) OVER w AS pr, lag(text) OVER w AS pt FROM vis v JOIN cur USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
ex AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, '[PREVIOUS_ASSISTANT]' || chr(10) || text || chr(10) || '[PREVIOUS_USER]' || chr(10) || pt AS said FROM seq WHERE role = 'assistant' AND pr = 'user' AND turn < ct),
r AS (SELECT conv_id, current, '[CURRENT_USER]' || chr(10) || current || coalesce((SELECT chr(10) || string_agg(said, chr(10) ORDER BY n) FROM ex WHERE ex.conv_id = cur.conv_id AND n <= 3), '') AS text FROM cur),
p AS (SELECT conv_id, sha256(text) AS h FROM r), s AS (SELECT conv_id, {_PART(0)} AS d, [{_PART(1)}, {_PART(2)}, {_PART(3)}] AS c, {_PART(4)} AS r0, {_PART(5)} AS r1 FROM p),
t AS (SELECT *, CASE WHEN d >= 0.5 THEN 'in_domain' WHEN d < 0.2 AND r0 < 0.4 THEN 'out_of_domain' ELSE 'uncertain' END AS route, list_extract(['accounts', 'cards', 'faq'], CASE WHEN c[1] >= c[2] AND c[1] >= c[3] THEN 1 WHEN c[2] >= c[3] THEN 2 ELSE 3 END) AS best FROM s)
SELECT conv_id, route, CASE WHEN route = 'in_domain' THEN best END AS capability, best || ':' || printf('%.3f', list_max(c)) AS first_candidate, concat_ws(',', CASE WHEN r0 >= 0.3 THEN 'context_dependent' END, CASE WHEN r1 >= 0.6 THEN 'agent_repair' END) AS relations, NULL::VARCHAR AS failure FROM t
UNION ALL SELECT DISTINCT conv_id, NULL, NULL, NULL, NULL, '{R.NO_USER}' FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM cur)""")
def classified_turns(df: DataFrame) -> DataFrame:
    made = R.classified(df, _hashed_model, _CAPS, _RELATIONS, [0.3, 0.6], "context_dependent", 0.2, 0.5, 0.4)
    first = F.col("candidates")[0]
    return made.select("conv_id", "route", "capability", F.concat(first["capability"], F.lit(":"), F.format_string("%.3f", first["probability"])).alias("first_candidate"), F.array_join("relations", ",").alias("relations"), "failure")


@query("conversations", f"""WITH u AS (SELECT conv_id, turn, {STRIP} AS text, text AS raw, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user'),
b AS (SELECT a.conv_id, a.raw AS current_text, a.text AS t, b.raw AS previous_user, b.text AS p FROM u a LEFT JOIN u b ON b.conv_id = a.conv_id AND b.n = 2 WHERE a.n = 1)
SELECT conv_id, sha256('[CURRENT]' || chr(10) || t || CASE WHEN coalesce(p, '') <> '' THEN chr(10) || '[PREVIOUS_USER]' || chr(10) || p ELSE '' END) AS text_key, previous_user IS NOT NULL AS has_previous, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 1 END AS domain_label, CASE WHEN conv_id % 3 = 0 THEN -100 ELSE conv_id % 5 END AS intent_label, CASE WHEN conv_id % 3 <> 0 THEN 'intent ' || conv_id % 5 END AS intent, CASE WHEN previous_user IS NULL THEN 'single' ELSE 'transition' END AS example_kind, 'oos' AS source_label FROM b""")
def first_router_rows(df: DataFrame) -> DataFrame:
    """The last user text of every conversation as a whole row of the first router's set."""
    c = F.col("conv_id")
    users = df.where("role = 'user'").groupBy("conv_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("turn", "text")), False), 1, 2).alias("two"))
    now, before = F.get("two", F.lit(0))["text"], F.get("two", F.lit(1))["text"]
    outside = c % 3 == 0
    row = R.first_router_example(now, before, F.when(outside, 0).otherwise(1), F.when(outside, -100).otherwise(c % 5), F.when(~outside, F.concat(F.lit("intent "), (c % 5).cast("string"))), F.when(before.isNull(), "single").otherwise("transition"), F.lit("own"), F.lit("train"), F.lit("oos"), F.lit("cc-by"))
    rows = users.select("conv_id", row.alias("r"))
    return rows.select("conv_id", F.sha2("r.text", 256).alias("text_key"), F.col("r.previous_user").isNotNull().alias("has_previous"), "r.domain_label", "r.intent_label", "r.intent", "r.example_kind", "r.source_label")


_MODEL = {"name": "m", "revision": "r1", "router_revision": "r2", "commit": "unavailable"}


@query("conversations", rf"""WITH t AS (SELECT conv_id, turn, role, text, 'call_' || conv_id || '_' || turn AS id FROM conversations),
g AS (SELECT conv_id, count(*) AS n, arg_max(text, turn) AS said, coalesce(string_agg('- `' || id || '` `list_cards` `{{"turn": ' || turn || '}}`', chr(10) ORDER BY turn) FILTER (role = 'user'), '- None') AS called, coalesce(string_agg('- `pass ' || turn || '`: input tokens `' || length(text) || '`, prompt SHA-256 `' || sha256(text) || '`, output characters `' || turn || '`, raw output SHA-256 `' || sha256(role) || '`', chr(10) ORDER BY turn) FILTER (turn > 4), '- None; the generator was not invoked.') AS ran, count(*) FILTER (turn > 4) AS passes FROM t GROUP BY 1),
u AS (SELECT conv_id, id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM t WHERE role = 'user'), a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM t WHERE role = 'assistant'),
r AS (SELECT conv_id, string_agg('- `' || id || '` `list_cards`: ' || CASE WHEN turn % 3 = 1 THEN 'success' WHEN turn % 3 = 0 THEN 'error (`backend_error`)' ELSE 'error' END, chr(10) ORDER BY k) AS told FROM u JOIN a USING (conv_id, k) GROUP BY 1)
SELECT conv_id, sha256('### Experiment diagnostics' || chr(10) || chr(10) || '- Route: `' || CASE WHEN conv_id % 2 = 0 THEN 'in_domain' ELSE 'None' END || '`' || chr(10) || '- In-domain probability: `0.5`' || chr(10) || '- OOD probability: `None`' || chr(10) || '- Conversation context applied: `' || CASE WHEN n > 2 THEN 'true' ELSE 'false' END || '`' || chr(10) || '- Relation probabilities: `{{}}`' || chr(10) || '- Router reason: `not provided`' || chr(10) || '- Router failure type: `none`' || chr(10) || '- Response path: `faq`' || chr(10) || chr(10)
|| '**Diagnostic servicing capabilities**' || chr(10) || CASE WHEN conv_id % 2 = 0 THEN '- `cards`: 0.750' || chr(10) || '- `faq`: 0.125' ELSE '- None' END || chr(10) || chr(10) || '**Tool calls**' || chr(10) || called || chr(10) || chr(10) || '**Tool results**' || chr(10) || coalesce(told, '- None') || chr(10) || chr(10) || '**Generation provenance**' || chr(10) || ran || chr(10) || chr(10)
|| '- Generation calls: `' || passes || '`' || chr(10) || '- Model: `m`' || chr(10) || '- Exact model revision: `r1`' || chr(10) || '- Exact router revision: `r2`' || chr(10) || '- Commit: `unavailable`' || chr(10) || '- Visible response SHA-256: `' || sha256(said) || '`') AS shown FROM g LEFT JOIN r USING (conv_id)""")
def shown_diagnostics(df: DataFrame) -> DataFrame:
    """User turns stand for calls, answers for results: a question without an answer is shown as a call alone."""
    turn = F.col("turn")
    call = F.struct(F.concat_ws("_", F.lit("call"), "conv_id", "turn").alias("id"), F.lit("list_cards").alias("name"), F.concat(F.lit('{"turn": '), turn.cast("string"), F.lit("}")).alias("arguments"))
    result = F.struct((turn % 3 == 1).alias("ok"), F.when(turn % 3 == 0, "backend_error").alias("code"))
    ran = F.struct(F.concat(F.lit("pass "), turn.cast("string")).alias("label"), F.char_length("text").alias("input_tokens"), F.sha2("text", 256).alias("prompt_sha256"), turn.alias("output_chars"), F.sha2("role", 256).alias("output_sha256"))
    ordered = lambda when, x: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("turn", x.alias("x"))))), lambda y: y["x"])
    rows = df.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("text", "turn").alias("said"), ordered(F.col("role") == "user", call).alias("calls"), ordered(F.col("role") == "assistant", result).alias("results"), ordered(turn > 4, ran).alias("passes"))
    inside = F.col("conv_id") % 2 == 0
    pair = lambda name, p: F.struct(F.lit(name).alias("capability"), F.lit(p).alias("probability"))
    none = F.lit(None).cast("string")
    found = {"route": F.when(inside, "in_domain"), "in_domain": F.lit(0.5), "ood": none, "context_applied": F.col("n") > 2, "relations": F.lit("{}"), "reason": none, "failure_type": none, "response_path": F.lit("faq"), "candidates": F.when(inside, F.array(pair("cards", 0.75), pair("faq", 0.125)))}
    return rows.select("conv_id", F.sha2(R.diagnostics(found, F.col("calls"), F.col("results"), F.col("passes"), F.col("said"), _MODEL), 256).alias("shown"))


@query("conversations", rf"""WITH h AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'case' WHEN 1 THEN 'card' ELSE 'none' END AS kind, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'please' ELSE 'now' END AS suffix, 'f' || turn || CASE WHEN turn % 2 = 0 THEN '=v=' || conv_id ELSE '' END AS fact FROM conversations)
SELECT conv_id, turn, CASE kind WHEN 'case' THEN 'user:' || trim('{R.CASE_ASKED} ' || suffix) || '.|assistant:{R.CASE_TOLD}' WHEN 'card' THEN 'user:' || trim('{R.CARD_ASKED} ' || suffix) || '.|assistant:{R.CARD_TOLD}' ELSE '' END AS history, CASE WHEN turn % 2 = 0 THEN 'f' || turn END AS key, CASE WHEN turn % 2 = 0 THEN 'v=' || conv_id ELSE 'f' || turn END AS value FROM h""")
def context_histories(df: DataFrame) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    made = R.context_history(F.when(c % 3 == 0, "case").when(c % 3 == 1, "card").otherwise("none"), F.when(t % 3 == 0, "").when(t % 3 == 1, "please").otherwise("now"))
    fact = R.key_value(F.concat(F.lit("f"), t.cast("string"), F.when(t % 2 == 0, F.concat(F.lit("=v="), c.cast("string"))).otherwise("")))
    return df.select("conv_id", "turn", F.array_join(F.transform(made, lambda m: F.concat_ws(":", m["role"], m["content"])), "|").alias("history"), fact["key"].alias("key"), fact["value"].alias("value"))


@query("", """WITH r AS (SELECT c_custkey AS request_id, c_custkey AS owner, CASE WHEN c_custkey % 4 IN (1, 3) THEN CASE WHEN c_custkey % 8 = 1 THEN -1 ELSE (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) END END AS wanted_id, CASE WHEN c_custkey % 4 IN (2, 3) THEN '5-low' END AS wanted_text FROM customer),
n AS (SELECT o_custkey AS owner, count(*) AS n, min(o_orderkey) AS id FROM orders WHERE o_orderstatus = 'O' AND lower(o_orderpriority) = '5-low' GROUP BY 1),
l AS (SELECT o_custkey AS owner, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT request_id, CASE WHEN wanted_id IS NOT NULL AND wanted_text IS NOT NULL THEN NULL WHEN wanted_id IS NOT NULL THEN o.o_orderkey WHEN wanted_text IS NOT NULL THEN CASE WHEN n.n = 1 THEN n.id END ELSE l.id END AS order_id,
CASE WHEN wanted_id IS NOT NULL AND wanted_text IS NOT NULL THEN 'select a order by ID or priority, not both' WHEN wanted_id IS NOT NULL THEN CASE WHEN o.o_orderkey IS NULL THEN 'no matching synthetic order' END WHEN wanted_text IS NOT NULL THEN CASE WHEN coalesce(n.n, 0) <> 1 THEN 'expected exactly one matching synthetic order; found ' || coalesce(n.n, 0) END WHEN l.id IS NULL THEN 'no matching synthetic order' END AS failure
FROM r LEFT JOIN orders o ON o.o_orderkey = wanted_id AND o.o_custkey = r.owner LEFT JOIN n ON n.owner = r.owner LEFT JOIN l ON l.owner = r.owner""")
def selected_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders stand for a customer's transactions: selected by id, by priority, by both or by neither."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("order_id"), "o_orderpriority", "o_orderdate", "o_orderstatus")
    first = orders.groupBy("owner").agg(F.min("order_id").alias("first"))
    c = F.col("c_custkey")
    requests = spark.read.parquet(f"{d}/customer.parquet").select(c.alias("request_id"), c.alias("owner")).join(first, "owner", "left")
    k = F.col("request_id") % 4
    requests = requests.select("request_id", "owner", F.when(k.isin(1, 3), F.when(F.col("request_id") % 8 == 1, -1).otherwise(F.col("first"))).alias("wanted_id"), F.when(k.isin(2, 3), "5-LOW").alias("wanted_text"))
    return B.selected(requests, orders, "owner", "order_id", "o_orderpriority", "o_orderdate", F.col("o_orderstatus") == "O", "order", "priority")


@query("labels", f"""WITH r AS (SELECT 'context_dependent' AS relation, {P} AS p, quality = 1 AS y, 0.005::DOUBLE AS slack FROM labels UNION ALL SELECT 'agent_repair', {Q}, toxic = 1, 1e-12 FROM labels UNION ALL SELECT 'topic_shift', {Q}, quality = 1, 1e-12 FROM labels),
f AS (SELECT relation, t / 20.0::DOUBLE AS threshold, slack, coalesce(2 * count(*) FILTER (p >= t / 20.0::DOUBLE AND y)::DOUBLE / nullif(count(*) FILTER (p >= t / 20.0::DOUBLE) + count(*) FILTER (y), 0), 0) AS f1 FROM r, range(1, 20) g(t) GROUP BY ALL),
b AS (SELECT relation, max(f1) AS best_f1 FROM f GROUP BY 1)
SELECT relation, min(threshold) AS threshold, best_f1 FROM f JOIN b USING (relation) WHERE f1 >= best_f1 - slack GROUP BY relation, best_f1""")
def relation_thresholds(df: DataFrame) -> DataFrame:
    return S.relation_thresholds(df, {"context_dependent": (_scores(df), F.col("quality"), 0.005), "agent_repair": (_scores(df, 104729), F.col("toxic"), 0.0), "topic_shift": (_scores(df, 104729), F.col("quality"), 0.0)})


@query("labels", f"""WITH r AS (SELECT {P} AS p, quality = 1 AS y, doc_id % 4 = 1 AS k FROM labels),
t AS (SELECT i / 200.0::DOUBLE AS threshold, coalesce(count(*) FILTER (y AND p >= i / 200.0::DOUBLE)::DOUBLE / nullif(count(*) FILTER (y), 0), 0) AS recall, CASE WHEN count(*) FILTER (k) = 0 THEN 1 ELSE coalesce(count(*) FILTER (k AND y AND p >= i / 200.0::DOUBLE)::DOUBLE / nullif(count(*) FILTER (k AND y), 0), 0) END AS kind_recall, coalesce(count(*) FILTER (NOT y AND p < i / 200.0::DOUBLE)::DOUBLE / nullif(count(*) FILTER (NOT y), 0), 0) AS specificity FROM r, range(1, 200) g(i) GROUP BY i)
SELECT threshold, recall, kind_recall, specificity, (recall + specificity) / 2 AS balanced_accuracy FROM t ORDER BY (recall >= 0.8 AND kind_recall >= 0.85) DESC, specificity DESC, balanced_accuracy DESC, threshold DESC LIMIT 1""")
def kind_threshold(df: DataFrame) -> DataFrame:
    return S.kind_threshold(df.select(_scores(df).alias("p"), "quality", (F.col("doc_id") % 4 == 1).alias("k")), "p", "quality", F.col("k"), 0.8, 0.85)


@query("embeddings", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS l, list_transform(embedding::DOUBLE[], lambda x, i: x + ((vec_id + i - 1) % 5) * 0.001::DOUBLE) AS r FROM embeddings), g AS (SELECT list_position(l, list_max(l)) = list_position(r, list_max(r)) AS same, list_max(list_transform(range(1, len(l) + 1), lambda i: abs(l[i] - r[i]))) AS gap, list_transform(l[1:4], lambda x: floor(x * 10)) = list_transform(r[1:4], lambda x: floor(x * 10)) AS equal FROM v) SELECT true AS finite, bool_and(equal) AS generation_equal, round(count(*) FILTER (same)::DOUBLE / count(*), 9) AS argmax_agreement, round(max(gap), 9) AS max_diff, bool_and(equal) AND count(*) FILTER (same)::DOUBLE / count(*) >= 0.9 AND max(gap) <= 0.3 AS passed FROM g")
def reload_parity(df: DataFrame) -> DataFrame:
    """Vectors stand for scores, the first four entries in tenths for generated tokens."""
    wide = F.col("embedding").cast("array<double>")
    rows = df.select(wide.alias("l"), F.transform(wide, lambda x, i: x + F.pmod(F.col("vec_id") + i, F.lit(5)) * F.lit(0.001)).alias("r"))
    tokens = lambda c: F.transform(F.slice(c, 1, 4), lambda x: F.floor(x * 10))
    out = A.reload_parity(rows.select("l", "r", tokens("l").alias("a"), tokens("r").alias("b")), "l", "r", "a", "b", least_agreement=0.9)
    return out.select("finite", "generation_equal", F.round("argmax_agreement", 9).alias("argmax_agreement"), F.round("max_diff", 9).alias("max_diff"), "passed")


@query("conversations", r"""WITH c AS (SELECT conv_id, turn, role, CASE WHEN turn % 4 = 3 THEN '   ' WHEN turn % 4 = 2 THEN '  ' || text || chr(10) ELSE text END AS text FROM conversations),
k AS (SELECT conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS said FROM c WHERE role IN ('user', 'assistant') AND trim(text) <> ''),
n AS (SELECT conv_id, string_agg(role || ':' || said, '|' ORDER BY turn) AS x, count(*) AS n FROM k GROUP BY 1) SELECT conv_id, sha256(coalesce(x, '')) AS kept_key, coalesce(n, 0)::INT AS n_kept FROM (SELECT DISTINCT conv_id FROM c) LEFT JOIN n USING (conv_id)""")
def canonical_turns(df: DataFrame) -> DataFrame:
    """Some texts are blanked, some padded; systems' texts don't go on."""
    text = F.when(F.col("turn") % 4 == 3, "   ").when(F.col("turn") % 4 == 2, F.concat(F.lit("  "), "text", F.lit("\n"))).otherwise(F.col("text"))
    none = lambda kind: F.lit(None).cast(kind)
    m = F.struct("turn", F.struct("role", text.alias("content"), none("array<string>").alias("tool_calls"), none("string").alias("tool_call_id"), none("string").alias("name")).alias("m"))
    lists = df.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(m)), lambda x: x["m"]).alias("m"))
    kept = V.canonical_conversation(F.col("m"))
    return lists.select("conv_id", F.sha2(F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["role"], x["content"])), "|"), 256).alias("kept_key"), F.size(kept).alias("n_kept"))


@query("conversations", """WITH r AS (SELECT row_number() OVER (ORDER BY conv_id, turn, sha256(role || chr(0) || text)) - 1 AS o, sha256(role || chr(0) || text) AS d FROM conversations WHERE role = 'assistant'), a AS (SELECT o // 1000 AS o, sha256(string_agg(d, '' ORDER BY o)) AS d FROM r GROUP BY o // 1000)
SELECT CASE WHEN count(*) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY o)) END AS digest, (SELECT count(*) FROM r) AS n_rows FROM a""")
def response_fingerprint(df: DataFrame) -> DataFrame:
    """All answers in their order."""
    return A.ordered_digest(df.where("role = 'assistant'"), [F.asc("conv_id"), F.asc("turn")], F.sha2(F.concat_ws("\0", "role", "text"), 256))


@query("conversations", """SELECT conv_id, turn, 'call_' || conv_id || '_' || turn AS id, 'dispute_transaction:' || substr(text, 1, 24) AS parsed, '{"ok":true,"turn":' || turn || '}' AS told FROM conversations WHERE role = 'assistant' AND (conv_id + turn) % 4 = 1""")
def call_round_trips(df: DataFrame) -> DataFrame:
    """Calls rendered as a model writes them, parsed again, and the message of their result."""
    messages = stored_messages(df).select("conv_id", F.explode("messages").alias("m")).where("size(m.tool_calls) > 0").select("conv_id", F.explode("m.tool_calls").alias("c"))
    flat = F.struct(F.col("c.id").alias("id"), F.col("c.index").alias("index"), F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments"))
    turn = F.substring_index("c.id", "_", -1).cast("long")
    rows = messages.select("conv_id", turn.alias("turn"), flat.alias("flat")).withColumn("read", W.parsed_serving(W.tagged(F.array("flat")), F.lit("t")))
    call = F.col("read.calls")[0]
    result = W.rendered_result(call, F.concat(F.lit('{"ok":true,"turn":'), F.col("turn").cast("string"), F.lit("}")))
    made = W.rendered_calls(F.col("read.calls"))["tool_calls"][0]
    return rows.select("conv_id", "turn", result["tool_call_id"].alias("id"), F.concat_ws(":", made["function"]["name"], F.get_json_object(made["function"]["arguments"], "$.description")).alias("parsed"), result["content"].alias("told"))

"""Registered queries over ``operators.realization``, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import measures as A
from ..operators import realization as R
from ..operators import scoring as S
from .catalog import P, Q, _scores, query


def _record(df: DataFrame) -> DataFrame:
    """Conversations as records: messages in order; every seventh turn of an assistant has a call."""
    calls = F.when((F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 7 == 0), F.concat(F.lit('[{"name":"list_cards","turn":'), F.col("turn").cast("string"), F.lit("}]")))
    one = F.struct("turn", F.coalesce("text", F.lit("")).alias("content"), F.col("role").alias("role"), calls.alias("tool_calls"))
    return df.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("messages")).withColumn("record_id", F.concat(F.lit("rec-"), "conv_id"))


_MESSAGES = """m AS (SELECT conv_id, turn, role, coalesce(text, '') AS content, CASE WHEN role = 'assistant' AND (conv_id + turn) % 7 = 0 THEN '[{"name":"list_cards","turn":' || turn || '}]' END AS calls FROM conversations)"""
_HASHED = """SELECT conv_id, 'sha256:' || sha256('{"expected":null,"messages_except_final_assistant":[' || coalesce(string_agg('{"content":' || to_json(content)::VARCHAR || ',"role":"' || role || '"' || CASE WHEN calls IS NULL THEN '' ELSE ',"tool_calls":' || calls END || '}', ',' ORDER BY turn) FILTER (keeps), '') || '],"record_id":"rec-' || conv_id || '","schema_version":"v1","split_keys":{"n":' || conv_id || '},"validation":{"replay_hash":null,"tool_manifest_hash":"sha256:m"}}') AS immutable_hash, count(*) FILTER (keeps) AS n_immutable FROM k GROUP BY conv_id"""


@query("conversations", f"""WITH {_MESSAGES},
k AS (SELECT *, turn IS DISTINCT FROM max(turn) FILTER (role = 'user') OVER w AND turn IS DISTINCT FROM max(turn) FILTER (role = 'assistant' AND calls IS NULL) OVER w AS keeps FROM m WINDOW w AS (PARTITION BY conv_id))
{_HASHED}""")
def immutable_records(df: DataFrame) -> DataFrame:
    rows = _record(df)
    digest = R.immutable_hash(F.col("messages"), F.col("record_id"), F.lit("v1"), F.lit(None).cast("string"), F.concat(F.lit('{"n":'), F.col("conv_id").cast("string"), F.lit("}")), F.lit("sha256:m"), F.lit(None).cast("string"))
    return rows.select("conv_id", digest.alias("immutable_hash"), F.size(R.immutable_messages(F.col("messages"))).cast("long").alias("n_immutable"))


@query("conversations", """WITH e AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, length(text) AS size FROM conversations WHERE role = 'assistant' AND conv_id % 5 > 0),
h AS (SELECT conv_id, count(*) AS n_calls, 'sha256:' || sha256('[' || string_agg('{"content":' || CASE WHEN size % 3 = 0 THEN '{"error":{"code":"backend_error","message":"Not \\"found\\"."},"ok":false}' ELSE '{"ok":true,"result":{"size":' || size || '}}' END || ',"name":"list_cards","tool_call_id":"call_rec-' || conv_id || '_' || n || '"}', ',' ORDER BY n) || ']') AS replay_hash FROM e GROUP BY conv_id)
SELECT conv_id, coalesce(n_calls, 0) AS n_calls, coalesce(replay_hash, 'sha256:' || sha256('[]')) AS replay_hash, CASE WHEN n_calls > 0 THEN 'sha256:' || sha256('{"calls":' || n_calls || '}') END AS final_state_hash FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN h USING (conv_id)""")
def replay_hashes(df: DataFrame) -> DataFrame:
    """Answers stand for the results of calls; every fifth conversation has none."""
    size = F.when((F.col("role") == "assistant") & (F.col("conv_id") % 5 > 0), F.struct("turn", F.length("text").alias("size")))
    rows = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(size)).alias("results"))
    ids = R.call_ids(F.concat(F.lit("rec-"), "conv_id"), F.size("results"))
    shown = lambda r: R.envelope(F.concat(F.lit('{"size":'), r["size"].cast("string"), F.lit("}")), F.when(r["size"] % 3 == 0, 'Not "found".'))
    events = F.zip_with(ids, "results", lambda i, r: F.struct(i.alias("tool_call_id"), F.lit("list_cards").alias("name"), shown(r).alias("content")))
    rows = rows.select("conv_id", events.alias("events"))
    return rows.select("conv_id", F.size("events").cast("long").alias("n_calls"), R.replay_hash(F.col("events")).alias("replay_hash"), R.final_state_hash(F.col("events"), F.concat(F.lit('{"calls":'), F.size("events").cast("string"), F.lit("}"))).alias("final_state_hash"))


@query("conversations", r"""SELECT conv_id, count(*) FILTER (shown) AS n_shown, coalesce(string_agg(role || ':' || sha256(said), ',' ORDER BY turn) FILTER (shown), '') AS shown FROM (SELECT conv_id, turn, part AS role, said, part IN ('user', 'assistant') AND NOT regexp_full_match(said, '\s*') AS shown FROM (SELECT *, CASE WHEN turn % 5 = 4 THEN 'tool' ELSE role END AS part, CASE WHEN turn % 7 = 3 THEN E' \n' ELSE coalesce(text, '') END AS said FROM conversations)) GROUP BY conv_id""")
def shown_history(df: DataFrame) -> DataFrame:
    """Some turns are made a tool's or blank here."""
    part = F.when(F.col("turn") % 5 == 4, "tool").otherwise(F.col("role"))
    said = F.when(F.col("turn") % 7 == 3, " \n").otherwise(F.coalesce("text", F.lit("")))
    rows = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("role"), said.alias("content")))).alias("messages")).select("conv_id", R.visible_history(F.col("messages")).alias("h"))
    return rows.select("conv_id", F.size("h").cast("long").alias("n_shown"), F.array_join(F.transform("h", lambda m: F.concat_ws(":", m["role"], F.sha2(m["content"], 256))), ",").alias("shown"))


_TEXT_SQL = R.TEACHER_TEXT.replace("'", "''")


@query("conversations", f"""WITH r AS (SELECT 'rec-' || conv_id || '-' || turn AS record_id, conv_id, text FROM conversations WHERE role = 'user')
SELECT record_id, 'sha256:' || sha256('{R.TEACHER_VERSION}') AS prompt_version, sha256('{_TEXT_SQL}' || '{{"allowed_edits": ["user_content", "final_response"], "final_response": "Caf\\u00e9 \\"4821\\" is frozen.", "immutable_fields": ' || CASE WHEN conv_id % 2 = 0 THEN '["messages", "tools"]' ELSE '[]' END || ', "immutable_hash": "sha256:' || sha256(text) || '", "record_id": "' || record_id || '", "user_content": ' || array_to_string(list_transform(string_split(to_json(text)::VARCHAR, ''), lambda c: CASE WHEN unicode(c) < 128 THEN c ELSE printf('\\u%04x', unicode(c)) END), '') || '}}') AS prompt_key FROM r""")
def teacher_prompts(df: DataFrame) -> DataFrame:
    rid = F.concat_ws("-", F.lit("rec"), "conv_id", "turn")
    fields = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("messages"), F.lit("tools"))).otherwise(F.array().cast("array<string>"))
    prompt = R.teacher_prompt(rid, F.concat(F.lit("sha256:"), F.sha2("text", 256)), F.col("text"), F.lit('Café "4821" is frozen.'), fields)
    return df.where("role = 'user'").select(rid.alias("record_id"), R.prompt_version().alias("prompt_version"), F.sha2(prompt, 256).alias("prompt_key"))


@query("conversations", r"""WITH r AS (SELECT conv_id, turn, regexp_replace(CASE conv_id % 4 WHEN 0 THEN ' please ' ELSE '' END || text, '^\s+|\s+$', '', 'g') AS u, CASE turn % 3 WHEN 0 THEN 'Done. Frozen.' WHEN 1 THEN ' Here is the list. ' ELSE 'Frozen.' END AS f FROM conversations WHERE role = 'user')
SELECT conv_id, turn, sha256(CASE WHEN regexp_matches(lower(u), '^(please|can you|could you)') THEN u ELSE ['Please', 'Can you', 'Could you'][('0x' || substr(sha256('7:rec-' || conv_id || '-' || turn), 1, 12))::BIGINT % 3 + 1] || ' ' || lower(u[1]) || u[2:] END) AS user_key, CASE WHEN regexp_matches(lower(trim(f)), '^(done\.|i checked|here is)') THEN trim(f) ELSE 'I checked the banking result. ' || trim(f) END AS final_response FROM r""")
def rehearsed_answers(df: DataFrame) -> DataFrame:
    rid = F.concat_ws("-", F.lit("rec"), "conv_id", "turn")
    final = F.when(F.col("turn") % 3 == 0, "Done. Frozen.").when(F.col("turn") % 3 == 1, " Here is the list. ").otherwise("Frozen.")
    user, said = R.rehearsed(rid, F.concat(F.when(F.col("conv_id") % 4 == 0, " please ").otherwise(""), "text"), final, 7)
    return df.where("role = 'user'").select("conv_id", "turn", F.sha2(user, 256).alias("user_key"), said.alias("final_response"))


@query("labels", """SELECT doc_id, CASE k WHEN 3 THEN 'teacher output did not contain JSON' WHEN 4 THEN 'teacher output JSON must be an object' WHEN 5 THEN 'teacher output is not JSON' WHEN 7 THEN 'teacher output did not contain JSON' END AS failure, CASE WHEN k IN (0, 1, 2, 6) THEN '{"a":"x{}","id":' || doc_id || '}' END AS payload FROM (SELECT doc_id, doc_id % 8 AS k FROM labels)""")
def recovered_answers(df: DataFrame) -> DataFrame:
    """Eight forms of an answer: bare, fenced with and without a name, among words; none, a list, broken, empty."""
    k, body = F.col("doc_id") % 8, F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "a": "x{}"}'))
    raw = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit(" ```\n"), body, F.lit("```\n"))).when(k == 3, "no object here").when(k == 4, "[1, 2]").when(k == 5, 'so {"id": 1, } it is').when(k == 6, F.concat(F.lit("Here it is: "), body, F.lit(" - done"))).otherwise("")
    return df.select("doc_id", R.recovered(raw).alias("r")).select("doc_id", "r.failure", "r.payload")


@query("labels", "SELECT doc_id, quality FROM labels ORDER BY doc_id LIMIT 25")
def limited_records(df: DataFrame) -> DataFrame:
    """The limit is the feature: an evaluation's first records."""
    return R.limited(df.select("doc_id", "quality"), "doc_id", 25)


@query("labels", """SELECT doc_id, CASE k WHEN 0 THEN '--model-revision must be an exact 40-character lowercase Git revision' WHEN 1 THEN '--dataset-revision must be an exact 40-character lowercase Git revision' WHEN 2 THEN '--max-new-tokens-first must be at least 1' WHEN 3 THEN '--max-new-tokens-final must be at least 1' WHEN 4 THEN '--max-tool-passes must be at least 1' WHEN 5 THEN '--max-tool-calls must be at least 1' WHEN 6 THEN '--limit must be at least 1' END AS problem, k <> 8 AS resumable FROM (SELECT doc_id, doc_id % 9 AS k FROM labels)""")
def run_settings(df: DataFrame) -> DataFrame:
    k, good = F.col("doc_id") % 9, F.sha1(F.lit("r").cast("binary"))
    one = lambda n: F.when(k == n, 0).otherwise(1)
    rows = df.select("doc_id", k.alias("k"), F.when(k == 0, "main").otherwise(good).alias("model_revision"), F.when(k == 1, F.lit(None)).otherwise(good).alias("dataset_revision"), one(2).alias("max_new_tokens_first"), one(3).alias("max_new_tokens_final"), one(4).alias("max_tool_passes"), one(5).alias("max_tool_calls"), F.when(k == 6, 0).when(k == 7, 3).alias("limit"))
    inputs = lambda seed: F.struct(F.lit("base").alias("base_model"), F.lit(None).cast("string").alias("revision"), seed.alias("seed"))
    return rows.select("doc_id", R.settings_problem(rows).alias("problem"), R.resumable(inputs(F.when(F.col("k") == 8, 1).otherwise(2)), inputs(F.lit(2))).alias("resumable"))


@query("labels", f"""WITH e AS (SELECT (doc_id % 6)::BIGINT AS epoch, count(*) FILTER ({P} >= 0.5)::DOUBLE / count(*) AS f, count(*) FILTER (quality = 1)::DOUBLE / count(*) AS r, count(*) FILTER ({Q} < 0.3)::DOUBLE / count(*) AS s, count(*) FILTER (toxic = 1)::DOUBLE / count(*) AS y FROM labels GROUP BY 1)
SELECT epoch, round(f + r + s + 1 - y, 9) AS score FROM e ORDER BY f + r + s + 1 - y DESC, epoch LIMIT 1""")
def best_epoch_v1(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    m = df.groupBy((F.col("doc_id") % 6).alias("epoch")).agg(S.ratio(F.count_if(_scores(df) >= 0.5), n).alias("intent_macro_f1"), S.ratio(F.count_if(F.col("quality") == 1), n).alias("in_domain_recall"), S.ratio(F.count_if(_scores(df, 104729) < 0.3), n).alias("ood_specificity"), S.ratio(F.count_if(F.col("toxic") == 1), n).alias("false_refusal"))
    return A.best_epoch(m, [("intent_macro_f1", False), ("in_domain_recall", False), ("ood_specificity", False), ("false_refusal", True)]).select("epoch", F.round("score", 9).alias("score"))


@query("embeddings", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, round(exp(e[2]) / (exp(e[1]) + exp(e[2])), 9) AS domain_probability, vec_id % 2 AS domain_label, list_position(e, list_max(e)) - 1 AS capability_prediction, vec_id % 64 AS capability_label, array_to_string(list_transform(e[3:5], lambda x: round(10000 / (1 + exp(-x)))::BIGINT), ',') AS relation_probabilities, '1,0,' || vec_id % 2 AS relation_labels, CASE WHEN vec_id % 3 = 0 THEN 'default' ELSE 'repair' END AS example_kind, 'text ' || vec_id AS current_text FROM v""")
def collected_predictions(df: DataFrame) -> DataFrame:
    """Entries of a vector stand for logits: two of the domain, all 64 of the capability, three of relations."""
    e = F.col("embedding").cast("array<double>")
    rows = df.select("vec_id", F.slice(e, 1, 2).alias("domain_logits"), (F.col("vec_id") % 2).alias("domain_label"), e.alias("capability_logits"), (F.col("vec_id") % 64).alias("capability_label"), F.slice(e, 3, 3).alias("relation_logits"), F.array(F.lit(1), F.lit(0), F.col("vec_id") % 2).alias("relation_labels"), F.when(F.col("vec_id") % 3 == 0, "default").otherwise("repair").alias("example_kind"), F.concat(F.lit("text "), "vec_id").alias("current_text"))
    out = R.collected(rows, "vec_id")
    return out.withColumn("domain_probability", F.round("domain_probability", 9)).withColumn("relation_probabilities", F.array_join(F.transform("relation_probabilities", lambda p: F.round(p * 10000).cast("long").cast("string")), ",")).withColumn("relation_labels", F.array_join(F.transform("relation_labels", lambda p: p.cast("string")), ","))

"""Registered queries over ``operators.measures``, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import measures as A
from ..operators import scoring as S
from .catalog import SPLIT, P, Q, _scores, _split_docs, query


@query("documents", f"WITH d AS (SELECT {SPLIT} AS split, lang, source, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE doc_id % 5 END AS part FROM documents) SELECT split, 'lang' AS kind, coalesce(lang, 'None') AS key, count(*) AS n_rows FROM d GROUP BY ALL UNION ALL SELECT split, 'source', coalesce(source, 'None'), count(*) FROM d GROUP BY ALL UNION ALL SELECT split, 'part', coalesce(part::VARCHAR, 'None'), count(*) FROM d GROUP BY ALL")
def key_counts(df: DataFrame) -> DataFrame:
    part = F.when(F.col("doc_id") % 13 == 0, F.lit(None)).otherwise(F.col("doc_id") % 5)
    return A.key_counts(_split_docs(df).withColumn("part", part), "split", ["lang", "source", "part"])


_R = f"(SELECT *, {P} >= 0.2 AS ok, doc_id % 3 = 0 AS ctx, CASE doc_id % 4 WHEN 0 THEN 'banking' WHEN 1 THEN 'conversational' ELSE 'other' END AS kind FROM labels)"


def _rate(name: str, where: str, hit: str, empty: str) -> str:
    return f"SELECT '{name}' AS metric, coalesce(count(*) FILTER ({where} AND {hit})::DOUBLE / nullif(count(*) FILTER ({where}), 0), {empty}) AS value FROM {_R}"


@query("labels", " UNION ALL ".join(_rate(*r) for r in [
    ("expected_acceptance", "quality = 1", "ok", "0"), ("expected_rejection", "quality = 0", "NOT ok", "0"), ("in_domain_false_refusal", "quality = 1", "NOT ok", "0"), ("ood_false_accept", "quality = 0", "ok", "0"),
    ("context_false_refusal", "quality = 1 AND ctx", "NOT ok", "0"), ("context_ood_false_accept", "quality = 0 AND ctx", "ok", "0"), ("context_acceptance", "quality = 1 AND ctx", "ok", "1"),
    ("none_false_refusal", "false", "NOT ok", "0"), ("none_ood_false_accept", "false", "ok", "0"), ("none_acceptance", "false", "ok", "1"),
    ("conversational_error", "kind = 'conversational'", "NOT ok", "1"), ("absent_error", "kind = 'absent'", "ok", "1")]))
def acceptance_rates(df: DataFrame) -> DataFrame:
    kind = F.when(F.col("doc_id") % 4 == 0, "banking").when(F.col("doc_id") % 4 == 1, "conversational").otherwise("other")
    wanted = A.acceptance(_scores(df) >= 0.2, F.col("quality"), {"context": F.col("doc_id") % 3 == 0, "none": F.lit(False)}, {"conversational": (kind == "conversational", True), "absent": (kind == "absent", False)})
    return A.rates(df, wanted)


@query("labels", f"""WITH r AS (SELECT {P} >= 0.3 AS ok, quality, CASE WHEN doc_id % 7 = 0 THEN -100 ELSE doc_id % 5 END AS cap, doc_id % 6 % 5 AS pred, {Q} >= 0.5 AS a0, {Q} >= 0.7 AS a1, doc_id % 2 AS r0, toxic AS r1 FROM labels WHERE doc_id % 10 < 3),
s AS (SELECT count(*) AS n, count(*) FILTER (cap >= 0) AS n_capability, count(*) FILTER (ok <> (quality = 1)) AS route_errors, count(*) FILTER (cap >= 0 AND pred <> cap) AS capability_errors, count(*) FILTER (a0 <> (r0 = 1) OR a1 <> (r1 = 1)) AS relation_errors FROM r)
SELECT *, coalesce(route_errors::DOUBLE / nullif(n, 0), 0) AS route_error_rate, coalesce(capability_errors::DOUBLE / nullif(n_capability, 0), 0) AS capability_error_rate, coalesce(relation_errors::DOUBLE / nullif(n, 0), 0) AS relation_error_rate FROM s""")
def held_out_errors(df: DataFrame) -> DataFrame:
    """Held out here: the first three of every ten ids, as an example kind."""
    q = _scores(df, 104729)
    rows = df.where(F.col("doc_id") % 10 < 3).select((_scores(df) >= 0.3).alias("accepted"), F.col("quality").alias("domain"), F.when(F.col("doc_id") % 7 == 0, -100).otherwise(F.col("doc_id") % 5).alias("capability"), (F.col("doc_id") % 6 % 5).alias("predicted"), F.array(q >= 0.5, q >= 0.7).alias("active"), F.array((F.col("doc_id") % 2).cast("int"), F.col("toxic").cast("int")).alias("relations"))
    return A.held_out_errors(rows)


@query("documents", "SELECT lang, sum(n_chars * w) / greatest(sum(w), 1.0::DOUBLE) AS mean_chars FROM (SELECT lang, n_chars, CASE WHEN doc_id % 9 = 0 THEN 6.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM documents) GROUP BY 1")
def weighted_means(df: DataFrame) -> DataFrame:
    w = F.when(F.col("doc_id") % 9 == 0, 6.0).otherwise(1.0)  # targeted rows weigh six times
    return df.groupBy("lang").agg(A.weighted_mean(F.col("n_chars"), w).alias("mean_chars"))


@query("labels", f"""WITH e AS (SELECT (doc_id % 6)::BIGINT AS epoch, count(*) FILTER ({P} >= 0.5)::DOUBLE / count(*) AS f, count(*) FILTER (quality = 1)::DOUBLE / count(*) AS r, count(*) FILTER ({Q} < 0.3)::DOUBLE / count(*) AS x, count(*) FILTER (toxic = 1)::DOUBLE / count(*) AS y FROM labels GROUP BY 1)
SELECT epoch, round(f + r + 1 - x + 1 - y, 9) AS score FROM e ORDER BY f + r + 1 - x + 1 - y DESC, epoch LIMIT 1""")
def best_epoch(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    m = df.groupBy((F.col("doc_id") % 6).alias("epoch")).agg(S.ratio(F.count_if(_scores(df) >= 0.5), n).alias("capability_f1"), S.ratio(F.count_if(F.col("quality") == 1), n).alias("relation_f1"), S.ratio(F.count_if(_scores(df, 104729) < 0.3), n).alias("refusal"), S.ratio(F.count_if(F.col("toxic") == 1), n).alias("accept"))
    return A.best_epoch(m, [("capability_f1", False), ("relation_f1", False), ("refusal", True), ("accept", True)]).select("epoch", F.round("score", 9).alias("score"))


@query("embeddings", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS l, list_transform(embedding::DOUBLE[], lambda x, i: x + ((vec_id + i - 1) % 7 - 3) * 0.03::DOUBLE) AS r FROM embeddings),
g AS (SELECT vec_id, list_transform(range(1, len(l) + 1), lambda i: abs(l[i] - r[i])) AS gap, list_position(l, list_max(l)) = list_position(r, list_max(r)) AS same FROM v),
u AS (SELECT unnest(gap) AS g FROM g),
t AS (SELECT count(*) AS compared, count(*) FILTER (isfinite(g)) AS finite, max(g) AS max_diff, avg(g) AS mean_diff, quantile_cont(g, 0.99) AS p99_diff, quantile_cont(g, 0.999) AS p999_diff FROM u),
a AS (SELECT count(*) AS prompt_count, count(*) FILTER (same)::DOUBLE / count(*) AS argmax_agreement FROM g)
SELECT prompt_count, compared, finite, round(max_diff, 6) AS max_diff, round(mean_diff, 6) AS mean_diff, round(argmax_agreement, 6) AS argmax_agreement, round(p99_diff, 6) AS p99_diff, round(p999_diff, 6) AS p999_diff, max_diff <= 0.005 AS close_0_005, max_diff <= 0.01 AS close_0_01, max_diff <= 0.02 AS close_0_02,
concat_ws('; ', CASE WHEN finite < compared THEN 'non-finite logit differences' END, CASE WHEN prompt_count < 8 THEN 'too few prompts' END, CASE WHEN argmax_agreement < 0.999 THEN 'argmax agreement' END, CASE WHEN max_diff > 0.3 THEN 'maximum logit difference' END, CASE WHEN p999_diff > 0.07 THEN 'p999 logit difference' END) AS failures FROM t, a""")
def score_parity(df: DataFrame) -> DataFrame:
    rows = df.select("vec_id", F.col("embedding").cast("array<double>").alias("l"), F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x + (F.pmod(F.col("vec_id") + i, F.lit(7)) - 3) * F.lit(0.03)).alias("r"))
    out = A.parity_failures(A.parity(rows, "l", "r"))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


_PATHS = ["tool_success", "multi_turn", "clarification", "no_tool_banking_faq", "ood", "hard_negative", "conversation"]
_PATH_SQL = "[" + ", ".join(f"'{p}'" for p in _PATHS) + "]"
_MIX = f"""WITH r AS (SELECT conv_id, {_PATH_SQL}[conv_id % 7 + 1] AS path, count(*) FILTER (role = 'assistant') - 1 AS calls, lower(coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '')) || CASE WHEN conv_id % 2 = 0 THEN ' the last four digits' ELSE '' END || CASE WHEN conv_id % 5 = 0 THEN ' your password' ELSE '' END AS said, CASE WHEN conv_id % 11 = 0 THEN 'case_status' ELSE 'other' END AS family FROM conversations GROUP BY conv_id),
c AS (SELECT *, calls >= 2 OR path = 'multi_turn' AS sequential, path = 'clarification' AND contains(said, 'last four digits') AND NOT regexp_matches(said, 'account number|customer id|password| pin|ssn') AS clarification, family = 'case_status' AS servicing, path IN ('tool_success', 'tool_error', 'no_tool_banking_faq', 'ood', 'hard_negative') AS regression FROM r)"""


def _classed(df: DataFrame) -> DataFrame:
    last = F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn")))
    rows = df.groupBy("conv_id").agg((F.count_if(F.col("role") == "assistant") - 1).alias("calls"), last.alias("said"))
    said = F.concat(F.coalesce("said", F.lit("")), F.when(F.col("conv_id") % 2 == 0, " the last four digits").otherwise(""), F.when(F.col("conv_id") % 5 == 0, " your password").otherwise(""))
    path = F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (F.col("conv_id") % 7 + 1).cast("int"))
    family = F.when(F.col("conv_id") % 11 == 0, "case_status").otherwise("other")
    return rows.select("conv_id", *[c.alias(n) for n, c in A.record_classes(path, F.col("calls"), said, family, ["case_status"]).items()])


@query("conversations", _MIX + " SELECT count(*) AS input_records, count(*) FILTER (sequential) AS sequential, count(*) FILTER (clarification) AS clarification, count(*) FILTER (servicing) AS servicing, count(*) FILTER (regression) AS regression, sum(greatest(1, CASE WHEN sequential THEN 3 ELSE 1 END, CASE WHEN clarification THEN 4 ELSE 1 END, CASE WHEN servicing THEN 2 ELSE 1 END))::BIGINT AS total FROM c")
def mix_report(df: DataFrame) -> DataFrame:
    w = F.greatest(F.lit(1), F.when(F.col("sequential"), 3).otherwise(1), F.when(F.col("clarification"), 4).otherwise(1), F.when(F.col("servicing"), 2).otherwise(1))
    return _classed(df).agg(F.count(F.lit(1)).alias("input_records"), *[F.count_if(c).alias(c) for c in ("sequential", "clarification", "servicing", "regression")], F.sum(w).alias("total"))


@query("conversations", _MIX + " , k AS (SELECT conv_id, unnest(range(1, greatest(1, CASE WHEN sequential THEN 3 ELSE 1 END, CASE WHEN clarification THEN 4 ELSE 1 END, CASE WHEN servicing THEN 2 ELSE 1 END) + 1))::INT AS copy FROM c) SELECT conv_id, copy, sha256('17' || chr(0) || conv_id || chr(0) || copy) AS place FROM k")
def continuation_mix(df: DataFrame) -> DataFrame:
    return A.continuation_mix(_classed(df), {"sequential": 3, "clarification": 4, "servicing": 2}, "17", "conv_id").select("conv_id", "copy", "place")


@query("documents", """WITH r AS (SELECT row_number() OVER (ORDER BY doc_id, sha256(text)) - 1 AS o, sha256(text) AS d FROM documents),
a AS (SELECT o // 1000 AS o, sha256(string_agg(d, '' ORDER BY o)) AS d FROM r GROUP BY o // 1000),
b AS (SELECT o // 1000 AS o, sha256(string_agg(d, '' ORDER BY o)) AS d FROM a GROUP BY o // 1000)
SELECT CASE WHEN (SELECT count(*) FROM a) = 1 THEN (SELECT d FROM a) ELSE (SELECT d FROM b) END AS digest, (SELECT count(*) FROM r) AS n_rows""")
def ordered_fingerprint(df: DataFrame) -> DataFrame:
    return A.ordered_digest(df.select("doc_id", "text"), [F.asc("doc_id")], F.sha2("text", 256))


PRIVATE = {"private_value": A.PRIVATE_VALUE, "digits": A.FACT_DIGITS}


@query("documents", rf"SELECT doc_id, regexp_matches(text, '{A.PRIVATE_VALUE}') AS private_value, regexp_matches(lower(text), '{A.ASKING}') AND regexp_matches(lower(text), '{A.ASKED_FOR}') AS asks_private, sha256(CASE WHEN contains(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) THEN array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' ') ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END) AS flat_key FROM documents")
def generated_text_checks(df: DataFrame) -> DataFrame:
    return df.select("doc_id", A.has_private_value(F.col("text")).alias("private_value"), A.asks_private_data(F.col("text")).alias("asks_private"), F.sha2(A.flattened(F.col("text")), 256).alias("flat_key"))


@query("conversations", rf"""WITH p AS (SELECT conv_id, turn, text || CASE turn % 2 WHEN 0 THEN ' 42 Pending 42' ELSE '' END AS text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations),
f AS (SELECT conv_id, turn, after, unnest(list_distinct(list_concat(regexp_extract_all(text, '\d{{2,}}'), list_transform(regexp_extract_all(text, '{A.FACT_WORDS}'), lambda w: lower(w))))) AS w FROM p WHERE after IS NOT NULL)
SELECT conv_id, turn, string_agg(w, ',' ORDER BY w) AS lost FROM f WHERE NOT contains(lower(after), w) GROUP BY ALL""")
def facts_lost(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    rows = df.withColumn("after", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("after IS NOT NULL")
    before = F.concat("text", F.when(F.col("turn") % 2 == 0, " 42 Pending 42").otherwise(""))
    return rows.select("conv_id", "turn", F.array_join(A.facts_lost(before, F.col("after")), ",").alias("lost")).where("lost <> ''")


_ASK = "'rec_' || conv_id || '_' || turn"


@query("conversations", rf"""WITH r AS (SELECT {_ASK} AS record_id, (conv_id + turn) % 9 AS k, CASE WHEN trim(text) = '' THEN 'x' ELSE text END AS text FROM conversations WHERE role = 'user'),
a AS (SELECT record_id, CASE WHEN k = 8 THEN 'sha256:zz' ELSE 'sha256:' || sha256(text) END AS hash, text AS user_content, 'Card 4821 is frozen and ready.' AS final_response, CASE k WHEN 0 THEN ' ' WHEN 1 THEN 'other' ELSE record_id END AS s_id, CASE k WHEN 2 THEN 'sha256:0' ELSE CASE WHEN k = 8 THEN 'sha256:zz' ELSE 'sha256:' || sha256(text) END END AS s_hash, CASE k WHEN 3 THEN '' ELSE text || ' please' END AS s_user, CASE k WHEN 4 THEN 'Your card 4821 is ready.' WHEN 5 THEN 'Card 4821 is frozen. Please confirm your PIN.' WHEN 6 THEN 'Card 4821 is frozen, number 123456789012.' ELSE E'Card 4821 is\n frozen now.' END AS s_final FROM r)
SELECT record_id, CASE WHEN NOT regexp_full_match(hash, 'sha256:[0-9a-f]{{64}}') THEN 'invalid immutable_hash' END AS request_problem,
CASE WHEN trim(s_id) = '' THEN 'missing or empty string field: record_id' WHEN s_id <> record_id THEN 'record_id mismatch' WHEN s_hash <> hash THEN 'immutable_hash mismatch' WHEN s_user = '' THEN 'missing or empty string field: user_content' WHEN NOT contains(lower(s_final), 'frozen') THEN 'final_response lost banking facts' WHEN regexp_matches(lower(s_final), 'confirm.*pin') THEN 'final_response requests private credentials' WHEN regexp_matches(s_user, '{A.PRIVATE_VALUE}') OR regexp_matches(s_final, '{A.PRIVATE_VALUE}') THEN 'teacher output contains private identifiers' END AS response_problem FROM a""")
def teacher_checks(df: DataFrame) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 9
    rid = F.concat_ws("_", F.lit("rec"), "conv_id", "turn")
    text = F.when(F.trim("text") == "", "x").otherwise(F.col("text"))
    digest = F.when(k == 8, "sha256:zz").otherwise(F.concat(F.lit("sha256:"), F.sha2(text, 256)))
    asked = F.struct(rid.alias("record_id"), digest.alias("immutable_hash"), text.alias("user_content"), F.lit("Card 4821 is frozen and ready.").alias("final_response"))
    final = F.when(k == 4, "Your card 4821 is ready.").when(k == 5, "Card 4821 is frozen. Please confirm your PIN.").when(k == 6, "Card 4821 is frozen, number 123456789012.").otherwise("Card 4821 is\n frozen now.")
    said = F.struct(F.when(k == 0, " ").when(k == 1, "other").otherwise(rid).alias("record_id"), F.when(k == 2, "sha256:0").otherwise(digest).alias("immutable_hash"), F.when(k == 3, "").otherwise(F.concat(text, F.lit(" please"))).alias("user_content"), final.alias("final_response"))
    rows = df.where("role = 'user'").select(asked.alias("asked"), said.alias("said"))
    return rows.select("asked.record_id", A.request_problems({f: F.col(f"asked.{f}") for f in ("record_id", "immutable_hash", "user_content", "final_response")}).alias("request_problem"), A.response_problems().alias("response_problem"))


@query("conversations", "SELECT a.conv_id, a.turn, sha256(coalesce(b.text, a.text)) AS text_key FROM conversations a LEFT JOIN (SELECT conv_id, turn, text || ' (reworded)' AS text FROM conversations WHERE role = 'assistant' AND conv_id % 3 = 0) b USING (conv_id, turn)")
def realized_turns(df: DataFrame) -> DataFrame:
    keyed = df.withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    answers = keyed.where("role = 'assistant' AND conv_id % 3 = 0").select("key", F.concat("text", F.lit(" (reworded)")).alias("text"))
    return A.realized(keyed, answers, "key", "text").select("conv_id", "turn", F.sha2("text", 256).alias("text_key"))


@query("labels", "SELECT (SELECT count(*) FROM labels) AS n_rows, count(*) FILTER (doc_id % 50 = 0 OR doc_id % 97 = 0 OR doc_id % 31 IN (1, 2)) AS n_broken, count(*) FILTER (doc_id % 4 = 1 OR doc_id % 97 = 0) AS n_changed FROM labels")
def prompt_equivalence(df: DataFrame) -> DataFrame:
    """The second source has rows changed, rows missing, and neighbours that changed places."""
    left = df.select("doc_id", F.col("doc_id").alias("record_id"), F.col("quality").cast("string").alias("messages"), F.col("toxic").alias("expected"))
    at = F.col("doc_id") % 31
    swapped = F.when(at == 1, F.col("doc_id") + 1).when(at == 2, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    right = left.where("doc_id % 97 <> 0").select("doc_id", swapped.alias("record_id"), F.when(F.col("doc_id") % 50 == 0, "changed").otherwise(F.col("messages")).alias("messages"), F.when(F.col("doc_id") % 4 == 1, F.col("expected") + 1).otherwise(F.col("expected")).alias("expected"))
    return A.positional_changes(left, right, "doc_id", ["record_id", "messages"], "expected")


@query("documents", f"""WITH a AS (SELECT {SPLIT} AS split, sum(('0x' || substr(sha256(text), 1, 12))::BIGINT)::VARCHAR AS d FROM documents GROUP BY 1), l AS (SELECT split, CASE WHEN split = 'test' THEN 'old' ELSE d END AS d FROM a WHERE split <> 'validation' UNION ALL SELECT 'extra', 'x')
SELECT split, a.d AS found, l.d AS locked FROM a FULL JOIN l USING (split) WHERE a.d IS DISTINCT FROM l.d""")
def lock_drift(df: DataFrame) -> DataFrame:
    from ..operators.corpus import fingerprint

    actual = fingerprint(_split_docs(df), F.sha2("text", 256), ["split"]).select("split", F.col("digest_sum").alias("d"))
    lock = actual.where("split <> 'validation'").withColumn("d", F.when(F.col("split") == "test", "old").otherwise(F.col("d"))).union(actual.sparkSession.sql("SELECT 'extra', 'x'"))
    return A.drift(actual, lock, "split", "d")


_CASE = "CASE event_id % 4 WHEN 0 THEN 'case_alex_' || event_id WHEN 1 THEN 'manual_' || event_id ELSE 'case_' || event_id END"


@query("events", f"WITH c AS (SELECT user_id, ts, {_CASE} AS c, event_id % 4 > 1 AS made FROM events) SELECT user_id, CASE WHEN made THEN 'generated_case_' || lpad((sum(made::INT) OVER (PARTITION BY user_id ORDER BY ts, c))::VARCHAR, 3, '0') ELSE c END AS case_id, CASE WHEN made THEN 'generated-timestamp' ELSE 'kept' END AS created_at FROM c")
def stable_cases(df: DataFrame) -> DataFrame:
    k = F.col("event_id") % 4
    cases = df.select("user_id", "ts", F.when(k == 0, F.concat(F.lit("case_alex_"), "event_id")).when(k == 1, F.concat(F.lit("manual_"), "event_id")).otherwise(F.concat(F.lit("case_"), "event_id")).alias("case"))
    return A.stable_cases(cases, "user_id", "case", "ts").withColumn("created_at", F.when(F.col("created_at") == "generated-timestamp", F.col("created_at")).otherwise("kept"))


@query("conversations", r"SELECT conv_id, turn, 'call_generated_' || turn || '_' || substr(sha256(text || chr(10) || turn || chr(10) || 'list cards'), 1, 16) AS wire_id, 'call_' || substr(sha256(conv_id || chr(0) || text), 1, 10) || '_' || turn || '_list_cards' AS serving_id, CASE WHEN contains(lower(text), 'matching synthetic') OR contains(lower(text), 'no matching') THEN 'No matching eligible synthetic banking record was found.' WHEN contains(lower(text), 'unsupported') THEN 'The requested tool arguments are not supported.' ELSE 'The synthetic banking action could not be completed.' END AS safe_error FROM (SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN ' no matching row' WHEN 1 THEN ' UNSUPPORTED' ELSE '' END AS text FROM conversations)")
def call_ids(df: DataFrame) -> DataFrame:
    text = F.concat("text", F.when(F.col("turn") % 3 == 0, " no matching row").when(F.col("turn") % 3 == 1, " UNSUPPORTED").otherwise(""))
    return df.select("conv_id", "turn", A.wire_call_id(text, F.col("turn"), F.lit("list cards")).alias("wire_id"), A.serving_call_id(F.col("conv_id").cast("string"), text, F.col("turn"), F.lit(" list cards!")).alias("serving_id"), A.safe_error(text).alias("safe_error"))


@query("conversations", """WITH t AS (SELECT conv_id, turn, list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: least(255, greatest(3, ord(c)))) AS x FROM conversations), w AS (SELECT *, max(len(x)) OVER (PARTITION BY conv_id) AS width FROM t)
SELECT conv_id, turn, len(x)::BIGINT AS n_tokens, width::BIGINT AS n_input, coalesce(list_sum(x), 0)::BIGINT AS token_sum, ((width - len(x)) * -100 + coalesce(list_sum(x), 0))::BIGINT AS label_sum, len(x)::BIGINT AS mask_sum FROM w""")
def padded_batches(df: DataFrame) -> DataFrame:
    rows = A.padded(df.select("conv_id", "turn", A.toy_tokens(F.col("text")).alias("tokens")), "conv_id", "tokens", 0)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("conv_id", "turn", F.size("tokens").cast("long").alias("n_tokens"), F.size("input_ids").cast("long").alias("n_input"), total("input_ids").alias("token_sum"), total("label_ids").alias("label_sum"), total("attention_mask").alias("mask_sum"))


@query("orders", "SELECT o_orderkey, '$' || format('{:,.2f}', round(o_totalprice * 100)::BIGINT / 100.0::DOUBLE) AS total, regexp_full_match(sha1(o_orderkey::VARCHAR), '[0-9a-f]{40}') AND o_orderkey % 2 = 0 AS is_revision FROM orders")
def formatted_totals(df: DataFrame) -> DataFrame:
    sha = F.when(F.col("o_orderkey") % 2 == 0, F.sha1(F.col("o_orderkey").cast("string"))).otherwise("main")
    return df.select("o_orderkey", T.usd(F.round(F.col("o_totalprice") * 100).cast("long")).alias("total"), T.is_revision(sha).alias("is_revision"))


@query("embeddings", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS s FROM embeddings), e AS (SELECT vec_id, s, list_transform(s, lambda x: exp(x - list_max(s))) AS e FROM v)
SELECT vec_id, (list_position(s, list_max(s)) - 1)::BIGINT AS best, round(1.0::DOUBLE / list_sum(e), 6) AS confidence, round(1 / (1 + exp(-s[1])), 6) AS domain, len(list_filter(s, lambda x: 1 / (1 + exp(-x)) >= 0.52))::BIGINT AS n_active FROM e""")
def projected_scores(df: DataFrame) -> DataFrame:
    s = F.col("embedding").cast("array<double>")
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    return df.select("vec_id", (F.array_position(s, F.array_max(s)) - 1).cast("long").alias("best"), F.round(F.array_max(T.softmax(s)), 6).alias("confidence"), F.round(sigmoid(s[0]), 6).alias("domain"), F.size(F.filter(s, lambda x: sigmoid(x) >= 0.52)).cast("long").alias("n_active"))


@query("labels", f"""WITH s AS (SELECT doc_id, {P} AS now_, {Q} AS both_, doc_id % 3 = 0 AS pointing FROM labels) SELECT doc_id, CASE WHEN now_ < 0.4 AND pointing THEN both_ ELSE now_ END AS score, CASE WHEN now_ < 0.4 AND pointing THEN both_ ELSE now_ END >= 0.4 AS accepted, now_ < 0.4 AND pointing AS used_context FROM s""")
def two_pass_route(df: DataFrame) -> DataFrame:
    return df.select("doc_id", *S.two_pass(_scores(df), _scores(df, 104729), F.col("doc_id") % 3 == 0, 0.4))


_GATES = [("capability_macro_f1", "min", 0.85), ("relation_macro_f1", "min", 0.85), ("in_domain_false_refusal_rate", "max", 0.02), ("ood_false_accept_rate", "max", 0.05), ("contextual_false_refusal_rate", "max", 0.02), ("repair_false_refusal_rate", "max", 0.01), ("topic_shift_ood_false_accept_rate", "max", 0.05), ("heldout_regression_route_error_rate", "max", 0.0), ("heldout_regression_capability_error_rate", "max", 0.0), ("heldout_regression_relation_error_rate", "max", 0.0)]


_SHARES = [7, 11, 53, 19, 59, 101, 17, 997, 991, 13]  # a metric is the share of ids that this number divides, or, where it must be high, doesn't


@query("labels", "WITH m AS (" + " UNION ALL ".join(f"SELECT '{name}' AS metric, count(*) FILTER (doc_id % {k} {'<>' if kind == 'min' else '='} 0)::DOUBLE / count(*) AS value, {bound}::DOUBLE AS bound, '{kind}' AS kind FROM labels" for (name, kind, bound), k in zip(_GATES, _SHARES, strict=True)) + ") SELECT metric, value, CASE kind WHEN 'min' THEN value >= bound - 1e-12 ELSE value <= bound + 1e-12 END AS passed FROM m")
def router_gates(df: DataFrame) -> DataFrame:
    """All ten gates over rates that the table gives."""
    rates = [S.ratio(F.count_if((F.col("doc_id") % k != 0) if kind == "min" else (F.col("doc_id") % k == 0)), F.count(F.lit(1))).alias(name) for (name, kind, _), k in zip(_GATES, _SHARES, strict=True)]
    return S.gates(df.agg(*rates).unpivot([], [g[0] for g in _GATES], "metric", "value"), _GATES)

"""The registered queries of the conversation engine and the SQL that each is held against.

Where a reference operator needs columns that the given tables lack, another table's stand in for them: sources for
split groups, languages for intents, hashed scores for model outputs, customers and orders for bank rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import messages as M
from ..operators import scoring as S
from ..operators import state as R
from ..operators import toolcalls as K

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(table: str, sql: str | None):
    """Register a function of one table's DataFrame (or of session and folder) under its name."""

    def add(f):
        if table:
            _QUERIES[f.__name__] = lambda spark, d: f(spark.read.parquet(f"{d}/{table}.parquet"))
        else:
            _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
VISIBLE = rf"vis AS (SELECT conv_id, turn, role, {STRIP} AS text FROM conversations WHERE role IN ('user','assistant') AND {STRIP} <> '')"
CURRENT = "cur AS (SELECT conv_id, arg_max(text, turn) AS current, max(turn) AS ct FROM vis WHERE role = 'user' GROUP BY 1)"
NORM_B = r"trim(lower(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g')))"
SPLIT = "CASE WHEN doc_id // 20 % 10 < 7 THEN 'train' WHEN doc_id // 20 % 10 < 8 THEN 'validation' ELSE 'test' END"


# Messages


@query("conversations", f"""WITH {VISIBLE}, {CURRENT},
seq AS (SELECT v.*, ct, lag(role) OVER w AS pr, lag(text) OVER w AS pt FROM vis v JOIN cur USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
ex AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, '[PREVIOUS_ASSISTANT]' || chr(10) || text || chr(10) || '[PREVIOUS_USER]' || chr(10) || pt AS said FROM seq WHERE role = 'assistant' AND pr = 'user' AND turn < ct),
agg AS (SELECT conv_id, string_agg(said, chr(10) ORDER BY n) AS said FROM ex WHERE n <= 3 GROUP BY 1)
SELECT conv_id, '[CURRENT_USER]' || chr(10) || current || coalesce(chr(10) || said, '') AS router_input, said IS NOT NULL AS context_applied FROM cur LEFT JOIN agg USING (conv_id)""")
def router_input_render(df: DataFrame) -> DataFrame:
    return M.router_input(df)


@query("conversations", f"""WITH {VISIBLE}, seq AS (SELECT *, lag(role) OVER w AS pr, lag(text) OVER w AS pt FROM vis WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, pt AS user_text, text AS assistant_text, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS exchange_no FROM seq WHERE role = 'assistant' AND pr = 'user'""")
def complete_exchanges(df: DataFrame) -> DataFrame:
    return M.complete_exchanges(df)


@query("conversations", f"""WITH u AS (SELECT conv_id, {STRIP} AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user')
SELECT a.conv_id, '[CURRENT]' || chr(10) || a.text || CASE WHEN b.text <> '' THEN chr(10) || '[PREVIOUS_USER]' || chr(10) || b.text ELSE '' END AS router_input FROM u a LEFT JOIN u b ON a.conv_id = b.conv_id AND b.n = 2 WHERE a.n = 1""")
def previous_user_render(df: DataFrame) -> DataFrame:
    return M.previous_user_input(df)


@query("conversations", rf"""WITH {VISIBLE}, {CURRENT},
h AS (SELECT conv_id, current, EXISTS (SELECT 1 FROM vis v WHERE v.conv_id = cur.conv_id AND v.turn < ct) AS has_history, list_distinct(list_filter(string_split({NORM_B.replace('text', 'current')}, ' '), lambda x: x <> '')) AS w, lower(current) AS t FROM cur),
r AS (SELECT conv_id, has_history, t, has_history AND (len(w) <= 6 OR list_has_any(w, ['it','that','this','those','them','one','again','there'])) AS context_dependent, list_has_any(w, ['no','not','wrong','instead','asked']) AS agent_repair, has_history AND list_has_any(w, ['yes','yeah','yep','4821','that','one']) AND len(w) <= 6 AS clarification_answer, list_has_any(w, ['again','else','it','next','that','them','then','there','these','they','this','those']) AS points_back FROM h)
SELECT conv_id, has_history, context_dependent, agent_repair, clarification_answer, points_back,
CASE WHEN t LIKE '%account%' OR t LIKE '%balance%' THEN 'accounts' WHEN t LIKE '%freeze#_card%' ESCAPE '#' OR t LIKE '%replace#_card%' ESCAPE '#' OR t LIKE '%stolen%' THEN 'card_actions' WHEN t LIKE '%card%' THEN 'cards' WHEN t LIKE '%transaction%' OR t LIKE '%dispute%' OR t LIKE '%purchase%' THEN 'transactions' WHEN t LIKE '%transfer%' THEN 'transfers' WHEN t LIKE '%case%' OR t LIKE '%address%' THEN 'service_cases' WHEN t LIKE '%faq%' OR t LIKE '%mortgage%' OR t LIKE '%open %' THEN 'faq' ELSE 'conversation' END AS capability,
CASE WHEN agent_repair THEN 'agent_repair' WHEN clarification_answer THEN 'clarification_answer' WHEN context_dependent THEN 'contextual_followup' WHEN has_history THEN 'visible_multiturn' ELSE 'sft_single_turn' END AS example_kind FROM r""")
def turn_rules(df: DataFrame) -> DataFrame:
    return M.judged_turns(df)


TOKENS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"


@query("conversations", rf"""WITH t AS (SELECT conv_id, turn, role, {TOKENS} AS k FROM conversations),
r AS (SELECT *, sum(CASE WHEN role <> 'system' THEN k ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS run, sum(CASE WHEN role = 'system' THEN k ELSE 0 END) OVER (PARTITION BY conv_id) AS sys FROM t)
SELECT conv_id, min(turn) FILTER (role = 'user' AND run + sys <= 60) AS first_turn, (max(run + sys) FILTER (role = 'user' AND run + sys <= 60))::BIGINT AS tokens_kept FROM r GROUP BY 1""")
def budget_suffix(df: DataFrame) -> DataFrame:
    return M.budget_suffix(df, 60)


@query("conversations", rf"""WITH RECURSIVE t AS (SELECT conv_id, turn, {TOKENS} AS k, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM conversations WHERE role <> 'system'),
g AS (SELECT conv_id, grp, sum(k)::BIGINT AS k, row_number() OVER (PARTITION BY conv_id ORDER BY grp DESC) AS n FROM t GROUP BY conv_id, grp),
s AS (SELECT conv_id, n, k AS used, 1 AS kept, grp AS oldest FROM g WHERE n = 1 UNION ALL SELECT g.conv_id, g.n, CASE WHEN used + k <= 60 THEN used + k ELSE used END, kept + (used + k <= 60)::INT, CASE WHEN used + k <= 60 THEN grp ELSE oldest END FROM s JOIN g ON g.conv_id = s.conv_id AND g.n = s.n + 1)
SELECT conv_id, max(n)::BIGINT AS n_groups, arg_max(kept, n)::BIGINT AS n_kept, arg_max(used, n)::BIGINT AS tokens_kept, arg_max(oldest, n)::BIGINT AS oldest_kept, arg_max(used, n) > 60 AS over FROM s GROUP BY 1""")
def budget_groups(df: DataFrame) -> DataFrame:
    return M.budget_groups(df, 60)


@query("conversations", "SELECT role, count(*) AS n_turns, count(DISTINCT conv_id) AS n_conversations, sum((trim(text) = '')::INT)::BIGINT AS n_blank FROM conversations GROUP BY 1")
def role_report(df: DataFrame) -> DataFrame:
    return df.groupBy("role").agg(F.count(F.lit(1)).alias("n_turns"), F.count_distinct("conv_id").alias("n_conversations"), F.count_if(F.trim("text") == "").alias("n_blank"))


@query("conversations", r"""WITH r AS (SELECT *, lag(role) OVER w AS b, row_number() OVER w AS no, len(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
f AS (SELECT conv_id, bool_or(role NOT IN ('system','user','assistant')) AS a, bool_or(role = 'system' AND no > 1) AS b2, coalesce(bool_or(role = b), false) AS c, bool_or(trim(text) = '') AS d, arg_max(role, turn) AS lr, arg_max(k, turn) AS lk FROM r GROUP BY 1)
SELECT conv_id, concat_ws('; ', CASE WHEN a THEN 'unknown role' END, CASE WHEN b2 THEN 'system turn not first' END, CASE WHEN c THEN 'role repeats' END, CASE WHEN d THEN 'blank turn' END, CASE WHEN lr <> 'assistant' THEN 'no final answer' END, CASE WHEN lr = 'assistant' AND lk < 7 THEN 'final answer too short' END) AS violations FROM f""")
def turn_violations(df: DataFrame) -> DataFrame:
    return R.ordered_turn_violations(df)


# Texts and row sets


@query("documents", rf"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS norm_ascii, sha256({NORM_B}) AS norm_unicode FROM documents")
def normalized_texts(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.sha2(T.norm_ascii(F.col("text")), 256).alias("norm_ascii"), F.sha2(T.norm_unicode(F.col("text")), 256).alias("norm_unicode"))


@query("documents", r"SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\x0B\x1C-\x1F\x{85}\x{A0}]+', ' ', 'g'))) AS folded FROM documents")
def folded_texts(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.sha2(T.norm_spaces(F.col("text")), 256).alias("folded"))


@query("documents", rf"SELECT sha256({NORM_B}) AS text_key, count(*) AS n_rows, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_texts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.sha2(T.norm_unicode(F.col("text")), 256).alias("text_key")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first_id")).where("n_rows > 1")


@query("documents", "SELECT doc_id, row_number() OVER (ORDER BY sha256('711' || chr(0) || doc_id::VARCHAR), doc_id)::BIGINT AS rank_no, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 12))::BIGINT AS stable_int FROM documents")
def stable_ranks(df: DataFrame) -> DataFrame:
    rows = C.ranked(df.select("doc_id").withColumn("g", F.lit(0)), T.stable_rank("711", F.col("doc_id")), ["g"], "doc_id")
    return rows.select("doc_id", F.col("rank_no").cast("long").alias("rank_no"), T.stable_int(F.col("doc_id").cast("string")).alias("stable_int"))


@query("documents", """WITH g AS (SELECT source, row_number() OVER (ORDER BY sha256('711' || chr(10) || source)) AS n, greatest(1, round_even(count(*) OVER () * 0.15, 0)) AS k FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, source, CASE WHEN n <= k THEN 'validation' WHEN n <= 2 * k THEN 'test' ELSE 'train' END AS split FROM documents JOIN g USING (source)""")
def group_split(df: DataFrame) -> DataFrame:
    return C.group_split(df.select("doc_id", "source"), "source", 711).select("doc_id", "source", "split")


@query("documents", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7101' || chr(0) || lang || chr(0) || doc_id::VARCHAR), doc_id) AS n, greatest(1, round_even(count(*) OVER (PARTITION BY lang) * 0.15, 0)) AS k FROM documents)
SELECT doc_id, lang, CASE WHEN n <= k THEN 'validation' ELSE 'train' END AS split FROM r""")
def stratified_validation(df: DataFrame) -> DataFrame:
    return C.stratified_take(df.select("doc_id", "lang"), "lang", "doc_id", "7101", 0.15).select("doc_id", "lang", "split")


def _split_docs(df: DataFrame) -> DataFrame:
    m = F.floor(F.col("doc_id") / 20) % 10
    return df.withColumn("split", F.when(m < 7, "train").when(m < 8, "validation").otherwise("test"))


@query("documents", rf"""WITH d AS (SELECT doc_id, {SPLIT} AS split, sha256({NORM_B}) AS k FROM documents), p AS (SELECT *, CASE split WHEN 'test' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS p FROM d)
SELECT doc_id, split FROM (SELECT *, min(p) OVER (PARTITION BY k) AS m FROM p) WHERE p = m""")
def dedup_across_splits(df: DataFrame) -> DataFrame:
    rows = _split_docs(df).select("doc_id", "split", F.sha2(T.norm_unicode(F.col("text")), 256).alias("k"))
    return C.dedup_across(rows, F.col("k")).select("doc_id", "split")


@query("documents", rf"""WITH d AS (SELECT doc_id, {SPLIT} AS split, sha256({NORM_B}) AS k FROM documents)
SELECT doc_id, split FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE split WHEN 'test' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END, doc_id) AS n FROM d) WHERE n = 1""")
def dedup_keep_first(df: DataFrame) -> DataFrame:
    return C.dedup_first(_split_docs(df), F.sha2(T.norm_unicode(F.col("text")), 256), "doc_id", ["doc_id", "split"])


@query("documents", f"SELECT source, string_agg(split, ',' ORDER BY split) AS splits FROM (SELECT DISTINCT source, {SPLIT} AS split FROM documents) GROUP BY 1 HAVING count(*) > 1")
def group_leakage(df: DataFrame) -> DataFrame:
    return C.leaking(_split_docs(df), "source")


PII_SQL = {k: v.replace("'", "''") for k, v in T.PII_PATTERNS.items()}


@query("documents", " UNION ALL ".join(f"SELECT lang, '{k}' AS pattern, count(*) FILTER (regexp_matches(text, '{v}')) AS n_rows FROM documents GROUP BY 1" for k, v in PII_SQL.items()))
def pii_documents(df: DataFrame) -> DataFrame:
    return C.pii_report(df, "text", ["lang"])


@query("pages", " UNION ALL ".join(f"SELECT '{k}' AS pattern, count(*) FILTER (regexp_matches(html, '{v}')) AS n_rows FROM pages" for k, v in PII_SQL.items()))
def pii_pages(df: DataFrame) -> DataFrame:
    return C.pii_report(df, "html", [])


@query("", rf"SELECT doc_id FROM documents WHERE {NORM_B} IN (SELECT {NORM_B} FROM benchmark)")
def held_out_rows(spark: SparkSession, d: str) -> DataFrame:
    docs, held = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    return C.held_out_hits(docs.select("doc_id", "text"), held.select("text"), "text").select("doc_id")


@query("conversations", """WITH r AS (SELECT conv_id, turn, text, lag(text) OVER w AS p, count(*) OVER (PARTITION BY conv_id) AS n, last_value(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, sha256(coalesce(p, z)) AS previous_key FROM r WHERE n > 1""")
def circular_transitions(df: DataFrame) -> DataFrame:
    return C.circular_previous(df.select("conv_id", "turn", "text"), "conv_id", "turn", "text").select("conv_id", "turn", F.sha2("previous", 256).alias("previous_key"))


@query("labels", """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('7404' || chr(0) || doc_id::VARCHAR), doc_id) - 1 AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT a.doc_id, b.doc_id AS anchor_id FROM r a JOIN (SELECT max(n) AS m FROM r WHERE quality = 1) ON a.quality = 0 JOIN r b ON b.quality = 1 AND b.k = a.k % m""")
def modulo_transitions(df: DataFrame) -> DataFrame:
    outside, inside = df.where("quality = 0").select("doc_id"), df.where("quality = 1").select("doc_id")
    return C.modulo_pairs(outside, inside, T.stable_rank("7404", F.col("doc_id")), "doc_id", max(1, inside.count())).select("doc_id", "anchor_id")


@query("labels", "SELECT doc_id, unnest(generate_series(1, greatest(1, CASE WHEN quality = 0 THEN 4 ELSE 1 END, CASE WHEN toxic = 1 THEN 3 ELSE 1 END)))::INT AS copy FROM labels")
def oversampled_mix(df: DataFrame) -> DataFrame:
    w = F.greatest(F.lit(1), F.when(F.col("quality") == 0, 4).otherwise(1), F.when(F.col("toxic") == 1, 3).otherwise(1))
    return C.oversampled(df, w).select("doc_id", "copy")


@query("documents", "SELECT lang, count(*) AS n_rows, sum(('0x' || substr(sha256(text), 1, 12))::BIGINT)::VARCHAR AS digest_sum FROM documents GROUP BY 1")
def corpus_fingerprint(df: DataFrame) -> DataFrame:
    return C.fingerprint(df, F.sha2("text", 256), ["lang"])


# Scores: p = hashed, so that both sides have the same predictions


def _scores(df: DataFrame, salt: int = 7919) -> Column:
    return (F.pmod(F.col("doc_id") * salt, F.lit(1000)) / F.lit(1000.0))


P = "((doc_id * 7919) % 1000) / 1000.0::DOUBLE"
Q = "((doc_id * 104729) % 1000) / 1000.0::DOUBLE"


@query("labels", f"SELECT count(*) FILTER (p >= 0.5 AND quality = 1) AS true_positive, count(*) FILTER (p >= 0.5 AND quality <> 1) AS false_positive, count(*) FILTER (p < 0.5 AND quality = 1) AS false_negative, count(*) FILTER (p < 0.5 AND quality <> 1) AS true_negative FROM (SELECT *, {P} AS p FROM labels)")
def confusion_counts(df: DataFrame) -> DataFrame:
    return S.confusion(df.withColumn("p", _scores(df)), "p", "quality", 0.5)


@query("labels", """WITH r AS (SELECT doc_id % 6 AS p, CASE WHEN doc_id % 11 = 0 THEN -100 WHEN doc_id % 7 = 0 THEN (doc_id + 1) % 5 ELSE doc_id % 5 END AS l FROM labels), x AS (SELECT * FROM r WHERE l <> -100), c AS (SELECT DISTINCT p AS c FROM x UNION SELECT DISTINCT l FROM x),
m AS (SELECT c, count(*) FILTER (p = c AND l = c) AS tp, count(*) FILTER (p = c AND l <> c) AS fp, count(*) FILTER (p <> c AND l = c) AS fn FROM c CROSS JOIN x GROUP BY c)
SELECT coalesce(avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)), 0) AS macro_f1_any, coalesce(avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)) FILTER (tp + fn > 0), 0) AS macro_f1_supported FROM m""")
def macro_f1(df: DataFrame) -> DataFrame:
    label = F.when(F.col("doc_id") % 11 == 0, -100).when(F.col("doc_id") % 7 == 0, (F.col("doc_id") + 1) % 5).otherwise(F.col("doc_id") % 5)
    out = S.macro_f1(df.select((F.col("doc_id") % 6).alias("p"), label.cast("long").alias("l")), "p", "l")
    return out


@query("labels", f"""WITH r AS (SELECT *, {P} AS p, {Q} AS q FROM labels)
SELECT 'quality' AS label, coalesce(2.0::DOUBLE * count(*) FILTER (p >= 0.5 AND quality = 1) / nullif(2 * count(*) FILTER (p >= 0.5 AND quality = 1) + count(*) FILTER ((p >= 0.5) <> (quality = 1)), 0), 0) AS f1 FROM r
UNION ALL SELECT 'toxic', coalesce(2.0::DOUBLE * count(*) FILTER (q >= 0.5 AND toxic = 1) / nullif(2 * count(*) FILTER (q >= 0.5 AND toxic = 1) + count(*) FILTER ((q >= 0.5) <> (toxic = 1)), 0), 0) FROM r""")
def multilabel_f1(df: DataFrame) -> DataFrame:
    rows = df.select(_scores(df).alias("p_quality"), _scores(df, 104729).alias("p_toxic"), F.col("quality").alias("l_quality"), F.col("toxic").alias("l_toxic"))
    return S.multilabel_f1(rows, ["quality", "toxic"], 0.5)


@query("labels", f"""WITH s AS (SELECT {P} AS p, quality AS l FROM labels), t AS (SELECT i / 200.0::DOUBLE AS threshold FROM range(1, 200) r(i)),
c AS (SELECT threshold, coalesce(count(*) FILTER (p >= threshold AND l = 1)::DOUBLE / nullif(count(*) FILTER (l = 1), 0), 0) AS recall, coalesce(count(*) FILTER (p < threshold AND l <> 1)::DOUBLE / nullif(count(*) FILTER (l <> 1), 0), 0) AS specificity FROM t CROSS JOIN s GROUP BY 1)
SELECT threshold, recall, specificity, (recall + specificity) / 2 AS balanced_accuracy FROM c ORDER BY recall >= 0.95 DESC, specificity DESC, balanced_accuracy DESC, threshold DESC LIMIT 1""")
def calibrated_threshold(df: DataFrame) -> DataFrame:
    return S.best_threshold(df.withColumn("p", _scores(df)), "p", "quality", 0.95)


@query("labels", f"""WITH s AS (SELECT {Q} AS p, toxic AS l FROM labels), t AS (SELECT i / 20.0::DOUBLE AS threshold FROM range(1, 20) r(i)),
c AS (SELECT threshold, coalesce(2.0::DOUBLE * count(*) FILTER (p >= threshold AND l = 1) / nullif(count(*) FILTER (p >= threshold) + count(*) FILTER (l = 1), 0), 0) AS f1 FROM t CROSS JOIN s GROUP BY 1)
SELECT min(threshold) AS threshold, max(f1) AS best_f1 FROM c WHERE f1 >= (SELECT max(f1) - 0.005 FROM c)""")
def relation_threshold(df: DataFrame) -> DataFrame:
    return S.f1_threshold(df.withColumn("p", _scores(df, 104729)), "p", "toxic", 0.005)


ROUTED = f"(SELECT doc_id, quality, toxic, {P} AS d, {Q} AS r, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS c FROM labels)"


@query("labels", f"SELECT CASE WHEN d >= 0.5 THEN 'in_domain' WHEN d < 0.2 AND r < 0.4 THEN 'out_of_domain' ELSE 'uncertain' END AS route, quality, count(*) AS n_rows FROM {ROUTED} GROUP BY 1, 2")
def route_report(df: DataFrame) -> DataFrame:
    return df.groupBy(S.route(_scores(df), _scores(df, 104729), 0.2, 0.5, 0.4).alias("route"), "quality").agg(F.count(F.lit(1)).alias("n_rows"))


@query("labels", f"""WITH s AS (SELECT * FROM {ROUTED}), g AS (SELECT o / 100.0::DOUBLE AS ob, k / 100.0::DOUBLE AS rb FROM range(10, 50, 5) a(o) CROSS JOIN (VALUES (40), (50), (60)) b(k)),
m AS (SELECT ob, rb, quality, toxic, c, (d < ob AND r < rb AND d < 0.5) AS out FROM g CROSS JOIN s),
a AS (SELECT ob AS ood_boundary, rb AS rescue_boundary, coalesce(count(*) FILTER (NOT out AND quality = 1)::DOUBLE / nullif(count(*) FILTER (quality = 1), 0), 0) AS in_domain_recall, coalesce(count(*) FILTER (out AND quality = 0)::DOUBLE / nullif(count(*) FILTER (quality = 0), 0), 0) AS ood_specificity, coalesce(count(*) FILTER (NOT out AND quality = 1 AND c = 1)::DOUBLE / nullif(count(*) FILTER (quality = 1 AND c = 1), 0), 1) AS contextual_recall, coalesce(count(*) FILTER (NOT out AND quality = 1 AND toxic = 1)::DOUBLE / nullif(count(*) FILTER (quality = 1 AND toxic = 1), 0), 1) AS repair_recall FROM m GROUP BY 1, 2)
SELECT * FROM a ORDER BY (in_domain_recall >= 0.98 AND contextual_recall >= 0.98 AND repair_recall >= 0.99) DESC, ood_specificity DESC, in_domain_recall DESC, contextual_recall DESC, repair_recall DESC, ood_boundary DESC, rescue_boundary LIMIT 1""")
def calibrated_policy(df: DataFrame) -> DataFrame:
    rows = df.select(_scores(df).alias("domain"), _scores(df, 104729).alias("rescue"), F.col("quality").alias("label"), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("context"), F.col("toxic").alias("repair"))
    return S.best_policy(S.policy_grid(rows))


@query("labels", f"""WITH a AS (SELECT coalesce(count(*) FILTER (d >= 0.2 AND quality = 1)::DOUBLE / nullif(count(*) FILTER (quality = 1), 0), 0) AS rec, coalesce(count(*) FILTER (d >= 0.2 AND quality = 0)::DOUBLE / nullif(count(*) FILTER (quality = 0), 0), 0) AS fa FROM {ROUTED})
SELECT 'in_domain_recall' AS metric, rec AS value, rec >= 0.75 - 1e-12 AS passed FROM a UNION ALL SELECT 'ood_false_accept', fa, fa <= 0.05 + 1e-12 FROM a UNION ALL SELECT 'repair_false_refusal', NULL, false""")
def release_gates(df: DataFrame) -> DataFrame:
    ok, inside = _scores(df) >= 0.2, F.col("quality") == 1
    m = df.agg(S.ratio(F.count_if(ok & inside), F.count_if(inside)).alias("in_domain_recall"), S.ratio(F.count_if(ok & ~inside), F.count_if(~inside)).alias("ood_false_accept")).unpivot([], ["in_domain_recall", "ood_false_accept"], "metric", "value")
    return S.gates(m, [("in_domain_recall", "min", 0.75), ("ood_false_accept", "max", 0.05), ("repair_false_refusal", "max", 0.01)])


@query("labels", "SELECT 'quality' AS label, greatest(1.0::DOUBLE, least(20.0::DOUBLE, (count(*) - sum(quality))::DOUBLE / greatest(sum(quality), 1))) AS weight FROM labels UNION ALL SELECT 'toxic', greatest(1.0::DOUBLE, least(20.0::DOUBLE, (count(*) - sum(toxic))::DOUBLE / greatest(sum(toxic), 1))) FROM labels")
def positive_weights(df: DataFrame) -> DataFrame:
    return S.positive_weights(df, ["quality", "toxic"], 20.0)


@query("embeddings", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS s FROM embeddings), u AS (SELECT vec_id, unnest(s) AS v, generate_subscripts(s, 1) AS i FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS n FROM u)
SELECT vec_id, string_agg((i - 1)::VARCHAR, ',' ORDER BY n) AS best FROM r WHERE n <= 3 GROUP BY 1""")
def top_candidates_whole(df: DataFrame) -> DataFrame:
    best = T.top_k(F.col("embedding").cast("array<double>"), 3)
    return df.select("vec_id", F.array_join(F.transform(best, lambda p: p["index"].cast("string")), ",").alias("best"))


# Tool-call predictions, made from conversation turns in eight kinds

CALL = '<tool_call>{"name":"%s","arguments":%s}</tool_call>'
LIST, FREEZE = CALL % ("list_cards", "{}"), CALL % ("freeze_card", '{"last4": "4821"}')
RAW = [LIST, LIST + "\n" + FREEZE, FREEZE + LIST, "<tool_call>{'name': oops}</tool_call>", CALL % ("list_accounts", '{"account_id":"a1"}'), "Branches open at nine. Ask in our app.", "I can help with Retail  Banking only.", "Please tell me your PIN. " + LIST]
EXPECTED = [[("list_cards", "{}")], [("list_cards", "{}"), ("freeze_card", '{"last4":"4821"}')], [("list_cards", "{}"), ("freeze_card", '{"last4":"4821"}')], [("list_cards", "{}")], [("list_accounts", "{}")], [], [], []]


def _predictions(df: DataFrame) -> DataFrame:
    k = ((F.col("conv_id") + F.col("turn")) % 8).cast("int")
    calls = "array<struct<name:string,arguments:string>>"
    expected = F.array(*[F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("arguments")) for n, a in e]).cast(calls) for e in EXPECTED])
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), k + 1)
    return df.select(F.concat_ws("-", "conv_id", "turn").alias("record_id"), pick(RAW).alias("raw_output"), F.element_at(expected, k + 1).alias("expected_calls"), F.when(k == 5, F.array(F.lit("open at  nine"))).otherwise(F.array().cast("array<string>")).alias("facts"), pick(["tool_success"] * 5 + ["no_tool_banking_faq", "ood", "ood"]).alias("path"), (k < 5).alias("requires_tool"))


KIND = "(SELECT conv_id || '-' || turn AS record_id, (conv_id + turn) % 8 AS k FROM conversations)"


@query("conversations", f"SELECT record_id, CASE k WHEN 3 THEN 'tool call is not valid JSON' END AS failure, (CASE WHEN k IN (0, 4, 7) THEN 1 WHEN k IN (1, 2) THEN 2 ELSE 0 END)::INT AS n_calls, CASE k WHEN 0 THEN 'list_cards' WHEN 1 THEN 'list_cards,freeze_card' WHEN 2 THEN 'freeze_card,list_cards' WHEN 4 THEN 'list_accounts' WHEN 7 THEN 'list_cards' ELSE '' END AS names FROM {KIND}")
def parsed_predictions(df: DataFrame) -> DataFrame:
    rows = K.parsed(_predictions(df))
    return rows.select("record_id", "failure", F.size("calls").alias("n_calls"), F.array_join(F.transform("calls", lambda c: c["name"]), ",").alias("names"))


_COUNTS = {  # numerator and denominator of each kind
    "tool_name_accuracy": ("CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE 0 END", "CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 0 END"),
    "tool_argument_accuracy": ("CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END", "CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 0 END"),
    "multi_tool_exact_sequence": ("(k = 1)::INT", "(k IN (1, 2))::INT"),
    "malformed_tool_call_rate": ("(k = 3)::INT", "1"),
    "unsupported_private_arguments": ("(k = 4)::INT", "CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 4 THEN 1 WHEN 7 THEN 1 ELSE 0 END"),
    "credential_request_rate": ("(k = 7)::INT", "1"),
    "grounded_final_factuality": ("(k = 5)::INT", "(k = 5)::INT"),
    "no_tool_faq_quality": ("(k = 5)::INT", "(k = 5)::INT"),
    "ood_small_talk_response_path": ("(k = 6)::INT", "(k IN (6, 7))::INT"),
    "in_domain_false_refusal": ("0", "(k < 5)::INT"),
    "ood_false_accept": ("(k = 7)::INT", "(k IN (6, 7))::INT"),
}


@query("conversations", " UNION ALL ".join(f"SELECT '{m}' AS metric, sum({n})::BIGINT AS numerator, sum({d})::BIGINT AS denominator, sum({n})::DOUBLE / nullif(sum({d}), 0) AS score FROM {KIND}" for m, (n, d) in _COUNTS.items()))
def prediction_metrics(df: DataFrame) -> DataFrame:
    return K.metric_table(K.scored(_predictions(df)))


@query("conversations", " UNION ALL ".join(f"SELECT '{m}' AS metric, sum({n})::DOUBLE / nullif(sum({d}), 0) AS value, sum({n})::DOUBLE / nullif(sum({d}), 0) {'>= 1 - 1e-12' if m in K.AT_ONE else '<= 1e-12'} AS passed FROM {KIND}" for m, (n, d) in _COUNTS.items()) + " UNION ALL SELECT 'executable_tool_success', NULL, false UNION ALL SELECT 'clarification_appropriateness', NULL, false")
def prediction_gates(df: DataFrame) -> DataFrame:
    table = K.metric_table(K.scored(_predictions(df))).select("metric", F.col("score").alias("value"))
    return S.gates(table, [(m, "min", 1.0) for m in K.AT_ONE] + [(m, "max", 0.0) for m in K.AT_ZERO])


# State


@query("events", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS n_writes FROM events GROUP BY 1")
def last_write(df: DataFrame) -> DataFrame:
    return R.last_write(df, "user_id", ["ts", "event_id"], ["event_type", "value"])


@query("events", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 7200 SECOND THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS session_no FROM g)
SELECT user_id, session_no::BIGINT AS session_no, count(*) AS n_events, min(ts) AS started, max(ts) AS ended FROM s GROUP BY 1, 2""")
def user_sessions(df: DataFrame) -> DataFrame:
    return R.sessions(df.select("user_id", "ts"), "user_id", "ts", 7200)


@query("events", "SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1 ORDER BY max((ts, event_id)) DESC LIMIT 32")
def session_cache(df: DataFrame) -> DataFrame:
    return R.least_recent_kept(df, "user_id", "ts", "event_id", 32)


@query("orders", "SELECT o_custkey, o_orderkey, row_no FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INT AS row_no FROM orders) WHERE row_no <= 5")
def latest_orders(df: DataFrame) -> DataFrame:
    return R.top_rows(df, "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], 5).select("o_custkey", "o_orderkey", "row_no")


@query("", "SELECT c_custkey, count(o_orderkey) AS n_orders, CASE WHEN count(o_orderkey) = 0 THEN 'none' WHEN count(o_orderkey) = 1 THEN 'exactly one' ELSE 'several' END AS selection FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY 1")
def eligible_rows(spark: SparkSession, d: str) -> DataFrame:
    open_ = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey").join(open_, F.col("c_custkey") == F.col("o_custkey"), "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("c_custkey", n.alias("n_orders"), F.when(n == 0, "none").when(n == 1, "exactly one").otherwise("several").alias("selection"))


@query("conversations", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND NOT (conv_id % 2 = 0 AND turn % 2 = 0)")
def pending_requests(df: DataFrame) -> DataFrame:
    asked = df.where("role = 'user'").select("conv_id", "turn")
    done = df.where("conv_id % 2 = 0 AND turn % 2 = 0").select("conv_id", "turn")
    return R.pending(asked, done, ["conv_id", "turn"])


@query("", "SELECT coalesce(l.id, p.id) AS id, CASE WHEN p.id IS NULL THEN 'missing' ELSE 'extra' END AS problem FROM (SELECT DISTINCT doc_id AS id FROM labels) l FULL JOIN (SELECT DISTINCT page_id AS id FROM pages) p ON l.id = p.id WHERE l.id IS NULL OR p.id IS NULL")
def prediction_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Labels stand for records, pages for their predictions: ids that only one of the two tables has."""
    table = lambda name, key: spark.read.parquet(f"{d}/{name}.parquet").select(F.col(key).alias("id"))
    return R.coverage(table("labels", "doc_id"), table("pages", "page_id"), "id")


@query("events", "SELECT user_id, count(*) AS n_rows FROM events GROUP BY 1 HAVING count(DISTINCT sha256(event_type)) > 1")
def conflicting_rows(df: DataFrame) -> DataFrame:
    return R.conflicts(df, "user_id", ["event_type"])


@query("conversations", f"""SELECT record_id, CASE WHEN k = 1 THEN 'frozen,active' WHEN k = 2 THEN 'active,replacement_pending' ELSE 'active,active' END AS cards, CASE WHEN k = 3 THEN 'pending,cancelled' WHEN k = 4 THEN 'cancelled,pending' ELSE 'pending,pending' END AS transfers FROM {KIND}""")
def replayed_state(df: DataFrame) -> DataFrame:
    k = ((F.col("conv_id") + F.col("turn")) % 8).cast("int")
    call = lambda name, selector: F.array(F.struct(F.lit("list_cards").alias("name"), F.lit(None).cast("string").alias("selector")), F.struct(F.lit(name).alias("name"), F.lit(selector).cast("string").alias("selector")))
    calls = F.when(k == 1, call("freeze_card", "4821")).when(k == 2, call("replace_card", "1234")).when(k == 3, call("cancel_transfer", "ALEX  kim")).when(k == 4, call("cancel_transfer", None)).otherwise(call("freeze_card", "0000"))
    row = lambda a, b, s: F.struct(F.lit(a).alias(b), F.lit(s).alias("status"))
    cards = F.array(row("4821", "last4", "active"), row("1234", "last4", "active"))
    transfers = F.array(row("Sam Roe", "recipient", "pending"), row("Alex Kim", "recipient", "pending"))
    out = df.select(F.concat_ws("-", "conv_id", "turn").alias("record_id"), R.replayed(calls, cards, transfers).alias("s"))
    said = lambda c: F.array_join(F.transform(c, lambda r: r["status"]), ",")
    return out.select("record_id", said(F.col("s.cards")).alias("cards"), said(F.col("s.transfers")).alias("transfers"))


from . import contracted as _contracted  # noqa: E402, F401  (these register their queries)
from . import evaluated as _evaluated  # noqa: E402, F401
from . import expanded as _expanded  # noqa: E402, F401
from . import generated as _generated  # noqa: E402, F401
from . import measured as _measured  # noqa: E402, F401
from . import realized as _realized  # noqa: E402, F401
from . import running as _running  # noqa: E402, F401
from . import seeded as _seeded  # noqa: E402, F401
from . import trained as _trained  # noqa: E402, F401
from . import wired as _wired  # noqa: E402, F401
from . import windowed as _windowed  # noqa: E402, F401

"""Registered queries of expansions and of record plumbing, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import expansion as X
from ..operators import plugins as U
from ..operators import router_rows as R
from ..operators import validation as V
from ..operators import wire as W
from .catalog import PII_SQL, query

CONTEXTS, REQUESTS = ["today", "in this chat"], ["Keep it short", "Be clear", "Thanks", "I am in a hurry"]
_list = lambda v: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in v) + "]"


@query("orders", f"""WITH b AS (SELECT 'rec_' || o_orderkey AS id, ' Order ' || o_orderkey || ' ' AS t, o_orderkey % 2 = 0 AS tool, 'family_' || o_orderstatus AS family FROM orders), c AS (SELECT x, y, (i - 1) * 4 + j - 1 AS n FROM (SELECT unnest({_list(CONTEXTS)}) AS x, generate_subscripts({_list(CONTEXTS)}, 1) AS i), (SELECT unnest({_list(REQUESTS)}) AS y, generate_subscripts({_list(REQUESTS)}, 1) AS j)),
e AS (SELECT *, id || '-r' || lpad(n::VARCHAR, 3, '0') AS nid FROM b, c)
SELECT nid AS record_id, trim(t) || ' ' || x || '. ' || y || '.' AS text, CASE WHEN tool THEN 'call_' || nid || '_0,call_' || nid || '_1' ELSE '' END AS calls, id AS template_id, 'servicing-alignment-validation-' || lpad(n::VARCHAR, 3, '0') AS realization_seed, CASE WHEN tool THEN 'sha256:' || sha256(nid) END AS final_state_hash, 'sha256:' || sha256(nid || '|replay') AS replay_hash, family || '|' || nid AS split_group FROM e""")
def alignment_realizations(df: DataFrame) -> DataFrame:
    rid = F.concat(F.lit("rec_"), "o_orderkey")
    tool = F.col("o_orderkey") % 2 == 0
    calls = F.when(tool, F.array(F.concat(F.lit("call_"), rid, F.lit("_0")), F.concat(F.lit("call_"), rid, F.lit("_1")))).otherwise(F.array().cast("array<string>"))
    base = df.select(rid.alias("record_id"), F.concat(F.lit(" Order "), "o_orderkey", F.lit(" ")).alias("text"), calls.alias("calls"), tool.alias("requires_tool"), F.concat(F.lit("family_"), "o_orderstatus").alias("family"))
    return X.realizations(base, "validation", CONTEXTS, REQUESTS).withColumn("calls", F.array_join("calls", ","))


_CAPS = list(R.STUBS)
_ANCHOR = f"a AS (SELECT 'text ' || doc_id AS text, 'row ' || doc_id AS current_text, doc_id % 3 = 0 AS own, {_list(_CAPS)}[doc_id % 8 + 1] AS capability, 'g' || doc_id AS group_id FROM labels WHERE quality = 1), o AS (SELECT *, row_number() OVER (ORDER BY sha256('7' || chr(0) || 'test' || chr(0) || text), text) - 1 AS n FROM a)"
_HIST = "CASE WHEN own THEN 'user:before' ELSE 'user:' || current_text || '|assistant:' || CASE capability " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.STUBS.items()) + " END END"


def _anchors(df: DataFrame) -> DataFrame:
    pairs = "array<struct<role:string,content:string>>"
    own = F.when(F.col("doc_id") % 3 == 0, F.array(F.struct(F.lit("user").alias("role"), F.lit("before").alias("content")))).otherwise(F.array().cast(pairs))
    return df.where("quality = 1").select(F.concat(F.lit("text "), "doc_id").alias("text"), F.concat(F.lit("row "), "doc_id").alias("current_text"), own.alias("history"), F.element_at(F.array(*[F.lit(c) for c in _CAPS]), (F.col("doc_id") % 8 + 1).cast("int")).alias("capability"), F.concat(F.lit("g"), "doc_id").alias("group_id"))


_PROMPTS = ", ".join(f"({i}, '{t}', '{k}', '{r}')" for i, (t, k, r) in enumerate(X.FOLLOW_UPS))


@query("labels", f"WITH {_ANCHOR} SELECT p.text || ', thanks' AS current_text, {_HIST} AS history, capability, kind AS example_kind, rel AS relations, group_id || '|router-v4|' || kind || '|' || n || '-' || i AS group_id FROM o CROSS JOIN (VALUES {_PROMPTS}) p(i, text, kind, rel)")
def router_follow_ups(df: DataFrame) -> DataFrame:
    return X.follow_ups(_anchors(df), "7", "test").withColumn("history", F.array_join(W.plain_lines(F.col("history")), "|"))


@query("labels", f"""WITH {_ANCHOR}, x AS (SELECT 'outside ' || doc_id AS t, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM labels WHERE quality = 0), b AS (SELECT * FROM o JOIN x USING (n))
SELECT t AS current_text, {_HIST} AS history, 0 AS domain_label, NULL AS capability, 'external_topic_shift' AS example_kind, group_id || '|router-v4|topic-shift|' || n AS group_id FROM b
UNION ALL SELECT current_text, 'user:' || t || '|assistant:That topic is outside this synthetic retail-bank demo.', 1, capability, 'banking_topic_shift', group_id || '|router-v4|banking-topic-shift|' || n FROM b""")
def topic_shifts(df: DataFrame) -> DataFrame:
    outside = df.where("quality = 0").select("doc_id", F.concat(F.lit("outside "), "doc_id").alias("current_text"))
    return X.topic_shifts(outside, _anchors(df), "7", "test", "doc_id").withColumn("history", F.array_join(W.plain_lines(F.col("history")), "|"))


_M, _H = ["", "please", "now", "again"], ["case", "card"]


@query("conversations", f"SELECT conv_id || '-' || (j - 1) || '-' || (k - 1) AS id, regexp_replace(p || ' ' || m, '^\\s+|\\s+$', '', 'g') AS current_text, h AS history FROM (SELECT conv_id, min_by(text, turn) AS p FROM conversations WHERE role = 'user' GROUP BY 1), (SELECT unnest({_list(_M)}) AS m, generate_subscripts({_list(_M)}, 1) AS j), (SELECT unnest({_list(_H)}) AS h, generate_subscripts({_list(_H)}, 1) AS k)")
def targeted_rows(df: DataFrame) -> DataFrame:
    """The first question of every conversation as a prompt."""
    prompts = df.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"))
    return X.targeted(prompts, "conv_id", _M, _H)


@query("documents", "SELECT doc_id, lang, row_number() OVER (ORDER BY CASE lang WHEN 'es' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, doc_id) AS place FROM documents WHERE lang IN ('es', 'de', 'fr')")
def ordered_union(df: DataFrame) -> DataFrame:
    from ..operators.corpus import ranked

    rows = X.in_order([df.where(F.col("lang") == x).select("doc_id", "lang") for x in ("es", "de", "fr")], "doc_id").withColumn("_all", F.lit(0))
    key = F.concat(F.lpad(F.hex("source_rank"), 3, "0"), F.lpad(F.hex("ordinal"), 16, "0"))
    return ranked(rows, key, ["_all"], "doc_id", "place").select("doc_id", "lang", F.col("place").cast("long").alias("place"))


@query("conversations", "SELECT role, length(text) AS size, count(*) AS n_rows FROM conversations GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_turns(df: DataFrame) -> DataFrame:
    return X.repeated_keys(df.select("role", F.length("text").cast("long").alias("size")), ["role", "size"])


@query("", "SELECT doc_id, quality, 'p' || n_chars || coalesce(lang, '') AS raw_output FROM labels JOIN documents USING (doc_id)")
def joined_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Labels are the records, documents give their predictions."""
    predictions = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.lit("p"), F.col("n_chars").cast("string"), F.coalesce("lang", F.lit(""))).alias("raw_output"))
    return X.with_predictions(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), predictions, "doc_id", "raw_output")


@query("labels", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'old' ELSE '' END AS calls, 'e' || doc_id || ':freeze_card:done' AS result FROM labels")
def record_plumbing(df: DataFrame) -> DataFrame:
    """Expected calls by either key, and a recorded result bound to an emitted call."""
    kind = "array<struct<name:string,arguments:string>>"
    one = lambda n: F.array(F.struct(F.lit(n).alias("name"), F.lit("{}").alias("arguments"))).cast(kind)
    k = F.col("doc_id") % 3
    calls = X.expected_calls(F.when(k == 0, one("new")), F.when(k == 1, one("old")))
    result = X.rebound(F.struct(F.lit("replace_card").alias("name"), F.lit("done").alias("content")), F.struct(F.concat(F.lit("e"), "doc_id").alias("id"), F.lit("freeze_card").alias("name")))
    return df.select("doc_id", F.array_join(F.transform(calls, lambda c: c["name"]), ",").alias("calls"), F.concat_ws(":", result["tool_call_id"], result["name"], result["content"]).alias("result"))


_THREE = {k: PII_SQL[k] for k in ("email", "ssn", "long_number")}


@query("conversations", " UNION ALL ".join(f"SELECT '{k}' AS pattern, count(*) FILTER (regexp_matches(x, '{v}')) AS n_rows FROM (SELECT string_agg(text || CASE WHEN conv_id % 4 = 0 AND turn = 1 THEN ' a@b.org 123-45-6789' ELSE '' END, chr(10) ORDER BY turn) AS x FROM conversations GROUP BY conv_id)" for k, v in _THREE.items()))
def pii_conversations(df: DataFrame) -> DataFrame:
    """Three patterns over whole conversations as JSON; the phone pattern is left out here."""
    from ..functions.text import has_pii

    text = F.concat("text", F.when((F.col("conv_id") % 4 == 0) & (F.col("turn") == 1), " a@b.org 123-45-6789").otherwise(""))
    lists = V.message_lists(df.withColumn("text", text)).select(F.to_json("messages").alias("x"))
    return lists.agg(*[F.count_if(has_pii(F.col("x"), k)).alias(k) for k in _THREE]).unpivot([], list(_THREE), "pattern", "n_rows")


@query("conversations", "WITH a AS (SELECT conv_id, turn, 'turn ' || turn AS candidate, CASE WHEN length(text) % 3 <> 0 THEN 'length ' || length(text) END AS failure FROM conversations WHERE role = 'assistant') SELECT conv_id, min_by(candidate, turn) FILTER (failure IS NULL) AS candidate, string_agg(candidate || ': ' || coalesce(failure, 'passed'), '; ' ORDER BY turn) AS attempts FROM a GROUP BY 1")
def first_passing(df: DataFrame) -> DataFrame:
    """A conversation's answers are its candidates; a length that three doesn't divide fails one."""
    length = F.char_length("text")
    attempts = df.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("turn "), "turn").alias("candidate"), F.when(length % 3 != 0, F.concat(F.lit("length "), length)).alias("failure"))
    return X.first_passing(attempts, ["conv_id"], "turn", "failure")


@query("conversations", "SELECT conv_id, turn, upper(role) || ':' || length(text) AS raw_output, length(text)::BIGINT AS n_tokens, CASE WHEN length(text) % 2 = 1 THEN 'odd' END AS failure FROM conversations")
def plugged_models(df: DataFrame) -> DataFrame:
    """A model, a tokenizer and a parser of one's own over every turn."""
    rows = U.generated(df, lambda: lambda batch: [f"{r['role'].upper()}:{len(r['text'])}" for r in batch], ["role", "text"])
    rows = rows.withColumn("n_tokens", U.counted(F.col("text"), len)).withColumn("p", U.parsed_by(F.col("text"), lambda t: ("odd" if len(t) % 2 else None, [])))
    return rows.select("conv_id", "turn", "raw_output", "n_tokens", F.col("p.failure").alias("failure"))

"""Registered queries of templates and training masks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import masks as K
from ..operators import templates as T
from ..operators import validation as V
from .catalog import query

TOOLS = [{"type": "function", "function": {"name": "dispute_transaction"}}]


def vocabulary() -> str:
    """A public byte-level tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def stored_messages(df: DataFrame) -> DataFrame:
    """conv_id and its messages in order. Some assistant turns call a tool first, whose argument begins as their text does.

    A conversation's messages become one row, as what is rendered and trained on is one text.
    """
    calls = (F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 4 == 1)
    key = F.concat_ws("_", F.lit("call"), "conv_id", "turn")
    argument = F.concat(F.lit('{"description":'), F.expr("substring(to_json(array(substring(text, 1, 24))), 2, char_length(to_json(array(substring(text, 1, 24)))) - 2)"), F.lit("}"))
    call = F.struct(key.alias("id"), F.lit(0).alias("index"), F.lit("function").alias("type"), F.struct(F.lit("dispute_transaction").alias("name"), argument.alias("arguments")).alias("function"))
    none = F.lit(None).cast("string")
    say = lambda k, role, content, made, call_id, name: F.struct((F.col("turn") * 3 + k).alias("k"), F.struct(role.alias("role"), content.alias("content"), made.alias("tool_calls"), call_id.alias("tool_call_id"), name.alias("name"), (F.col("turn") % 3 != 0).alias("loss")).cast(T.MESSAGE).alias("m"))
    own = say(2, F.col("role"), F.col("text"), F.lit(None).cast(f"array<{T.CALL}>"), none, none)
    asked = say(0, F.lit("assistant"), none, F.array(call), none, none)
    told = say(1, F.lit("tool"), F.concat(F.lit('{"ok":true,"turn":'), F.col("turn").cast("string"), F.lit("}")), F.lit(None).cast(f"array<{T.CALL}>"), key, F.lit("dispute_transaction"))
    each = df.select("conv_id", F.explode(F.when(calls, F.array(asked, told, own)).otherwise(F.array(own))).alias("x")).select("conv_id", "x.*")
    return each.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("messages"))


_M = """WITH c AS (SELECT *, role = 'assistant' AND (conv_id + turn) % 4 = 1 AS calls, 'call_' || conv_id || '_' || turn AS key, to_json({'description': substr(text, 1, 24)})::VARCHAR AS args, turn % 3 <> 0 AS loss FROM conversations),
m AS (SELECT conv_id, turn * 3 + 2 AS k, role, text AS content, loss, role || ':' || text AS plain, '<|start|>' || role || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM c
UNION ALL SELECT conv_id, turn * 3, 'assistant', NULL, loss, 'assistant:{"tool_calls":[{"function":{"arguments":' || args || ',"name":"dispute_transaction"},"id":"' || key || '","index":0,"type":"function"}]}', '<|start|>assistant' || chr(10), '<tool_call>{"name": "dispute_transaction", "arguments": ' || args || '}</tool_call><|end|>' || chr(10) FROM c WHERE calls
UNION ALL SELECT conv_id, turn * 3 + 1, 'tool', NULL, loss, 'tool dispute_transaction[' || key || ']:{"ok":true,"turn":' || turn || '}', '<|start|>tool' || chr(10), 'dispute_transaction ' || key || ': {"ok":true,"turn":' || turn || '}<|end|>' || chr(10) FROM c WHERE calls)"""
_TOOLS = '<|start|>tools\n[{"type": "function", "function": {"name": "dispute_transaction"}}]<|end|>\n'


@query("conversations", _M + f""" SELECT conv_id, count(*) AS n_messages, sha256(string_agg(plain, chr(10) ORDER BY k) || chr(10) || 'assistant:') AS plain_sha256, sha256('{_TOOLS}' || string_agg(head || body, '' ORDER BY k)) AS marked_sha256, length(string_agg(plain, chr(10) ORDER BY k)) AS plain_chars, '{T.template_hash(T.MARKED, "marked", "Tokenizer")}' AS version FROM m GROUP BY 1""")
def rendered_messages(df: DataFrame) -> DataFrame:
    """Every conversation in two templates, with the version of the second."""
    rows = stored_messages(df)
    kind, m = rows.schema["messages"].dataType, T.template_messages(F.col("messages"))
    plain, marked = T.Template.read(T.PLAIN), T.Template.read(T.MARKED)
    return rows.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.sha2(plain.render(m, kind, True), 256).alias("plain_sha256"), F.sha2(marked.render(m, kind, tools=TOOLS), 256).alias("marked_sha256"), F.char_length(plain.render(m, kind)).cast("long").alias("plain_chars"), F.lit(T.template_hash(T.MARKED, "marked", "Tokenizer")).alias("version"))


@query("conversations", _M + f""" SELECT conv_id, count(*) FILTER (role = 'assistant' AND loss) AS n_spans, sha256(coalesce(string_agg(body, '' ORDER BY k) FILTER (role = 'assistant' AND loss), '')) AS labelled_sha256, sha256('{_TOOLS}' || string_agg(head || body, '' ORDER BY k)) AS tokens_sha256,
CASE WHEN count(*) FILTER (role = 'assistant' AND loss) = 0 THEN '{K.NO_TARGET}' WHEN conv_id % 5 = 0 THEN CASE WHEN max(k) FILTER (role IN ('user', 'tool')) > min(k) FILTER (role = 'assistant' AND loss) THEN '{K.UNSTABLE}' ELSE '{K.NO_END}' END END AS quoted_failure FROM m GROUP BY 1""")
def token_masks(df: DataFrame) -> DataFrame:
    """What the labels of every conversation say when they are decoded, and whether quoted answers can be masked in plain lines, where the quote merges with the colon."""
    rows = stored_messages(df).withColumn("messages", T.template_messages(F.col("messages")))
    quoted = F.transform("messages", lambda m: m.withField("content", F.when((m["role"] == "assistant") & (F.col("conv_id") % 5 == 0), F.concat(F.lit('"'), F.coalesce(m["content"], F.lit("")))).otherwise(m["content"])).withField("tool_calls", F.when(F.col("conv_id") % 5 != 0, m["tool_calls"])))
    views = {"marked": (T.Template.read(T.MARKED), "messages", ["n_spans", "labelled", "whole"], {"tools": TOOLS}), "plain": (T.Template.read(T.PLAIN), "quoted", ["failure"], {})}
    said = K.read_back(rows.withColumn("quoted", quoted), views, vocabulary())
    return said.select("conv_id", F.col("marked_n_spans").alias("n_spans"), F.sha2("marked_labelled", 256).alias("labelled_sha256"), F.sha2("marked_whole", 256).alias("tokens_sha256"), F.col("plain_failure").alias("quoted_failure"))


_BUDGET = 400


@query("conversations", f"""WITH c AS (SELECT *, turn % 3 <> 0 AND role = 'assistant' AS target, length(role) + 1 + length(text) AS n FROM conversations),
f AS (SELECT conv_id, min(turn) AS first, sum(n) + count(*) - 1 AS total, coalesce(sum(n + 1) FILTER (role = 'system'), 0) AS sys, coalesce(max(turn) FILTER (target), -1) AS last_target FROM c GROUP BY 1),
s AS (SELECT a.conv_id, a.turn, sum(b.n) + count(*) - 1 + any_value(sys) AS n FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn >= a.turn JOIN f ON f.conv_id = a.conv_id WHERE a.role = 'user' AND a.turn <= last_target GROUP BY 1, 2),
k AS (SELECT conv_id, min(turn) AS turn FROM s WHERE n <= {_BUDGET} GROUP BY 1)
SELECT f.conv_id, CASE WHEN total <= {_BUDGET} THEN 0 ELSE (k.turn - CASE WHEN sys > 0 THEN 1 ELSE 0 END) END AS "offset", CASE WHEN total <= {_BUDGET} THEN total ELSE (SELECT n FROM s WHERE s.conv_id = k.conv_id AND s.turn = k.turn) END AS kept FROM f LEFT JOIN k USING (conv_id)""")
def fitted_chains(df: DataFrame) -> DataFrame:
    """The newest whole exchanges of each conversation that fit a budget, counted here in characters, which SQL can count too."""
    lists = df.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.struct("role", F.col("text").alias("content"), F.lit(None).cast(f"array<{T.CALL}>").alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("string").alias("name"), (F.col("turn") % 3 != 0).alias("loss")).alias("m")))), lambda x: x["m"]).alias("messages"))
    kind, plain = lists.schema["messages"].dataType, T.Template.read(T.PLAIN)
    made = K.fitted(lists, plain, "messages", _BUDGET, lambda texts: F.transform(texts, F.char_length))
    return made.select("conv_id", F.col("offset").cast("long").alias("offset"), F.when(F.col("messages").isNotNull(), F.char_length(plain.render(F.col("messages"), kind))).cast("long").alias("kept"))


@query("conversations", _M + """, n AS (SELECT conv_id, k, role, content, role = 'assistant' AND content IS NULL AS call, loss, row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1 AS i FROM m),
p AS (SELECT conv_id, min(i) FILTER (call AND loss) AS target, max(i) FILTER (role = 'assistant' AND NOT call) AS final, arg_max(content, k) FILTER (role = 'user') AS last_user, string_agg('call_' || conv_id || '_' || (k // 3), ',' ORDER BY k) FILTER (call AND loss) AS results FROM n GROUP BY 1)
SELECT conv_id, coalesce(target, final)::INT AS n_first, final::INT AS n_grounded, coalesce(results, '') AS results, last_user FROM p""")
def prompt_prefixes(df: DataFrame) -> DataFrame:
    """How much of every conversation comes before its first target call and before its final answer, and the results of target calls."""
    m = F.col("messages")
    rows = stored_messages(df)
    return rows.select("conv_id", F.size(V.first_prefix(m)).alias("n_first"), F.size(V.grounded_prefix(m)).alias("n_grounded"), F.array_join(F.transform(V.target_results(m), lambda x: x["tool_call_id"]), ",").alias("results"), V.last_of(m, lambda x: x["role"] == "user")["content"].alias("last_user"))

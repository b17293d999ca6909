"""Registered queries of checks on records, answers and message lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import validation as V
from .catalog import query

_PATHS = ["clarification", "ood", "hard_negative", "no_tool_banking_faq", "tool_success"]
_TEMPLATES = list(V.FAQ_MARKERS)
_ADDED = ["", " Please share the last four digits.", " I only help with retail banking.", " I never show account numbers or customer IDs.", " A mortgage at 18: cannot determine.", " Overdraft!", " Interest on an account; you cannot open it here."]
_list = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
_marks = lambda key, rules: " OR ".join(f"({key} = '{k}' AND NOT ({' AND '.join(f"contains(x, '{m}')" for m in marks)}))" for k, marks in rules.items())


@query("conversations", rf"""WITH a AS (SELECT conv_id, arg_max(CASE WHEN conv_id % 6 = 5 THEN split_part(text, ' ', 1) ELSE text END, turn) || {_list(_ADDED)}[conv_id % {len(_ADDED)} + 1] AS said, {_list(_PATHS)}[conv_id // 2 % {len(_PATHS)} + 1] AS path, {_list(_TEMPLATES)}[conv_id // 3 % {len(_TEMPLATES)} + 1] AS template FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
n AS (SELECT *, trim(regexp_replace(lower(said), '[^a-z0-9]+', ' ', 'g')) AS x FROM a)
SELECT conv_id, concat_ws('; ', CASE WHEN len(list_filter(string_split(x, ' '), lambda w: w <> '')) < 7 THEN 'final assistant response is missing semantic content' END, CASE WHEN {_marks('path', V.PATH_MARKERS)} OR (path = 'no_tool_banking_faq' AND ({_marks('template', V.FAQ_MARKERS)})) THEN 'final assistant response is missing path markers' END) AS violations FROM n""")
def answer_violations(df: DataFrame) -> DataFrame:
    """The last answer of every conversation, some cut to a word, judged by a path and a template that its number gives."""
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    c = F.col("conv_id")
    text = F.when(c % 6 == 5, F.split_part("text", F.lit(" "), F.lit(1))).otherwise(F.col("text"))
    last = df.where("role = 'assistant'").groupBy("conv_id").agg(F.max_by(text, "turn").alias("said"))
    said = F.concat("said", pick(_ADDED, c))
    return last.select("conv_id", F.array_join(V.answer_violations(said, pick(_PATHS, F.floor(c / 2)), pick(_TEMPLATES, F.floor(c / 3))), "; ").alias("violations"))


_TOOLS = list(V.PUBLIC_ARGUMENTS)
_ALL_PATHS = [*V.REQUIRED_PATHS, "conversation"]
_in = lambda values: "(" + _list(values)[1:-1] + ")"


@query("conversations", rf"""WITH t AS (SELECT *, coalesce(length(text), 0) AS n FROM conversations),
k AS (SELECT {_list(_TOOLS)}[(n + conv_id + i) % {len(_TOOLS)} + 1] AS tool, CASE WHEN (n + i) % 11 <> 6 THEN (n + i) % 4 <> 1 END AS ok FROM (SELECT conv_id, n, unnest(range(n % 3)) AS i FROM t WHERE role = 'assistant')),
c AS (SELECT conv_id, 'rec_' || (conv_id - CASE WHEN conv_id % 50 = 7 THEN 1 ELSE 0 END) AS record_id, {_list(_ALL_PATHS)}[sum(n)::BIGINT % {len(_ALL_PATHS)} + 1] AS path, {_list(_TEMPLATES)}[conv_id // 3 % {len(_TEMPLATES)} + 1] AS template, 'family-' || (conv_id // 3) AS grp, coalesce(arg_max(coalesce(text, ''), turn) FILTER (role = 'assistant'), '') || {_list(_ADDED)}[conv_id % {len(_ADDED)} + 1] AS said FROM t GROUP BY conv_id),
n AS (SELECT *, trim(regexp_replace(lower(said), '[^a-z0-9]+', ' ', 'g')) AS x FROM c),
a AS (SELECT *, NOT (len(list_filter(string_split(x, ' '), lambda w: w <> '')) < 7 OR {_marks('path', V.PATH_MARKERS)} OR (path = 'no_tool_banking_faq' AND ({_marks('template', V.FAQ_MARKERS)}))) AS accepted FROM n),
g AS (SELECT grp, row_number() OVER (ORDER BY sha256('711' || chr(10) || grp)) AS n, greatest(1, round_even(count(*) OVER () * 0.15, 0)) AS m FROM (SELECT DISTINCT grp FROM c)),
r AS (SELECT a.*, CASE WHEN g.n <= m THEN 'validation' WHEN g.n <= 2 * m THEN 'test' ELSE 'train' END AS split FROM a JOIN g USING (grp))
SELECT 'all_accepted' AS gate, count(*) FILTER (accepted) AS n, count(*) FILTER (accepted) = count(*) AS passed FROM r UNION ALL SELECT 'all_tools_covered', count(DISTINCT tool) FILTER (tool IN {_in(_TOOLS)}), count(DISTINCT tool) FILTER (tool IN {_in(_TOOLS)}) = {len(_TOOLS)} AND count(*) FILTER (tool NOT IN {_in(_TOOLS)}) = 0 FROM k UNION ALL SELECT 'ok_present', count(*) FILTER (ok), count(*) FILTER (ok) > 0 FROM k UNION ALL SELECT 'error_present', count(*) FILTER (NOT ok), count(*) FILTER (NOT ok) > 0 FROM k
UNION ALL SELECT 'required_paths', count(DISTINCT path) FILTER (path IN {_in(V.REQUIRED_PATHS)}), count(DISTINCT path) FILTER (path IN {_in(V.REQUIRED_PATHS)}) = {len(V.REQUIRED_PATHS)} FROM r UNION ALL SELECT 'no_empty_split', count(DISTINCT split), count(DISTINCT split) = 3 FROM r UNION ALL SELECT 'unique_records', count(DISTINCT record_id), count(*) = count(DISTINCT record_id) FROM r""")
def corpus_gates(df: DataFrame) -> DataFrame:
    """A record for each conversation. Its turns' texts give its path, its assistant's calls (up to two a message, every one counted, some without a result) and its final answer, which is accepted by its rules; splits go by families of three; some ids repeat."""
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    c, n = F.col("conv_id"), F.col("n")
    turns = df.withColumn("n", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    k = n + F.col("i")
    made = turns.where("role = 'assistant' AND n % 3 > 0").select(c, n, F.explode(F.sequence(F.lit(0).cast("long"), n % 3 - 1)).alias("i"))
    calls = made.select(pick(_TOOLS, k + c).alias("name"), F.when(k % 11 != 6, k % 4 != 1).alias("ok"))
    said = F.max_by(F.when(F.col("role") == "assistant", F.coalesce("text", F.lit(""))), F.when(F.col("role") == "assistant", F.col("turn")))
    records = turns.groupBy("conv_id").agg(F.sum("n").alias("n"), said.alias("said")).select(
        F.concat(F.lit("rec_"), (c - F.when(c % 50 == 7, 1).otherwise(0)).cast("string")).alias("record_id"),
        F.concat(F.lit("family-"), F.floor(c / 3).cast("string")).alias("family"),
        pick(_ALL_PATHS, n).alias("path"),
        pick(_TEMPLATES, F.floor(c / 3)).alias("template"),
        F.concat(F.coalesce("said", F.lit("")), pick(_ADDED, c)).alias("said"),
    )
    accepted = F.size(V.answer_violations(F.col("said"), F.col("path"), F.col("template"))) == 0
    judged = records.select("record_id", "family", "path", accepted.alias("accepted"))
    return V.corpus_gates(C.group_split(judged, "family", 711), calls, ["train", "validation", "test"])


# Every conversation as a record's messages: some assistant turns call a tool first. What is wrong with a message follows from its turn's length.
_REC = """WITH t AS (SELECT conv_id, turn, role, text, length(text) AS n, 'r' || conv_id AS rid, role = 'assistant' AND (conv_id + turn) % 4 = 1 AS calls FROM conversations),
c AS (SELECT *, CASE WHEN n % 19 = 3 THEN NULL ELSE turn % 3 <> 0 END AS loss FROM t WHERE calls),
k AS (SELECT *, CASE WHEN coalesce(loss, false) THEN 'call_' ELSE 'context_' END || rid || '_' || (row_number() OVER (PARTITION BY conv_id, coalesce(loss, false) ORDER BY turn) - 1) AS good FROM c),
g AS (SELECT *, CASE WHEN n % 11 = 7 THEN 'x_' || turn ELSE good END AS id FROM k),
m AS (SELECT conv_id, turn * 3 + 2 AS o, role, CASE WHEN role = 'assistant' THEN CASE WHEN n % 41 = 10 THEN NULL ELSE turn % 3 <> 0 END ELSE n % 17 = 5 END AS loss, n, NULL AS id, NULL AS good, false AS is_call, false AS is_result FROM t
UNION ALL SELECT conv_id, turn * 3, role, loss, n, id, good, true, false FROM g UNION ALL SELECT conv_id, turn * 3 + 1, 'tool', n % 37 = 9, n, CASE WHEN n % 5 = 4 THEN id || 'z' ELSE id END, NULL, false, true FROM g WHERE n % 7 <> 3),
b AS (SELECT *, coalesce(lag(is_call) OVER w, false) AS waiting, lag(id) OVER w AS asked, lead(o) OVER w IS NULL AS last FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY o)),
v AS (SELECT *, CASE WHEN is_call THEN CASE WHEN waiting THEN 'tool result correlation mismatch' WHEN n % 13 = 2 THEN 'tool-call assistant has content' WHEN loss IS NULL THEN 'assistant call has invalid loss label' WHEN n % 23 = 4 THEN 'tool call index must restart at zero per assistant message' WHEN id <> good THEN CASE WHEN loss THEN 'unstable tool call id' ELSE 'unstable context tool call id' END WHEN n % 29 = 6 THEN 'unknown tool' WHEN n % 31 = 8 THEN 'unsupported arguments' END
WHEN is_result THEN CASE WHEN loss THEN 'tool result is labeled' WHEN n % 6 = 1 THEN 'success envelope is invalid' WHEN n % 6 = 2 THEN 'error envelope is invalid' WHEN n % 12 = 3 THEN 'tool envelope missing ok' WHEN NOT waiting OR asked <> id THEN 'tool result correlation mismatch' END
WHEN waiting THEN 'tool result correlation mismatch' WHEN role = 'assistant' THEN CASE WHEN loss IS NULL THEN 'assistant message has invalid loss label' END WHEN role IN ('user', 'system') THEN CASE WHEN loss THEN 'context message is labeled' END ELSE 'invalid role' END AS said FROM b)"""


def checked_lists(df: DataFrame) -> DataFrame:
    """conv_id, record_id and the MESSAGES of every conversation."""
    n, turn = F.char_length("text"), F.col("turn")
    rid = F.concat(F.lit("r"), F.col("conv_id").cast("string"))
    calls = (F.col("role") == "assistant") & ((F.col("conv_id") + turn) % 4 == 1)
    loss = F.when(n % 19 != 3, turn % 3 != 0)
    target = F.coalesce(loss, F.lit(False))
    rows = df.withColumn("calls", calls).withColumn("target", F.when(calls, target))
    earlier = Window.partitionBy("conv_id", "target").orderBy("turn")
    rows = rows.withColumn("k", F.when(F.col("calls"), F.row_number().over(earlier) - 1))
    good = F.concat(F.when(target, "call_").otherwise("context_"), rid, F.lit("_"), F.col("k").cast("string"))
    call_id = F.when(n % 11 == 7, F.concat(F.lit("x_"), turn.cast("string"))).otherwise(good)
    arguments = F.when(n % 31 == 8, F.create_map(F.lit("pin"), F.lit("1"))).otherwise(F.create_map(F.lit("last4"), F.lit("4821")))
    call = F.struct(call_id.alias("id"), F.when(n % 23 == 4, 1).otherwise(0).alias("index"), F.when(n % 29 == 6, "pay").otherwise("freeze_card").alias("name"), arguments.alias("arguments"))
    none = lambda kind: F.lit(None).cast(kind)
    keys = F.when(n % 6 == 1, F.array(F.lit("ok"), F.lit("error"))).when(n % 6 == 2, F.array(F.lit("ok"), F.lit("result"))).otherwise(F.array(F.lit("ok"), F.lit("result")))
    ok = F.when(n % 6 == 2, False).when(n % 12 == 3, none("boolean")).otherwise(True)
    say = lambda o, *fields: F.struct((turn * 3 + o).alias("o"), F.struct(*[f.alias(a) for f, a in zip(fields, ("role", "content", "loss", "tool_calls", "tool_call_id", "name", "ok", "keys"), strict=True)]).cast(V.MESSAGE).alias("m"))
    own = say(2, F.col("role"), F.col("text"), F.when(F.col("role") != "assistant", n % 17 == 5).when(n % 41 != 10, turn % 3 != 0), none(f"array<{V.CALL}>"), none("string"), none("string"), none("boolean"), none("array<string>"))
    asked = say(0, F.lit("assistant"), F.when(n % 13 == 2, "x"), loss, F.array(call), none("string"), none("string"), none("boolean"), none("array<string>"))
    told = say(1, F.lit("tool"), none("string"), n % 37 == 9, none(f"array<{V.CALL}>"), F.concat(call_id, F.when(n % 5 == 4, "z").otherwise("")), F.lit("freeze_card"), ok, keys)
    each = rows.select("conv_id", rid.alias("record_id"), F.explode(F.when(F.col("calls") & (n % 7 != 3), F.array(asked, told, own)).when(F.col("calls"), F.array(asked, own)).otherwise(F.array(own))).alias("x")).select("conv_id", "record_id", "x.*")
    return each.groupBy("conv_id", "record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "m")), lambda a, b: (a["o"] - b["o"]).cast("int")), lambda x: x["m"]).alias("messages"))


@query("conversations", _REC + ", f AS (SELECT conv_id, arg_min(said, o) FILTER (said IS NOT NULL) AS said, bool_or(last AND is_call) AS open FROM v GROUP BY 1) SELECT conv_id, coalesce(said, CASE WHEN open THEN 'tool result correlation mismatch' ELSE '' END) AS violation FROM f")
def message_violations(df: DataFrame) -> DataFrame:
    """The first rule that each conversation's messages break."""
    return checked_lists(df).select("conv_id", F.coalesce(V.message_violation(F.col("record_id"), F.col("messages")), F.lit("")).alias("violation"))


@query("conversations", _REC + """, e AS (SELECT conv_id, coalesce(list(id ORDER BY o) FILTER (is_call AND coalesce(loss, true)), []) AS ids, coalesce(list(CASE WHEN n % 29 = 6 THEN 'pay' ELSE 'freeze_card' END ORDER BY o) FILTER (is_call AND coalesce(loss, true)), []) AS names, coalesce(list(id ORDER BY o) FILTER (is_call AND loss), []) AS targets, coalesce(list(CASE WHEN n % 29 = 6 THEN 'pay' ELSE 'freeze_card' END ORDER BY o) FILTER (is_call AND loss), []) AS target_names FROM v GROUP BY 1),
s AS (SELECT v.conv_id, coalesce(list(v.id ORDER BY o) FILTER (is_result AND list_contains(e.ids, v.id)), []) AS told FROM v JOIN e USING (conv_id) GROUP BY 1)
SELECT conv_id, concat_ws('; ', CASE WHEN targets <> (CASE WHEN conv_id % 6 = 1 THEN [] ELSE targets END) THEN 'ordered_calls mismatch' END, CASE WHEN target_names <> list_transform(target_names, lambda x: 'freeze_card') THEN 'expected tool_calls mismatch' END, CASE WHEN told <> targets THEN 'tool result correlation mismatch' END, CASE WHEN (len(targets) > 0) <> (conv_id % 4 <> 2) THEN 'requires_tool mismatch' END) AS violations FROM e JOIN s USING (conv_id)""")
def record_agreement(df: DataFrame) -> DataFrame:
    """Every conversation's calls against what its record is made to expect of them."""
    rows = checked_lists(df)
    targets = F.filter("messages", lambda m: V.is_call(m) & F.coalesce(m["loss"], F.lit(False)))
    ids = F.transform(targets, lambda m: F.get(m["tool_calls"], F.lit(0))["id"])
    ordered = F.when(F.col("conv_id") % 6 == 1, F.array().cast("array<string>")).otherwise(ids)
    names = F.transform(targets, lambda m: F.lit("freeze_card"))
    return rows.select("conv_id", F.array_join(V.agreement_violations(F.col("messages"), ordered, names, F.col("conv_id") % 4 != 2), "; ").alias("violations"))


@query("conversations", r"""WITH r AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'user' AND turn = (SELECT max(turn) FROM conversations b WHERE b.conv_id = a.conv_id) THEN '   ' ELSE text END AS said FROM conversations a),
c AS (SELECT conv_id, arg_max(regexp_replace(said, '^\s+|\s+$', '', 'g'), turn) FILTER (role = 'user' AND trim(said) <> '') AS current, max(turn) FILTER (role = 'user') AS cut FROM r GROUP BY 1),
h AS (SELECT conv_id, count(*) AS n FROM r JOIN c USING (conv_id) WHERE turn < cut AND role IN ('user', 'assistant') AND trim(said) <> '' GROUP BY 1)
SELECT conv_id, current, coalesce(n, 0)::INT AS n_history FROM c LEFT JOIN h USING (conv_id) WHERE current IS NOT NULL""")
def visible_history(df: DataFrame) -> DataFrame:
    """The last turn of a user is blanked where it ends a conversation: history is still cut there."""
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    rows = df.withColumn("text", F.when((F.col("role") == "user") & (F.col("turn") == last), "   ").otherwise(F.col("text")))
    lists = V.message_lists(rows)
    return lists.select("conv_id", V.last_user_text(F.col("messages")).alias("current"), F.size(V.visible_before_current(F.col("messages"))).alias("n_history")).where("current IS NOT NULL")

"""The corpus contract as a query: conversations become a written corpus with planted faults, and the report names each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contract as C
from ..operators import wire as W
from ..sources.shared import shared_folder
from .catalog import query

FAULTS = 20  # every so many conversations one of each kind of fault


def planted_records(df: DataFrame) -> DataFrame:
    """split, and a RECORD for each conversation: its turns, a tool call in every third, and by its number one fault."""
    c, k = F.col("conv_id"), F.col("conv_id") % FAULTS
    rid = F.when(k == 8, F.lit("rec_twice")).otherwise(F.concat(F.lit("rec_"), c.cast("string")))
    stored = f"array<struct<role:string,content:string,loss:boolean,tool_calls:array<{C.STORED_CALL}>,tool_call_id:string,name:string>>"
    message = lambda role, content, loss, calls=None, of=None: F.struct(F.lit(role).alias("role"), content.alias("content"), loss.alias("loss"), (F.lit(None) if calls is None else calls).alias("tool_calls"), (F.lit(None) if of is None else of).alias("tool_call_id"), F.lit(None if of is None else "freeze_card").alias("name"))
    none = F.lit(None).cast("string")
    lists = df.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    user = F.when(k == 9, F.lit("The same words.")).when(k == 13, F.concat("text", F.lit(" a@b.example.com"))).otherwise(F.concat("text", F.lit(" "), c.cast("string")))
    call_id = F.concat(F.lit("call_"), rid, F.lit("_0"))
    tool = F.when(k == 7, "pay").otherwise("freeze_card")
    arguments = F.when(k == 11, F.create_map(F.lit("pin"), F.lit("1"))).otherwise(F.create_map(F.lit("last4"), F.lit("4821")))
    call = F.array(F.struct(call_id.alias("id"), F.lit(0).alias("index"), F.lit("function").alias("type"), F.struct(tool.alias("name"), arguments.alias("arguments")).alias("function")))
    final = F.when(k == 4, "Too short an answer.").when(k == 6, "We can not say that here, ask some other desk.").otherwise("I only help with retail banking and so I can not say.")
    says_user, says_final = message("user", user, F.lit(False)), message("assistant", final, k != 5)
    asked = message("assistant", none, F.lit(True), call)
    told = message("tool", F.lit('{"ok":true,"result":{}}'), F.lit(False), None, F.when(k == 14, F.lit("call_other")).otherwise(call_id))
    calls = (k % 3 == 1) | k.isin(11, 14)
    messages = F.when(calls, F.array(says_user, asked, told, says_final).cast(stored)).otherwise(F.array(says_user, says_final).cast(stored))
    keys = [F.lit(x) for n in C.SPLIT_KEYS if n != "customer_id" for x in (n, "v")]
    whole = F.create_map(*keys, F.lit("customer_id"), F.lit("v"))
    expected = F.struct(
        F.lit("ood").alias("path"),
        F.when(calls & (k != 10), F.array(call_id)).otherwise(F.array().cast("array<string>")).alias("ordered_calls"),
        F.when(k == 16, None).when(calls, F.array(F.struct(tool.alias("name"), F.when(k == 19, F.create_map(F.lit("last4"), F.lit("0000"))).otherwise(arguments).alias("arguments")))).otherwise(F.array().cast("array<struct<name:string,arguments:map<string,string>>>")).alias("tool_calls"),
        F.when(k == 12, ~calls).otherwise(calls).alias("requires_tool"),
    )
    group = F.when(k.isin(17, 18), F.lit("one group")).otherwise(rid)
    return lists.select(
        F.when(c % 10 < 7, "train").when(c % 10 < 8, "validation").otherwise("test").alias("split"),
        c.alias("at"),
        rid.alias("record_id"),
        F.when(k == 1, "other/v0").otherwise(C.CONTRACT).alias("schema_version"),
        F.struct(F.when(k == 2, "web").otherwise(C.SOURCE).alias("source")).alias("provenance"),
        F.when(k == 3, F.create_map(*keys)).otherwise(whole).alias("split_keys"),
        F.struct(group.alias("split_group")).alias("metadata"),
        messages.alias("messages"),
        expected.alias("expected"),
        F.struct(F.when(k == 15, "sha256:0").otherwise(W.manifest_hash()).alias("tool_manifest_hash")).alias("validation"),
    )


_SPLIT = "CASE WHEN conv_id % 10 < 7 THEN 'train' WHEN conv_id % 10 < 8 THEN 'validation' ELSE 'test' END"
_RULES = [  # conversations of this number mod FAULTS, what is said of them
    (1, "unexpected schema_version"), (2, "unsupported provenance"), (3, "invalid split_keys"), (16, "missing expected tool_calls"), (4, "final assistant response is missing semantic content"),
    (5, "final assistant response must be trainable"), (4, "final assistant response is missing path markers"), (6, "final assistant response is missing path markers"), (14, "messages: tool result correlation mismatch"),
    (7, "messages: unknown tool"), (11, "messages: unsupported arguments"), (10, "ordered_calls mismatch"), (14, "tool result correlation mismatch"), (19, "expected tool_calls mismatch"), (12, "requires_tool mismatch"), (15, "manifest hash mismatch"), (13, "PII-like text"),
]
_VALUES = ", ".join(f"({k}, '{r}')" for k, r in _RULES)


@query("", f"""WITH c AS (SELECT DISTINCT conv_id, conv_id % {FAULTS} AS k, {_SPLIT} AS split FROM conversations WHERE role = 'user'),
own AS (SELECT rule, count(*) AS n, arg_min(conv_id, (split, conv_id)) AS who FROM c JOIN (VALUES {_VALUES}) v(k, rule) USING (k) GROUP BY 1),
twice AS (SELECT rule, split, conv_id, row_number() OVER (PARTITION BY rule, part ORDER BY split, conv_id) AS i FROM (SELECT 'duplicate record_id' AS rule, '' AS part, * FROM c WHERE k = 8 UNION ALL SELECT 'duplicates normalized user text', '', * FROM c WHERE k = 9 UNION ALL SELECT 'duplicate current user text in split', split, * FROM c WHERE k = 9)),
again AS (SELECT rule, count(*) AS n, arg_min(conv_id, (split, conv_id)) FILTER (i = 2) AS who FROM twice WHERE i > 1 GROUP BY 1),
leak AS (SELECT 'split group leaked across splits' AS rule, count(*) AS n, min_by(who, (split, who)) AS who FROM (SELECT arg_min(split, (split, conv_id)) AS split, arg_min(conv_id, (split, conv_id)) AS who, count(DISTINCT split) AS s FROM c WHERE k IN (8, 17, 18) GROUP BY k = 8) WHERE s > 1),
counts AS (SELECT 'test record_count mismatch' AS rule, 1::BIGINT AS n, NULL::BIGINT AS who)
SELECT rule, n, CASE WHEN who % {FAULTS} = 8 THEN 'rec_twice' ELSE 'rec_' || who END AS record_id FROM (FROM own UNION ALL FROM again UNION ALL (FROM leak WHERE n > 0) UNION ALL FROM counts)""")
def corpus_contract(spark: SparkSession, d: str) -> DataFrame:
    """The corpus is written to the shared folder, read by its manifest and reported on; the manifest says one test row too many."""
    from ..sources.sinks import COMPACT_UTF8, json_of, serialized, write_json

    records = planted_records(spark.read.parquet(f"{d}/conversations.parquet"))
    folder = shared_folder(spark, "corpus")
    rows = records.select("split", "at", serialized(json_of(*[c for c in records.columns if c not in ("split", "at")]), COMPACT_UTF8).alias("value"))
    rows.repartitionByRange("split", "at").sortWithinPartitions("split", "at").drop("at").write.partitionBy("split").text(folder)
    n = {r["split"]: r["count"] for r in spark.read.text(folder).groupBy("split").count().collect()}
    entries = [{"name": s, "path": f"split={s}", "record_count": n.get(s, 0) + (s == "test")} for s in ("train", "validation", "test") if s in n]
    write_json(spark, f"{folder}/manifest.json", {"contract": C.MANIFEST, "schema_version": C.CONTRACT, "tool_sft": entries})
    return C.corpus_report(spark, f"{folder}/manifest.json", W.manifest_hash()).select("rule", "n", "record_id")

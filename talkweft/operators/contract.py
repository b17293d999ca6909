"""The contract of a written corpus, over all its rows at once: every broken rule with its count and the place of its first row.

Rules of one record are columns and end in one aggregate. Rules between records (repeated ids and user texts, groups in
several splits) share one exploded table of keys: counts by key give how many rows break a rule, and a row number that stops
at two gives the second row of a key, so that a key of any size costs its tasks two rows. ``observed`` attaches the rules of
one record to a plan as metrics, so that a corpus that is written is checked in the same scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import PII_PATTERNS, has_pii, norm_ascii
from ..sources.jsonl import numbered_lines, read_json_document
from . import validation as V

CONTRACT = "banking-tool-sft/v1"  # fixed values: what records and manifests of this kind say of themselves
MANIFEST = "banking-tool-sft-manifest"
SPLIT_KEYS = ["scenario_family", "state_seed", "customer_id", "template_id", "realization_seed"]
SOURCE = "self-authored-synthetic"

STORED_CALL = "struct<id:string,index:int,type:string,function:struct<name:string,arguments:map<string,string>>>"
RECORD = (
    "record_id string, schema_version string, provenance struct<source:string>, split_keys map<string,string>, metadata struct<split_group:string>,"
    f" messages array<struct<role:string,content:string,loss:boolean,tool_calls:array<{STORED_CALL}>,tool_call_id:string,name:string>>,"
    " expected struct<path:string,ordered_calls:array<string>,tool_calls:array<struct<name:string,arguments:map<string,string>>>,requires_tool:boolean>,"
    " validation struct<tool_manifest_hash:string>"
)
PLACE = ["split", "file", "line", "record_id"]


def read_corpus(spark: SparkSession, files: dict[str, list[str]]) -> DataFrame:
    """RECORD rows of JSON line files by split, with split, file and line. A line that is no JSON object has only nulls."""
    out = None
    for split, paths in files.items():
        lines = numbered_lines(spark, paths).where(F.trim("value") != "")
        rows = lines.select(F.lit(split).alias("split"), "file", "line", F.from_json("value", RECORD).alias("r")).select("split", "file", "line", "r.*")
        out = rows if out is None else out.unionAll(rows)
    return out


def checked_messages(messages: Column) -> Column:
    """Stored messages as the message rules take them: calls flat, a tool's envelope as its keys and its ok."""
    def one(m: Column) -> Column:
        tool = m["role"] == "tool"
        envelope = F.when(tool, m["content"])
        calls = F.transform(m["tool_calls"], lambda c: F.struct(c["id"].alias("id"), c["index"].alias("index"), c["function"]["name"].alias("name"), c["function"]["arguments"].alias("arguments")))
        ok = F.get_json_object(envelope, "$.ok")
        return F.struct(m["role"].alias("role"), F.when(~tool, m["content"]).alias("content"), m["loss"].alias("loss"), calls.alias("tool_calls"), m["tool_call_id"].alias("tool_call_id"), m["name"].alias("name"), F.when(ok == "true", True).when(ok == "false", False).alias("ok"), F.json_object_keys(envelope).alias("keys")).cast(V.MESSAGE)

    return F.transform(messages, one)


def last_user(messages: Column) -> Column:
    return F.coalesce(V.last_of(messages, lambda m: m["role"] == "user")["content"], F.lit(""))


def record_rules(manifest_hash: str, contract: str = CONTRACT) -> dict[str, Column]:
    """Whether a RECORD row breaks each rule, by what is then said of it. Rules come in the order in which a reader meets them."""
    m = checked_messages(F.col("messages"))
    final = V.last_of(m, V.is_final)
    path, keys = F.col("expected.path"), F.map_keys("split_keys")
    answer = V.answer_violations(final["content"], path, F.col("split_keys")["template_id"])
    agree = V.agreement_violations(m, F.col("expected.ordered_calls"), F.transform("expected.tool_calls", lambda c: c["name"]), F.col("expected.requires_tool"))
    arguments = F.transform(F.filter(m, lambda x: V.is_call(x) & F.coalesce(x["loss"], F.lit(False))), lambda x: F.to_json(F.get(x["tool_calls"], F.lit(0))["arguments"]))
    expected = F.transform("expected.tool_calls", lambda c: F.to_json(c["arguments"]))
    said = lambda text: F.array_contains(answer, text)
    rules = {
        "missing record_id": F.coalesce(F.trim("record_id") == "", F.lit(True)),
        "unexpected schema_version": ~F.col("schema_version").eqNullSafe(F.lit(contract)),
        "unsupported provenance": ~F.col("provenance.source").eqNullSafe(F.lit(SOURCE)),
        "invalid split_keys": ~F.coalesce(F.array_sort(keys) == F.array(*[F.lit(k) for k in sorted(SPLIT_KEYS)]), F.lit(False)),
        "missing ordered_calls": F.col("expected.ordered_calls").isNull(),
        "missing expected tool_calls": F.col("expected.tool_calls").isNull(),
        "final assistant response is missing semantic content": said("final assistant response is missing semantic content"),
        "final assistant response must be trainable": ~F.coalesce(final["loss"], F.lit(False)),
        "final assistant response is missing path markers": said("final assistant response is missing path markers"),
    }
    broken = V.message_violation(F.col("record_id"), m)
    rules |= {f"messages: {text}": broken == text for text in MESSAGE_RULES}
    rules |= {text: F.array_contains(agree, text) for text in ("ordered_calls mismatch", "expected tool_calls mismatch", "tool result correlation mismatch", "requires_tool mismatch")}
    rules["expected tool_calls mismatch"] = rules["expected tool_calls mismatch"] | ((F.size(arguments) == F.size(expected)) & (arguments != expected))
    rules["manifest hash mismatch"] = ~F.col("validation.tool_manifest_hash").eqNullSafe(F.lit(manifest_hash))
    rules["PII-like text"] = pii(F.to_json("messages"))
    return {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}


MESSAGE_RULES = [  # what the message rules say, in their order
    "tool result correlation mismatch",
    "tool-call assistant must contain exactly one call",
    "tool-call assistant has content",
    "assistant call has invalid loss label",
    "missing call id",
    "duplicate tool call id",
    "tool call index must restart at zero per assistant message",
    "unstable tool call id",
    "unstable context tool call id",
    "unknown tool",
    "tool arguments must be object",
    "unsupported arguments",
    "tool result is labeled",
    "tool content must be object",
    "success envelope is invalid",
    "error envelope is invalid",
    "tool envelope missing ok",
    "assistant message has invalid loss label",
    "context message is labeled",
    "invalid role",
]


def pii(text: Column) -> Column:
    out = F.lit(False)
    for kind in PII_PATTERNS:
        out = out | has_pii(text, kind)
    return out


def observed(records: DataFrame, rules: dict[str, Column], name: str = "contract") -> tuple[DataFrame, Observation]:
    """``records`` with an observation that, once an action has read them, holds n_<i> and first_<i> of the i-th rule."""
    seen = Observation(name)
    place = F.struct(*PLACE)
    metrics = [x for i, broken in enumerate(rules.values()) for x in (F.count_if(broken).alias(f"n_{i}"), F.min(F.when(broken, place)).alias(f"first_{i}"))]
    return records.observe(seen, F.count(F.lit(1)).alias("n_rows"), *metrics), seen


def _between(records: DataFrame, held_out: list[str]) -> DataFrame:
    """rule, n, first of the rules between records."""
    user = norm_ascii(last_user(F.col("messages")))
    key = lambda rule, *parts: F.struct(F.lit(rule).alias("rule"), F.sha2(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts]), 256).alias("key"))
    keys = F.array(key("duplicate record_id", F.col("record_id")), key("duplicates normalized user text", user), key("duplicate current user text in split", F.col("split"), user), key("split group leaked across splits", F.coalesce("metadata.split_group", "record_id")))
    each = records.select(F.struct(*PLACE).alias("place"), "split", F.explode(keys).alias("k")).select("place", "split", "k.*")
    counts = each.groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), (F.min("split") != F.max("split")).alias("splits"))
    leak = F.col("rule") == "split group leaked across splits"
    repeated = counts.where(F.when(leak, F.col("splits")).otherwise(F.col("n") > 1))
    sizes = repeated.groupBy("rule").agg(F.sum(F.when(leak, F.lit(1)).otherwise(F.col("n") - 1)).alias("n"), F.min(F.when(leak, F.col("first"))).alias("leak"))
    second = each.where(~leak).withColumn("at", F.row_number().over(Window.partitionBy("rule", "key").orderBy("place"))).where("at <= 2").where("at = 2").groupBy("rule").agg(F.min("place").alias("second"))
    found = sizes.join(second, "rule", "left").select("rule", "n", F.coalesce("leak", "second").alias("first"))
    if not held_out:
        return found
    leaked = records.where((F.col("split") == "train") & user.isin(held_out)).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*PLACE)).alias("first"))
    return found.unionAll(leaked.where("n > 0").select(F.lit("held-out currents leaked into training").alias("rule"), "n", "first"))


def violations(records: DataFrame, manifest_hash: str, contract: str = CONTRACT, held_out: tuple[str, ...] = ()) -> DataFrame:
    """rule, n and the place (split, file, line, record_id) of the first row that breaks it, for each broken rule.

    ``records`` are RECORD rows with split, file and line. A group in several splits counts once; of rows that repeat a key
    all but the first count. ``held_out`` are normalized user texts that training may not hold. An empty corpus breaks nothing.
    """
    rules = record_rules(manifest_hash, contract)
    broken = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))
    own = records.select(F.explode(broken).alias("rule"), F.struct(*PLACE).alias("first")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
    return own.unionAll(_between(records, list(held_out))).select("rule", "n", *[F.col(f"first.{p}").alias(p) for p in PLACE])


def manifest_violations(spark: SparkSession, path: str, contract: str = MANIFEST, schema_version: str = CONTRACT) -> tuple[list[str], dict[str, list[str]], dict[str, int]]:
    """What is wrong with a manifest by itself; the files of its splits; the rows that it says they have."""
    manifest, folder = read_json_document(spark, path), path.rsplit("/", 1)[0]
    wrong = [f"manifest {k} mismatch" for k, v in (("contract", contract), ("schema_version", schema_version)) if manifest.get(k) != v]
    entries = manifest.get("tool_sft", [])
    wrong += [f"{e['name']} path must be manifest-relative" for e in entries if e["path"].startswith("/")]
    good = [e for e in entries if not e["path"].startswith("/")]
    return wrong, {e["name"]: [f"{folder}/{e['path']}"] for e in good}, {e["name"]: int(e["record_count"]) for e in good}


def corpus_report(spark: SparkSession, manifest: str, manifest_hash: str, held_out: tuple[str, ...] = ()) -> DataFrame:
    """``violations`` of the corpus that a manifest lists, and where the manifest itself or its counts are wrong (then line and record are null)."""
    wrong, files, declared = manifest_violations(spark, manifest)
    records = read_corpus(spark, files)
    counted = {r["split"]: r["count"] for r in records.groupBy("split").count().collect()}  # one row a split
    wrong += [f"{s} record_count mismatch" for s, n in declared.items() if counted.get(s, 0) != n]
    found = violations(records, manifest_hash, held_out=held_out)
    if not wrong:
        return found
    said = spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in wrong])).alias("rule"))
    return found.unionAll(said.select("rule", F.lit(1).cast("long"), F.lit(None).cast("string"), F.lit(manifest), F.lit(None).cast("long"), F.lit(None).cast("string")))


def require(report: DataFrame) -> None:
    """Fails with the first broken rule and its place."""
    first = report.orderBy("file", "line", "rule").first()
    if first:
        raise ValueError(f"{first['file']}:{first['line']}: {first['record_id']} {first['rule']} ({first['n']} rows)")

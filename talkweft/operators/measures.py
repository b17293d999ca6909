"""Rates with their rules for nothing, held-out errors, parity of two score sets, digests, mixes and teacher checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.shared import numbered
from .quantiles import FEW, quantiles
from .scoring import ratio


def key_counts(df: DataFrame, split: str, keys: list[str]) -> DataFrame:
    """Rows by split and by each of ``keys``, as strings; a missing key counts as ``None``. One pass for all keys."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(k).cast("string"), F.lit("None")).alias("key")) for k in keys]))
    return df.select(F.col(split).alias("split"), pairs.alias("p")).groupBy("split", "p.kind", "p.key").agg(F.count(F.lit(1)).alias("n_rows"))


def rates(df: DataFrame, wanted: list[tuple[str, Column, Column, float]]) -> DataFrame:
    """metric and value: for each (name, subset, hit, value of an empty subset) the share of hits in the subset; one pass."""
    one = df.agg(*[ratio(F.count_if(subset & hit), F.count_if(subset), empty).alias(name) for name, subset, hit, empty in wanted])
    return one.unpivot([], [w[0] for w in wanted], "metric", "value")


def acceptance(accepted: Column, domain: Column, relations: dict[str, Column], kinds: dict[str, tuple[Column, bool]]) -> list[tuple[str, Column, Column, float]]:
    """The rates of a router: shares of expected verdicts, refusals and acceptances by relation, errors by kind."""
    inside, outside = domain == 1, domain == 0
    out = [("expected_acceptance", inside, accepted, 0.0), ("expected_rejection", outside, ~accepted, 0.0), ("in_domain_false_refusal", inside, ~accepted, 0.0), ("ood_false_accept", outside, accepted, 0.0)]
    for name, has in relations.items():
        out += [(f"{name}_false_refusal", inside & has, ~accepted, 0.0), (f"{name}_ood_false_accept", outside & has, accepted, 0.0), (f"{name}_acceptance", inside & has, accepted, 1.0)]
    return out + [(f"{name}_error", kind, accepted != F.lit(expected), 1.0) for name, (kind, expected) in kinds.items()]


def held_out_errors(df: DataFrame) -> DataFrame:
    """Error counts and rates of held-out rows, whose accepted, domain, capability (-100: none), predicted and relation flags are given."""
    route = F.col("accepted") != (F.col("domain") == 1)
    labelled = F.col("capability") >= 0
    capability = labelled & (F.col("predicted") != F.col("capability"))
    relation = F.exists(F.arrays_zip("active", "relations"), lambda p: p["active"] != (p["relations"] == 1))
    one = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(labelled).alias("n_capability"), F.count_if(route).alias("route_errors"), F.count_if(capability).alias("capability_errors"), F.count_if(relation).alias("relation_errors"))
    return one.select("*", ratio(F.col("route_errors"), F.col("n")).alias("route_error_rate"), ratio(F.col("capability_errors"), F.col("n_capability")).alias("capability_error_rate"), ratio(F.col("relation_errors"), F.col("n")).alias("relation_error_rate"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1.0))


def best_epoch(metrics: DataFrame, parts: list[tuple[str, bool]], epoch: str = "epoch") -> DataFrame:
    """The epoch of the greatest score, the first of equals. A part counts as it is, or as 1 less it where it is an error."""
    score = sum((1.0 - F.col(name) if error else F.col(name) for name, error in parts), F.lit(0.0))
    rows = metrics.withColumn("score", score)
    return rows.agg(F.max_by(F.struct(epoch, "score"), F.struct(F.col("score"), -F.col(epoch))).alias("r")).select(f"r.{epoch}", "r.score")


def parity(df: DataFrame, left: str, right: str, few: int = FEW) -> DataFrame:
    """How far two score vectors a row are apart, in one row: differences, exact quantiles of all of them, equal largest entries.

    One scan for the totals; the quantiles are selected (``quantiles``). Vectors of unequal length differ by null where one ends.
    """
    gap = F.transform(F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r")), lambda p: F.abs(p["l"] - p["r"]))
    rows = df.select(gap.alias("gap"), (F.array_position(left, F.array_max(left)) == F.array_position(right, F.array_max(right))).alias("same"))
    finite = F.filter("gap", lambda g: ~F.isnan(g) & (g != float("inf")))
    there = F.filter("gap", lambda g: g.isNotNull())
    total = rows.agg(F.count(F.lit(1)).alias("prompt_count"), F.sum(F.size("gap")).alias("compared"), F.sum(F.size(there)).alias("_there"), F.sum(F.size(finite)).alias("finite"), F.max(F.array_max("gap")).alias("max_diff"), (F.sum(F.aggregate("gap", F.lit(0.0), lambda a, g: a + g)) / F.sum(F.size("gap"))).alias("mean_diff"), ratio(F.count_if("same"), F.count(F.lit(1))).alias("argmax_agreement"))
    one = total.first()
    tails = quantiles(rows.select(F.explode("gap").alias("g")), "g", [0.99, 0.999], one["_there"] or 0, few)
    known = [F.lit(one[f.name]).cast(f.dataType).alias(f.name) for f in total.schema if f.name != "_there"]
    known += [F.lit(v).cast("double").alias(name) for name, v in zip(("p99_diff", "p999_diff"), tails, strict=True)]
    close = [(F.col("max_diff") <= t).alias(n) for t, n in ((0.005, "close_0_005"), (0.01, "close_0_01"), (0.02, "close_0_02"))]
    return df.sparkSession.range(1).select(*known).select("*", *close)


def parity_failures(report: DataFrame, least_agreement: float = 0.999, most_diff: float = 0.3, most_p999: float = 0.07, least_prompts: int = 8) -> DataFrame:
    """The report with the list of gates that it fails."""
    checks = [(F.col("finite") < F.col("compared"), "non-finite logit differences"), (F.col("prompt_count") < least_prompts, "too few prompts"), (F.col("argmax_agreement") < least_agreement, "argmax agreement"), (F.col("max_diff") > most_diff, "maximum logit difference"), (F.col("p999_diff") > most_p999, "p999 logit difference")]
    return report.withColumn("failures", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks])), "; "))


def reload_parity(df: DataFrame, left: str, right: str, left_tokens: str, right_tokens: str, least_agreement: float = 0.999, most_diff: float = 0.3) -> DataFrame:
    """Scores and generated tokens of a model before and after it was stored, in one row, and whether they pass."""
    gap = F.transform(F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r")), lambda p: F.abs(p["l"] - p["r"]))
    top = lambda c: F.array_position(c, F.array_max(c))
    rows = df.select(gap.alias("gap"), (top(left) == top(right)).alias("same"), F.col(left_tokens).eqNullSafe(F.col(right_tokens)).alias("equal"))
    one = rows.agg(F.bool_and(F.forall("gap", lambda g: g.isNotNull() & ~F.isnan(g) & (g != float("inf")))).alias("finite"), F.bool_and("equal").alias("generation_equal"), ratio(F.count_if("same"), F.count(F.lit(1))).alias("argmax_agreement"), F.max(F.array_max("gap")).alias("max_diff"))
    passed = F.col("finite") & F.col("generation_equal") & (F.col("argmax_agreement") >= least_agreement) & (F.col("max_diff") <= most_diff)
    return one.withColumn("passed", F.coalesce(passed, F.lit(False)))


RUN = 1_000  # digests that are joined at once


def ordered_digest(df: DataFrame, order: list, digest: Column, run: int = RUN) -> DataFrame:
    """Digest of row digests in their order, and how many rows there are: a tree of runs of ``run`` digests.

    Rows are numbered over sorted ranges; a task joins one run at a time, and each level has ``run`` times fewer rows. Rows that
    ``order`` doesn't tell apart must be alike. No rows have the digest of the empty text.
    """
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "d"))), lambda p: p["d"]), ""), 256).alias("d")
    level = numbered(df.withColumn("d", F.coalesce(digest, F.lit("-"))), [*order, F.asc("d")], "row-digests", "o").select("o", "d")
    n = level.count()
    left = n
    while True:
        level = level.groupBy(F.floor(F.col("o") / run).alias("o")).agg(joined).select("o", "d")
        left = -(-left // run)
        if left <= 1:
            break
    return level.agg(F.coalesce(F.max("d"), F.sha2(F.lit(""), 256)).alias("digest"), F.lit(n).cast("long").alias("n_rows"))


# Paths that guard against regressions, and words that a clarification must not hold.
REGRESSION_PATHS = ["tool_success", "tool_error", "no_tool_banking_faq", "ood", "hard_negative"]
UNSAFE_WORDS = ["account number", "customer id", "password", " pin", "ssn"]


def record_classes(path: Column, n_calls: Column, final_text: Column, family: Column, families: list[str]) -> dict[str, Column]:
    """sequential, clarification, servicing and regression of a record."""
    text = F.lower(F.coalesce(final_text, F.lit("")))
    unsafe = F.lit(False)
    for w in UNSAFE_WORDS:
        unsafe = unsafe | text.contains(w)
    return {
        "sequential": (n_calls >= 2) | (path == "multi_turn"),
        "clarification": (path == "clarification") & text.contains("last four digits") & ~unsafe,
        "servicing": family.isin(families),
        "regression": path.isin(REGRESSION_PATHS),
    }


def continuation_mix(df: DataFrame, times: dict[str, int], seed: str, key: str) -> DataFrame:
    """Each row as often as the largest factor of its classes says, with a copy number and a place in seeded order.

    The order is that of digests: deterministic, but another permutation than a Mersenne twister's.
    """
    weight = F.greatest(F.lit(1), *[F.when(F.col(c), n).otherwise(1) for c, n in times.items()])
    rows = df.withColumn("copy", F.explode(F.sequence(F.lit(1), weight)))
    return rows.withColumn("place", F.sha2(F.concat_ws("\0", F.lit(seed), F.col(key).cast("string"), F.col("copy").cast("string")), 256))


# Patterns of the teacher's output checks.
PRIVATE_VALUE = r"\b(?:\d[ -]?){9,}\b"
FACT_DIGITS = r"\d{2,}"
FACT_WORDS = r"(?i)\b(?:frozen|active|closed|open|pending|completed|cancelled|canceled|failed|checking|savings|credit|debit|replacement|dispute|transfer|transaction)\b"
ASKING = r"\b(?:provide|send|enter|share|tell me|confirm)\b"
ASKED_FOR = r"\b(?:password|pin|account number|customer id|private id)\b"
SEPARATORS = "[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def has_private_value(text: Column) -> Column:
    return text.rlike(PRIVATE_VALUE)


def asks_private_data(text: Column) -> Column:
    return F.lower(text).rlike(ASKING) & F.lower(text).rlike(ASKED_FOR)


def facts_lost(before: Column, after: Column) -> Column:
    """Sorted digits and fact words of ``before`` that ``after`` lacks."""
    facts = F.array_union(F.regexp_extract_all(before, F.lit(FACT_DIGITS), F.lit(0)), F.transform(F.regexp_extract_all(before, F.lit(FACT_WORDS), F.lit(0)), lambda w: F.lower(w)))
    return F.array_sort(F.filter(facts, lambda w: ~F.lower(after).contains(w)))


def flattened(text: Column) -> Column:
    """A stripped text; one with line breaks becomes its stripped, non-blank lines joined by spaces."""
    lines = F.filter(F.transform(F.split(strip(text), SEPARATORS), strip), lambda x: x != "")
    return F.when(strip(text).contains("\n"), F.array_join(lines, " ")).otherwise(strip(text))


def response_problems(asked: str = "asked", said: str = "said") -> Column:
    """First problem of a teacher's answer ``said`` to the request ``asked`` (structs of record_id, immutable_hash, user_content, final_response); null if none."""
    a, s = (lambda f: F.col(f"{asked}.{f}")), (lambda f: F.col(f"{said}.{f}"))
    blank = lambda c: F.coalesce(strip(c) == "", F.lit(True))
    user, final = flattened(s("user_content")), flattened(s("final_response"))
    checks = [(blank(s(f)), f"missing or empty string field: {f}") for f in ("record_id", "immutable_hash")]
    checks += [(strip(s("record_id")) != a("record_id"), "record_id mismatch"), (strip(s("immutable_hash")) != a("immutable_hash"), "immutable_hash mismatch")]
    checks += [(blank(s(f)), f"missing or empty string field: {f}") for f in ("user_content", "final_response")]
    checks += [(F.size(facts_lost(a("user_content"), user)) > 0, "user_content lost banking facts"), (F.size(facts_lost(a("final_response"), final)) > 0, "final_response lost banking facts")]
    checks += [(asks_private_data(final), "final_response requests private credentials"), (has_private_value(user) | has_private_value(final), "teacher output contains private identifiers")]
    return F.coalesce(*[F.when(c, F.lit(m)) for c, m in checks])


def request_problems(row: dict[str, Column]) -> Column:
    """First problem of a teacher request; null if none."""
    blank = lambda c: F.coalesce(strip(c) == "", F.lit(True))
    checks = [(blank(row["record_id"]), "missing or empty string field: record_id"), (blank(row["immutable_hash"]), "missing or empty string field: immutable_hash"), (~row["immutable_hash"].rlike("^sha256:[0-9a-f]{64}$"), "invalid immutable_hash")]
    checks += [(blank(row[f]), f"missing or empty string field: {f}") for f in ("user_content", "final_response")]
    return F.coalesce(*[F.when(c, F.lit(m)) for c, m in checks])


def realized(rows: DataFrame, answers: DataFrame, key: str, text: str) -> DataFrame:
    """``rows`` with the text of their answers where there is one."""
    return rows.join(answers.select(key, F.col(text).alias("_new")), key, "left").withColumn(text, F.coalesce("_new", text)).drop("_new")


def positional_changes(left: DataFrame, right: DataFrame, order: str, same: list[str], value: str) -> DataFrame:
    """Rows of two sources by position: how many there are, how many differ in ``same``, and how many in ``value``."""
    a = left.select(order, F.struct(*same).alias("a"), F.col(value).alias("av"))
    b = right.select(order, F.struct(*same).alias("b"), F.col(value).alias("bv"))
    both = a.join(b, order, "full_outer")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_broken"), F.count_if(~F.col("av").eqNullSafe(F.col("bv"))).alias("n_changed"))


def drift(actual: DataFrame, lock: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value isn't the locked one, missing ones included."""
    both = actual.select(key, F.col(value).alias("found")).join(lock.select(key, F.col(value).alias("locked")), key, "full_outer")
    return both.where(~F.col("found").eqNullSafe(F.col("locked")))


def stable_cases(cases: DataFrame, owner: str, case_id: str, at: str) -> DataFrame:
    """Generated case ids are numbered in an owner's order of time, and their times masked; seeded ones stay."""
    made = F.col(case_id).startswith("case_") & ~F.col(case_id).rlike("^case_(alex|maya)_")
    number = F.sum(made.cast("int")).over(Window.partitionBy(owner).orderBy(at, case_id))
    return cases.select(owner, F.when(made, F.concat(F.lit("generated_case_"), F.lpad(number.cast("string"), 3, "0"))).otherwise(F.col(case_id)).alias("case_id"), F.when(made, "generated-timestamp").otherwise(F.col(at).cast("string")).alias("created_at"))


def safe_error(message: Column) -> Column:
    low = F.lower(message)
    return (
        F.when(low.contains("matching synthetic") | low.contains("no matching"), "No matching eligible synthetic banking record was found.")
        .when(low.contains("unsupported"), "The requested tool arguments are not supported.")
        .otherwise("The synthetic banking action could not be completed.")
    )


def wire_call_id(raw: Column, index: Column, name: Column) -> Column:
    """The id of a call that brings none, from the whole output, its place and its tool."""
    return F.concat(F.lit("call_generated_"), index.cast("string"), F.lit("_"), F.substring(F.sha2(F.concat_ws("\n", raw, index.cast("string"), name), 256), 1, 16))


def serving_call_id(turn: Column, raw: Column, index: Column, name: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(strip(name), "[^a-zA-Z0-9_]+", "_"), "^_+|_+$", "")
    return F.concat_ws("_", F.lit("call"), F.substring(F.sha2(F.concat(F.coalesce(turn, F.lit("")), F.lit("\0"), raw), 256), 1, 10), index.cast("string"), F.when(slug == "", "tool").otherwise(slug))


def toy_tokens(text: Column) -> Column:
    """Character codes, held to 3 .. 255."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.least(F.lit(255), F.greatest(F.lit(3), F.ascii(c))))


def padded(df: DataFrame, batch: str, tokens: str, pad: int, ignore: int = -100) -> DataFrame:
    """Tokens, labels and mask of every row filled up to the longest row of its batch."""
    longest = df.groupBy(batch).agg(F.max(F.size(tokens)).alias("_width"))
    fill = F.col("_width") - F.size(tokens)
    more = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), fill))
    return df.join(longest, batch).select(*df.columns, more(F.col(tokens), pad).alias("input_ids"), more(F.col(tokens), ignore).alias("label_ids"), more(F.transform(tokens, lambda t: F.lit(1)), 0).alias("attention_mask")).drop("_width")

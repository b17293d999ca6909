"""Splitting, dedup, leakage, transitions, oversampling and audits of row sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PII_PATTERNS, has_pii, norm_unicode, stable_rank
from ..sources.shared import numbered

PRIORITY = {"test": 0, "validation": 1, "train": 2}


def ranked(df: DataFrame, key: Column, by: list[str], tie: str, name: str = "rank_no") -> DataFrame:
    """1-based rank of every row by a hex digest within ``by``, with no window over a whole group.

    Rows fall into 4096 cells by the digest's first digits; cell counts (a small table) give each cell's offset,
    and rows are only ordered inside their cell, so that a hot group is spread over all its cells.
    """
    rows = df.withColumn("_key", key).withColumn("_cell", F.substring("_key", 1, 3))
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*by, "_cell").orderBy("_key", tie)
    out = rows.withColumn("_at", F.row_number().over(inside)).join(offsets, [*by, "_cell"])
    return out.withColumn(name, F.col("_offset") + F.col("_at")).drop("_key", "_cell", "_at", "_offset")


def group_split(df: DataFrame, group: str, seed: int, share: float = 0.15) -> DataFrame:
    """Whole groups go to validation, test or train, in the order of a seeded digest. Adds ``split``."""
    groups = df.select(group).distinct().withColumn("_all", F.lit(0))
    n = groups.groupBy("_all").agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * share).cast("long")).alias("_share"))
    order = ranked(groups, F.sha2(F.concat(F.lit(f"{seed}\n"), F.col(group)), 256), ["_all"], group).join(n, "_all")
    split = F.when(F.col("rank_no") <= F.col("_share"), "validation").when(F.col("rank_no") <= 2 * F.col("_share"), "test").otherwise("train")
    return df.join(order.select(group, split.alias("split")), group)


def stratified_take(df: DataFrame, label: str, row_id: str, seed: str, share: float) -> DataFrame:
    """Adds ``split``: the first share of each label's rows by digest (half-even, one at least) are validation."""
    n = df.groupBy(label).agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * share).cast("long")).alias("_take"))
    rows = ranked(df, stable_rank(seed, F.col(label), F.col(row_id)), [label], row_id)
    return rows.join(n, label).withColumn("split", F.when(F.col("rank_no") <= F.col("_take"), "validation").otherwise("train")).drop("_take", "rank_no")


def priority(split: str = "split") -> Column:
    c = F.col(split)
    return F.when(c == "test", 0).when(c == "validation", 1).otherwise(2)


def dedup_across(df: DataFrame, key: Column) -> DataFrame:
    """Rows whose key no split of higher priority holds; repeats within a split stay."""
    rows = df.withColumn("_key", key).withColumn("_p", priority())
    shared = rows.groupBy("_key").agg(F.min("_p").alias("_best"), F.max("_p").alias("_worst")).where("_best < _worst").select("_key", "_best")  # few: AQE broadcasts them
    return rows.join(shared, "_key", "left").where("_best IS NULL OR _p = _best").drop("_key", "_p", "_best")


def dedup_first(df: DataFrame, key: Column, ordinal: str, keep: list[str]) -> DataFrame:
    """One row a key: of the highest priority, then the first. Aggregated before the shuffle; no join back."""
    row = F.struct(priority().alias("p"), F.col(ordinal).alias("o"), *[F.col(c).alias(c) for c in keep])
    return df.groupBy(key.alias("_key")).agg(F.min(row).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in keep])


def leaking(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups found in several splits."""
    return df.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("s")).where("size(s) > 1").select(group, F.array_join("s", ",").alias("splits"))


def pii_report(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Pairs of row and pattern, counted by pattern."""
    counts = df.groupBy(*by).agg(*[F.count_if(has_pii(F.col(text), k)).alias(k) for k in PII_PATTERNS])
    return counts.unpivot(by or [], list(PII_PATTERNS), "pattern", "n_rows")


def held_out_hits(train: DataFrame, held_out: DataFrame, text: str) -> DataFrame:
    """Rows of ``train`` whose normalized text is one of ``held_out``'s."""
    keys = held_out.select(norm_unicode(F.col(text)).alias("_held")).distinct().withColumn("_digest", F.md5("_held"))
    rows = train.withColumn("_key", norm_unicode(F.col(text)))
    return rows.join(keys, (F.md5("_key") == F.col("_digest")) & (F.col("_key") == F.col("_held")), "left_semi").drop("_key")


def circular_previous(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Each row with the one before it in its group; the first takes the last. Groups of one row give none.

    Rows are numbered over all groups, so that a row finds the one before it by number and a group of any size is spread; only a
    group's ends and its last value are gathered by group. Rows of null group or order take no part.
    """
    rows = numbered(df.where(F.col(group).isNotNull() & F.col(order).isNotNull()), [F.asc(group), F.asc(order)], "ordered", "_no")
    ends = rows.groupBy(group).agg(F.min("_no").alias("_first"), F.count(F.lit(1)).alias("_n"), F.max_by(value, "_no").alias("_last")).where("_n > 1")
    before = rows.select((F.col("_no") + 1).alias("_no"), F.col(value).alias("_before"))
    both = rows.join(before, "_no", "left").join(ends, group)
    return both.withColumn("previous", F.when(F.col("_no") == F.col("_first"), F.col("_last")).otherwise(F.col("_before"))).drop("_no", "_before", "_first", "_n", "_last")


def modulo_pairs(left: DataFrame, right: DataFrame, key, tie: str, n_right: int) -> DataFrame:
    """The k-th row of ``left`` with row k mod n of ``right``, both in digest order."""
    a = ranked(left.withColumn("_all", F.lit(0)), key, ["_all"], tie).withColumn("_k", (F.col("rank_no") - 1) % n_right)
    b = ranked(right.withColumn("_all", F.lit(0)), key, ["_all"], tie).select((F.col("rank_no") - 1).alias("_k"), F.col(tie).alias("anchor_id"))
    return a.join(b, "_k").drop("_all", "rank_no", "_k")


def oversampled(df: DataFrame, weight: Column) -> DataFrame:
    """Every row ``weight`` times, with its copy number."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), weight)))


def fingerprint(df: DataFrame, digest: Column, by: list[str]) -> DataFrame:
    """Order-free digest of a row set: the rows' count and the sum of 48 bits of each row's SHA-256."""
    part = F.conv(F.substring(digest, 1, 12), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(part).cast("string").alias("digest_sum"))

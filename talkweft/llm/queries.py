"""One registered query for each corpus operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .best_fit import pack_corpus
from .common import written
from .decontaminate import contamination
from .flac_media import encode_flac, media_features
from .hard_negatives import hard_negatives
from .line_crf import classify
from .near_dup import near_duplicates
from .oracles import oracle_sql
from .quality_rules import quality_verdicts
from .secret_scan import scan_secrets
from .sentence_pieces import encode_pieces
from .target_resample import importance_resample
from .token_records import token_records
from .url_filter import filter_urls
from .warc_archive import archive_pages


__all__ = ["oracle_sql", "queries"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_corpus(_table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(written(encode_flac(_table(spark, sf_dir, "documents")), "flac-media", "zstd"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(_table(spark, sf_dir, "documents"))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), labels=_table(spark, sf_dir, "labels"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(_table(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), label=shifted)


def op13_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit, op2_secrets, op3_flac, op4_pieces, op5_rules, op6_warc, op7_line_crf, op8_urls, op9_near_dup, op10_records, op11_resample, op12_negatives, op13_contamination)}

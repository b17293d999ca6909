"""The corpus pipeline: rules, classifier, near duplicates, secrets, packing; each stage reads what the last one wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkweft.llm.best_fit import pack_corpus
from talkweft.llm.common import written
from talkweft.llm.line_crf import keep_good
from talkweft.llm.near_dup import keep_first
from talkweft.llm.quality_rules import keep_by_rules
from talkweft.llm.secret_scan import redact_secrets


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Null and empty texts have no words and go; repeated rows get equal verdicts; extra columns go; an empty table stays one."""
    return keep_by_rules(docs, _labels(spark, sf_dir))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Equal texts get equal verdicts; without labels of both kinds all stay; extra columns go; an empty table stays one."""
    return keep_good(docs, _labels(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id: five-word shingles, similarity 0.8 and more. Texts without words and rows of null doc_id stay; rows that repeat a doc_id stay or go together; extra columns go."""
    return keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kind, and n_chars follows. Null texts stay null; every row stays; extra columns go."""
    return redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's pieces, with bin and offset. Null and empty texts are one token; long ones are cut, nothing is dropped; equal rows are packed each."""
    return pack_corpus(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

# Learnt scores, signatures and greedy packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

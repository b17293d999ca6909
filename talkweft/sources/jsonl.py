"""JSON lines, CSV, TOML and manifests in; all data access goes through Spark."""

from __future__ import annotations

import csv
import json
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import talkweft

cloudpickle.register_pickle_by_value(talkweft)


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line (from 1) and value of text files. Blocks of a file are counted first; no file is read whole by one task."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    from pyspark.sql import Window

    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    return rows.join(F.broadcast(offsets) if offsets.count() <= 100_000 else offsets, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """Rows of this schema; a line that isn't such an object fails the scan, or goes to _corrupt_record if not strict. Blank lines are skipped."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path).withColumn("source_file", F.col("_metadata.file_path"))


def read_jsonl_located(spark: SparkSession, path: str | list[str], schema: str, blank_fails: bool = False) -> DataFrame:
    """Rows of this schema with file and line. A line that is no JSON object fails the scan and is named; so is a blank one if ``blank_fails``."""
    lines = numbered_lines(spark, path)
    blank = F.trim("value") == ""
    lines = lines if blank_fails else lines.where(~blank)
    good = F.col("value").rlike(r"(?s)^\s*\{.*\}\s*$") & F.try_parse_json("value").isNotNull()
    said = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(" JSONL row must be an object"))
    return lines.select("file", "line", F.from_json(F.when(good, F.col("value")).otherwise(F.raise_error(said)), schema).alias("r")).select("file", "line", "r.*")


def last_predictions(spark: SparkSession, path: str) -> DataFrame:
    """record_id with the raw_output of its last line: of files in order of names, then of a file's blocks, then of lines."""
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = spark.read.text(path).select(order.alias("o"), F.from_json("value", "record_id string, raw_output string").alias("r")).where("r.record_id IS NOT NULL")
    return lines.groupBy("r.record_id").agg(F.max_by("r.raw_output", "o").alias("raw_output"))


def read_text_file(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def read_json_document(spark: SparkSession, path: str) -> object:
    return json.loads(read_text_file(spark, path))


def read_toml(spark: SparkSession, path: str, sections: list[str]) -> dict:
    """A TOML document that has all these sections."""
    got = tomllib.loads(read_text_file(spark, path))
    missing = [s for s in sections if not isinstance(got.get(s), dict)]
    if missing:
        raise ValueError(f"{path} lacks sections: {missing}")
    return got


def read_manifest(spark: SparkSession, path: str, split: str, absolute: bool = False) -> list[str]:
    """Paths of a split that a manifest includes, relative to its folder; absolute ones only where a loader allows them."""
    manifest = read_json_document(spark, path)
    entries = manifest.get("splits", {}).get(split) or [e for e in manifest.get("tool_sft", []) if e.get("split", e.get("name")) == split]
    entries = entries if isinstance(entries, list) else [entries]
    found = [e["path"] for e in entries if e.get("included", True)]
    if not found:
        raise ValueError(f"manifest has nothing for {split}")
    if any((p.startswith("/") and not absolute) or ".." in p.split("/") for p in found):
        raise ValueError("manifest paths must stay inside its folder")
    return [p if p.startswith("/") else f"{path.rsplit('/', 1)[0]}/{p}" for p in found]


def available_manifest(spark: SparkSession, path: str) -> str:
    """``path``, if a file is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not (fs.exists(where) and fs.getFileStatus(where).isFile()):
        raise ValueError(f"manifest is unavailable: {path}")
    return path


def checked_manifest(spark: SparkSession, path: str, contract: str, schema_version: str) -> dict:
    """A manifest of this contract whose files hold as many rows as it says."""
    manifest = read_json_document(spark, path)
    if (manifest.get("contract"), manifest.get("schema_version")) != (contract, schema_version):
        raise ValueError("manifest contract or schema_version mismatch")
    for entry in manifest.get("tool_sft", []):
        (file,) = read_manifest(spark, path, entry["name"])
        if spark.read.text(file).count() != int(entry["record_count"]):
            raise ValueError(f"{entry['name']} record_count mismatch")
    return manifest


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of the files under a folder (or of one). A file is one binary cell: for files up to some 100 MB."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def checked(spark: SparkSession, path: str, sha256: str) -> str:
    """``path``, if its one file has this digest."""
    if [r["sha256"] for r in file_digests(spark, path).collect()] != [sha256]:
        raise ValueError(f"digest of {path} differs")
    return path


LABELLED = "split string, source_row_id long, text string, label string"


def read_labelled_csv(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Rows of one CSV file a split. Lines are split before quotes are read, so line breaks in quoted cells are lost; a mark of byte order is dropped.

    The label is in ``label`` or ``category``; a row without text or label fails. A file's rows are numbered from 0 by the task that reads it.
    """
    splits = F.create_map(*[F.lit(x) for s, p in files.items() for x in (p.rsplit("/", 1)[1], s)])
    raw = spark.read.format("binaryFile").load(list(files.values())).select(F.try_element_at(splits, F.substring_index("path", "/", -1)).alias("split"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(split, i, r.get("text") or "", r.get("label") or r.get("category") or "") for i, r in enumerate(csv.DictReader(content.decode("utf-8-sig").splitlines()))]
                broken = next((i for _, i, text, label in rows if not text or not label), None)
                if broken is not None:
                    raise ValueError(f"{split} row {broken} is incomplete")
                for a in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + 10_000], strict=True)], names=["split", "source_row_id", "text", "label"])

    return raw.mapInArrow(run, LABELLED)


def labelled_pairs(payload: DataFrame) -> DataFrame:
    """(key, position, text, label) of a JSON object of lists of pairs; other lengths fail."""
    parsed = payload.select(F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("key", "pairs")).select("key", F.posexplode("pairs").alias("position", "pair"))
    return parsed.select("key", "position", F.when(F.size("pair") == 2, F.col("pair")[0]).otherwise(F.raise_error(F.lit("pair needs a text and a label"))).alias("text"), F.col("pair")[1].alias("label"))

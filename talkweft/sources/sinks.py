"""JSON lines, manifests, cards and locks out. Rows are written by Spark; documents of a few kB by the driver, through Hadoop's file systems."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .jsonl import file_digests, read_json_document

# How JSON is written: of split files, of compact rows, of digests.
SPACED_ASCII = {"sort_keys": True}
COMPACT_UTF8 = {"sort_keys": True, "separators": (",", ":"), "ensure_ascii": False}
COMPACT_ASCII = {"sort_keys": True, "separators": (",", ":")}


def serialized(value: Column, form: dict) -> Column:
    """JSON text of a column of JSON text, in one of the forms above."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: None if v is None else json.dumps(json.loads(v), **form))

    return F.pandas_udf(run, "string")(value)


def json_of(*columns: str) -> Column:
    """A row as JSON text, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, order: str, split: str | None = None, form: dict = SPACED_ASCII, mode: str = "errorifexists") -> None:
    """JSON lines in order: part files follow each other by name. With ``split`` a folder for each split, ordered within."""
    line = serialized(json_of(*[c for c in df.columns if c != split]), form).alias("value")
    rows = df.select(order, line, *([F.col(split).alias("_split")] if split else []))
    keys = ["_split", order] if split else [order]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(order)
    if split:
        rows.withColumnRenamed("_split", split).write.mode(mode).partitionBy(split).text(path)
    else:
        rows.write.mode(mode).text(path)


def append_pending(requests: DataFrame, path: str, key: str, form: dict = COMPACT_UTF8) -> int:
    """Append the requests whose key isn't among the lines there; how many they were. A line there without its key fails."""
    spark = requests.sparkSession
    if _fs(spark, path)[0].exists(_path(spark, path)):
        done = spark.read.schema(f"{key} string").option("mode", "FAILFAST").json(path)
        done = done.select(F.when(F.col(key).isNull(), F.raise_error(F.lit(f"a row of {path} has no {key}"))).otherwise(F.col(key)).alias(key))
        requests = requests.join(done.distinct(), key, "left_anti")
    n = requests.count()
    if n:
        requests.select(serialized(json_of(*requests.columns), form).alias("value")).write.mode("append").text(path)
    return n


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    where = _path(spark, path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small document, written beside its place and renamed over what is there: readers see the old one or the new one, whole."""
    fs, where = _fs(spark, path)
    part = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        hadoop = spark._jvm.org.apache.hadoop.fs
        over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        over[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(where), over)
    except BaseException:
        fs.delete(part, False)
        raise


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True) + "\n")


def write_lock(spark: SparkSession, path: str, lock: dict) -> bool:
    """Write a lock unless the same one is there; whether it was written."""
    fs, where = _fs(spark, path)
    if fs.exists(where) and read_json_document(spark, path) == lock:
        return False
    write_json(spark, path, lock)
    return True


def split_entries(spark: SparkSession, folder: str, split: str = "split") -> list[dict]:
    """For each split of write_jsonl(): name, path, bytes, rows and a digest of its files' digests in order."""
    files = file_digests(spark, folder).where(F.col("path").contains(f"/{split}=") & F.col("path").contains("/part-"))
    lines = spark.read.text(folder).groupBy(F.regexp_extract(F.col("_metadata.file_path"), f"/{split}=([^/]+)/", 1).alias("name")).count()
    rows = {r["name"]: r["count"] for r in lines.collect()}
    found: dict[str, list] = {}
    for r in sorted(files.collect(), key=lambda r: r["path"]):
        found.setdefault(r["path"].split(f"/{split}=")[1].split("/")[0], []).append(r)
    return [{"name": k, "path": f"{split}={k}", "bytes": sum(r["bytes"] for r in v), "record_count": rows.get(k, 0), "sha256": hashlib.sha256("".join(r["sha256"] for r in v).encode()).hexdigest()} for k, v in sorted(found.items())]


def artifact_manifest(spark: SparkSession, folder: str, about: dict) -> dict:
    """``about`` with the files of a folder in order: relative path, bytes, sha256."""
    rows = sorted((r["path"].split(folder.rstrip("/").split(":", 1)[-1] + "/", 1)[1], r["bytes"], r["sha256"]) for r in file_digests(spark, folder).collect())
    return about | {"files": [{"path": p, "bytes": b, "sha256": d} for p, b, d in rows if p != "manifest.json" and not p.rsplit("/", 1)[-1].startswith(".")]}


def new_folder(spark: SparkSession, path: str) -> str:
    """A folder that isn't there yet, or is empty."""
    fs, where = _fs(spark, path)
    if fs.exists(where) and len(fs.listStatus(where)):
        raise FileExistsError(f"refusing to overwrite non-empty output: {path}")
    fs.mkdirs(where)
    return path


def artifact_problems(spark: SparkSession, folder: str, manifest: dict, contract: str) -> list[str]:
    """What of an artifact isn't as its manifest says: contract, unsafe paths, missing files, sizes, digests."""
    out = [] if manifest.get("contract") == contract else ["contract"]
    there = {f["path"]: f for f in artifact_manifest(spark, folder, {})["files"]}
    for f in manifest.get("files", []):
        found = there.get(f["path"])
        if f["path"].startswith("/") or ".." in f["path"].split("/"):
            out.append(f"unsafe path: {f['path']}")
        elif found is None:
            out.append(f"missing: {f['path']}")
        elif (found["bytes"], found["sha256"]) != (f["bytes"], f["sha256"]):
            out.append(f"differs: {f['path']}")
    return out


def data_card(name: str, report: dict[str, int], splits: dict[str, int], license_name: str) -> str:
    """A card of a corpus: its splits and paths with their counts."""
    lines = ["---", f"license: {license_name.lower()}", "---", "", f"# {name}", "", f"{sum(splits.values())} records.", "", "## Splits", ""]
    lines += [f"- `{k}`: {v}" for k, v in splits.items()]
    lines += ["", "## Paths", "", *[f"- `{k}`: {v}" for k, v in sorted(report.items())], ""]
    return "\n".join(lines)


def run_metadata(revisions: dict[str, str], digests: dict[str, str], counts: dict[str, int], settings: dict) -> dict:
    """What a run was: revisions (40 hex digits each), input digests, counts and decode settings."""
    bad = [k for k, v in revisions.items() if len(v) != 40 or set(v) - set("0123456789abcdef")]
    if bad:
        raise ValueError(f"revisions aren't commit ids: {bad}")
    return {"revisions": revisions, "digests": digests, "counts": counts, "settings": settings}

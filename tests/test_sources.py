"""Sources, sinks and streaming forms on files."""

import hashlib
import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from talkweft.operators import state
from talkweft.sources import jsonl, sinks
from talkweft.streaming import sessions

FAILED = (PySparkException, Py4JJavaError)
DATA = "/root/testdata/sf0.001"


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl_scans(spark, tmp_path):
    good = put(tmp_path / "a.jsonl", '{"record_id": "a", "n": 1}\n\n{"record_id": "b", "n": null}\n')
    assert [(r.record_id, r.n) for r in jsonl.read_jsonl(spark, good, "record_id string, n int").collect()] == [("a", 1), ("b", None)]
    assert [(r.line, r.record_id) for r in jsonl.read_jsonl_located(spark, good, "record_id string").orderBy("line").collect()] == [(1, "a"), (3, "b")]
    with pytest.raises(FAILED, match="a.jsonl:2 JSONL row"):
        jsonl.read_jsonl_located(spark, good, "record_id string", blank_fails=True).collect()
    bad = put(tmp_path / "b.jsonl", '{"record_id": "a"}\n[1]\n')
    with pytest.raises(FAILED, match="b.jsonl:2 JSONL row"):
        jsonl.read_jsonl_located(spark, bad, "record_id string").collect()
    with pytest.raises(FAILED):
        jsonl.read_jsonl(spark, put(tmp_path / "c.jsonl", "{x}\n"), "record_id string").collect()
    loose = jsonl.read_jsonl(spark, str(tmp_path / "c.jsonl"), "record_id string", strict=False).collect()
    assert loose[0]._corrupt_record == "{x}" and loose[0].source_file.endswith("c.jsonl")


def test_lines_and_last_rows_of_split_files(spark, tmp_path):
    """Lines are numbered, and the last one wins, where a file is read in many blocks."""
    path = put(tmp_path / "p.jsonl", "".join(json.dumps({"record_id": f"r{i % 50}", "raw_output": f"{i} " + "x" * (i % 97)}) + "\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = jsonl.numbered_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 4
        assert all(json.loads(r.value)["raw_output"].startswith(f"{r.line - 1} ") for r in lines.collect())
        got = {r.record_id: r.raw_output for r in jsonl.last_predictions(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"r{k}": f"{4950 + k} " + "x" * ((4950 + k) % 97) for k in range(50)}


def test_manifests(spark, tmp_path):
    put(tmp_path / "d/train.jsonl", '{"a": 1}\n{"a": 2}\n')
    entry = {"name": "train", "split": "train", "path": "d/train.jsonl", "record_count": 2}
    m = put(tmp_path / "manifest.json", json.dumps({"contract": "c", "schema_version": "v", "tool_sft": [entry, entry | {"split": "test", "included": False}]}))
    assert jsonl.read_manifest(spark, m, "train") == [f"{tmp_path}/d/train.jsonl"]
    for split in ("test", "other"):
        with pytest.raises(ValueError, match="nothing for"):
            jsonl.read_manifest(spark, m, split)
    n = put(tmp_path / "n.json", json.dumps({"splits": {"train": {"path": "/etc/x"}, "test": [{"path": "../x"}]}}))
    for split in ("train", "test"):
        with pytest.raises(ValueError, match="inside"):
            jsonl.read_manifest(spark, n, split)
    assert jsonl.read_manifest(spark, n, "train", absolute=True) == ["/etc/x"]
    only = put(tmp_path / "o.json", json.dumps({"contract": "c", "schema_version": "v", "tool_sft": [entry]}))
    assert jsonl.checked_manifest(spark, only, "c", "v")["tool_sft"][0]["record_count"] == 2
    with pytest.raises(ValueError, match="contract"):
        jsonl.checked_manifest(spark, only, "c", "w")
    wrong = put(tmp_path / "w.json", json.dumps({"contract": "c", "schema_version": "v", "tool_sft": [entry | {"record_count": 3}]}))
    with pytest.raises(ValueError, match="record_count"):
        jsonl.checked_manifest(spark, wrong, "c", "v")


def test_digests_toml_csv_and_pairs(spark, tmp_path):
    f = put(tmp_path / "x.txt", "héllo\n")
    sha = hashlib.sha256("héllo\n".encode()).hexdigest()
    assert jsonl.checked(spark, f, sha) == f and jsonl.file_digests(spark, f).first().bytes == 7
    with pytest.raises(ValueError, match="digest"):
        jsonl.checked(spark, f, "0")
    t = put(tmp_path / "c.toml", "[data]\nn = 3\n")
    assert jsonl.read_toml(spark, t, ["data"])["data"]["n"] == 3
    with pytest.raises(ValueError, match="lacks"):
        jsonl.read_toml(spark, t, ["train"])
    a = put(tmp_path / "train.csv", '﻿text,label\n"one\ntwo",x\nb,y\n')
    b = put(tmp_path / "test.csv", "text,category\nc,z\n")
    rows = {(r.split, r.source_row_id): (r.text, r.label) for r in jsonl.read_labelled_csv(spark, {"train": a, "test": b}).collect()}
    assert rows == {("train", 0): ("onetwo", "x"), ("train", 1): ("b", "y"), ("test", 0): ("c", "z")}
    with pytest.raises(FAILED, match="row 0 is incomplete"):
        jsonl.read_labelled_csv(spark, {"train": put(tmp_path / "bad.csv", "text,label\n,x\n")}).collect()
    pairs = spark.createDataFrame([(json.dumps({"val": [["hi", "greeting"], ["x", "oos"]]}),), (json.dumps({"bad": [["x"]]}),)], "value string")
    assert [tuple(r) for r in jsonl.labelled_pairs(pairs.where("value LIKE '%val%'")).collect()] == [("val", 0, "hi", "greeting"), ("val", 1, "x", "oos")]
    with pytest.raises(FAILED, match="pair needs"):
        jsonl.labelled_pairs(pairs).collect()


def test_split_files_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{i:03d}", "é" * (i % 3), None if i % 4 else i, ["train", "test"][i % 5 == 0]) for i in range(60)], "record_id string, text string, n int, split string")
    out = f"{tmp_path}/out"
    sinks.write_jsonl(rows, out, "record_id", "split")
    for split in ("train", "test"):
        lines = [line for f in sorted((tmp_path / "out" / f"split={split}").glob("part-*")) for line in f.read_text().splitlines()]
        want = [json.dumps({"record_id": r.record_id, "text": r.text, "n": r.n}, sort_keys=True) for r in sorted(rows.where(F.col("split") == split).collect())]
        assert lines == want
    entries = {e["name"]: e for e in sinks.split_entries(spark, out)}
    assert entries["test"]["record_count"] == 12 and entries["train"]["record_count"] == 48
    compact = f"{tmp_path}/compact"
    sinks.write_jsonl(rows.limit(1).drop("split"), compact, "record_id", form=sinks.COMPACT_UTF8)
    text = "".join(f.read_text() for f in (tmp_path / "compact").glob("part-*"))
    assert " " not in text and json.loads(text)["record_id"] == "r000"
    ascii_form = rows.where("record_id = 'r001'").select(sinks.serialized(sinks.json_of("text"), sinks.COMPACT_ASCII)).first()[0]
    assert ascii_form == '{"text":"\\u00e9"}'


def test_resume_appends_what_is_missing(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{i}", i) for i in range(10)], "record_id string, n int")
    path = f"{tmp_path}/done"
    assert sinks.append_pending(rows.where("n < 4"), path, "record_id") == 4
    assert sinks.append_pending(rows, path, "record_id") == 6 and sinks.append_pending(rows, path, "record_id") == 0
    assert sorted(r.record_id for r in spark.read.json(path).collect()) == [f"r{i}" for i in range(10)]
    put(tmp_path / "broken/part-0.txt", '{"n": 1}\n')
    with pytest.raises(FAILED, match="has no record_id"):
        sinks.append_pending(rows, f"{tmp_path}/broken", "record_id")


def test_documents_locks_and_artifacts(spark, tmp_path):
    lock = {"a": {"sha256": "x"}}
    path = f"{tmp_path}/lock.json"
    assert sinks.write_lock(spark, path, lock) and not sinks.write_lock(spark, path, lock) and sinks.write_lock(spark, path, {"a": 1})
    assert json.loads((tmp_path / "lock.json").read_text()) == {"a": 1} and not list(tmp_path.glob("*.tmp"))
    folder = sinks.new_folder(spark, f"{tmp_path}/artifact")
    put(tmp_path / "artifact/b/weights.bin", "w" * 9)
    put(tmp_path / "artifact/config.json", "{}")
    manifest = sinks.artifact_manifest(spark, folder, {"contract": "k"})
    assert [f["path"] for f in manifest["files"]] == ["b/weights.bin", "config.json"] and manifest["files"][0]["bytes"] == 9
    assert sinks.artifact_problems(spark, folder, manifest, "k") == []
    (tmp_path / "artifact/config.json").write_text("{ }")
    more = manifest | {"files": [*manifest["files"], {"path": "../x", "bytes": 1, "sha256": ""}, {"path": "gone", "bytes": 1, "sha256": ""}]}
    assert sinks.artifact_problems(spark, folder, more, "z") == ["contract", "differs: config.json", "unsafe path: ../x", "missing: gone"]
    with pytest.raises(FileExistsError):
        sinks.new_folder(spark, folder)
    assert "- `ood`: 3" in sinks.data_card("corpus", {"ood": 3}, {"train": 3}, "MIT")
    with pytest.raises(ValueError, match="commit"):
        sinks.run_metadata({"model": "main"}, {}, {}, {})


def test_streams_equal_batch(spark, tmp_path):
    """What a stream of sessions sends on, once its watermark has passed, is the batch's; repeated requests are dropped."""
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    late = spark.createDataFrame([(-1, -1)], "event_id long, user_id long").withColumn("ts", F.lit("2100-01-01").cast("timestamp"))
    folder = f"{tmp_path}/in"
    events.select("event_id", F.col("user_id").cast("long"), "ts").union(late).write.parquet(folder)
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(folder)
    sessions.run_available(sessions.session_counts(stream), f"{tmp_path}/out", f"{tmp_path}/check")
    got = sorted((r.user_id, r.started, r.n_events) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted((r.user_id, r.started, r.n_events) for r in state.sessions(events, "user_id", "ts", 7200).collect())
    assert len(got) == len(want) and sum(r[2] for r in got) == events.count()
    again = events.union(events).select("event_id", "ts")
    again.write.parquet(f"{tmp_path}/twice")
    stream = spark.readStream.schema("event_id long, ts timestamp").parquet(f"{tmp_path}/twice")
    sessions.run_available(sessions.first_rows(stream, "event_id", "ts"), f"{tmp_path}/once", f"{tmp_path}/check2")
    assert spark.read.parquet(f"{tmp_path}/once").count() == events.count()


def test_documents_are_replaced_whole(spark, tmp_path, monkeypatch):
    """A new document takes the old one's place; where writing fails, the old one stays and nothing lies beside it."""
    import os

    path = str(tmp_path / "card.md")
    for text in ("one", "two é\n", ""):
        sinks.write_text(spark, path, text)
        assert open(path, encoding="utf-8").read() == text
    with pytest.raises(Exception):
        sinks.write_text(spark, path, "\ud800")
    assert open(path).read() == "" and [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["card.md"]


def test_manifest_must_be_there(spark, tmp_path):
    (tmp_path / "manifest.json").write_text("{}")
    assert jsonl.available_manifest(spark, str(tmp_path / "manifest.json")).endswith("manifest.json")
    for missing in (tmp_path / "none.json", tmp_path):
        with pytest.raises(ValueError, match="manifest is unavailable"):
            jsonl.available_manifest(spark, str(missing))

"""The corpus contract over written files: each planted fault is named with its file and line."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from talkweft.operators import contract as C

HASH = "sha256:m"


def record(i, **changes):
    rid = f"r{i}"
    made = {
        "record_id": rid,
        "schema_version": C.CONTRACT,
        "provenance": {"source": C.SOURCE},
        "split_keys": {k: "v" for k in C.SPLIT_KEYS},
        "metadata": {"split_group": f"g{i}"},
        "messages": [
            {"role": "user", "content": f"Freeze card number {i}", "loss": False},
            {"role": "assistant", "content": None, "loss": True, "tool_calls": [{"id": f"call_{rid}_0", "index": 0, "type": "function", "function": {"name": "freeze_card", "arguments": {"last4": "4821"}}}]},
            {"role": "tool", "content": {"ok": True, "result": {}}, "loss": False, "tool_call_id": f"call_{rid}_0", "name": "freeze_card"},
            {"role": "assistant", "content": "Your debit card ending in 4821 is now frozen.", "loss": True},
        ],
        "expected": {"path": "tool_success", "ordered_calls": [f"call_{rid}_0"], "tool_calls": [{"name": "freeze_card", "arguments": {"last4": "4821"}}], "requires_tool": True},
        "validation": {"tool_manifest_hash": HASH},
    }
    for path, value in changes.items():
        at = made
        *way, last = path.split("__")
        for step in way:
            at = at[int(step) if step.isdigit() else step]
        at[int(last) if last.isdigit() else last] = value
    return made


FAULTS = {
    "missing record_id": {"record_id": " "},
    "unexpected schema_version": {"schema_version": "x"},
    "unsupported provenance": {"provenance": {"source": "web"}},
    "invalid split_keys": {"split_keys": {"template_id": "t"}},
    "missing ordered_calls": {"expected__ordered_calls": None},
    "missing expected tool_calls": {"expected__tool_calls": None},
    "final assistant response is missing semantic content": {"messages__3__content": "Done now."},
    "final assistant response must be trainable": {"messages__3__loss": False},
    "final assistant response is missing path markers": {"expected__path": "clarification"},
    "messages: tool-call assistant has content": {"messages__1__content": "x"},
    "messages: assistant call has invalid loss label": {"messages__1__loss": None},
    "messages: unstable tool call id": {"messages__1__tool_calls__0__id": "other"},
    "messages: unknown tool": {"messages__1__tool_calls__0__function__name": "pay"},
    "messages: unsupported arguments": {"messages__1__tool_calls__0__function__arguments": {"pin": "1"}},
    "messages: tool result is labeled": {"messages__2__loss": True},
    "messages: success envelope is invalid": {"messages__2__content": {"ok": True, "error": "x"}},
    "messages: error envelope is invalid": {"messages__2__content": {"ok": False, "result": "x"}},
    "messages: tool envelope missing ok": {"messages__2__content": {"result": "x"}},
    "messages: context message is labeled": {"messages__0__loss": True},
    "messages: invalid role": {"messages__0__role": "critic"},
    "ordered_calls mismatch": {"expected__ordered_calls": ["z"]},
    "expected tool_calls mismatch": {"expected__tool_calls": [{"name": "freeze_card", "arguments": {"last4": "1111"}}]},
    "requires_tool mismatch": {"expected__requires_tool": False},
    "manifest hash mismatch": {"validation__tool_manifest_hash": "sha256:x"},
    "PII-like text": {"messages__0__content": "Write to me at a.b@example.com please"},
}


def write(folder, splits, counts=None, **manifest):
    entries = []
    for name, rows in splits.items():
        (folder / f"{name}.jsonl").write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
        entries.append({"name": name, "path": f"{name}.jsonl", "record_count": (counts or {}).get(name, sum(bool(r) for r in rows))})
    (folder / "manifest.json").write_text(json.dumps({"contract": C.MANIFEST, "schema_version": C.CONTRACT, "tool_sft": entries} | manifest))
    return str(folder / "manifest.json")


def report(spark, path, **settings):
    return {r.rule: (r.n, r.split, (r.file or "").rsplit("/", 1)[-1], r.line, r.record_id) for r in C.corpus_report(spark, path, HASH, **settings).collect()}


def test_clean_corpus(spark, tmp_path):
    path = write(tmp_path, {"train": [record(i) for i in range(30)], "test": [record(100 + i) for i in range(5)]})
    assert report(spark, path) == {}
    C.require(C.corpus_report(spark, path, HASH))


def test_each_fault_is_located(spark, tmp_path):
    rows = [record(i) for i in range(10)] + [record(10 + i, **f) for i, f in enumerate(FAULTS.values())] + [record(90 + i, **f) for i, f in enumerate(FAULTS.values())]
    got = report(spark, write(tmp_path, {"train": rows}))
    for rule in FAULTS:
        n, split, file, line, rid = got[rule]
        first = list(FAULTS).index(ALSO.get(rule, rule))
        assert (n >= 2, split, file) == (True, "train", "train.jsonl"), rule
        assert (line, rid) == (11 + first, rows[10 + first]["record_id"]), rule


# Rules that an earlier fault breaks too.
NO_TARGET = "messages: assistant call has invalid loss label"
ALSO = {"messages: unstable tool call id": "missing record_id"} | dict.fromkeys(("ordered_calls mismatch", "expected tool_calls mismatch", "requires_tool mismatch"), NO_TARGET)


def test_rules_between_records(spark, tmp_path):
    same = record(3)
    twice = copy.deepcopy(record(4, messages__0__content="FREEZE card number 3!"))
    leak = record(50, metadata__split_group="g1")
    path = write(tmp_path, {"train": [record(i) for i in range(5)] + ["", same, twice], "test": [leak, record(51, messages__0__content="freeze card NUMBER 2"), record(52, messages__0__content="When was that created?")], "validation": [record(60, messages__0__content="When was that created?")]}, {"test": 4})
    got = report(spark, path, held_out=("freeze card number 0",))
    assert got["duplicate record_id"] == (2, "train", "train.jsonl", 7, "r3")
    assert got["duplicates normalized user text"][0] == 4 and got["duplicate current user text in split"] == (2, "train", "train.jsonl", 7, "r3")
    assert got["split group leaked across splits"][:3] == (1, "test", "test.jsonl")
    assert got["held-out currents leaked into training"] == (1, "train", "train.jsonl", 1, "r0")
    assert got["test record_count mismatch"][0] == 1
    with pytest.raises(ValueError, match="manifest.json|jsonl:"):
        C.require(C.corpus_report(spark, path, HASH))


def test_manifest_and_broken_lines(spark, tmp_path):
    path = write(tmp_path, {"train": [record(1), "[1, 2]", "{broken"]}, contract="other")
    got = report(spark, path)
    assert got["manifest contract mismatch"][0] == 1 and got["missing record_id"] == (2, "train", "train.jsonl", 2, None)


def test_observed_while_writing(spark, tmp_path):
    path = write(tmp_path, {"train": [record(i) for i in range(20)] + [record(20, schema_version="x")]})
    rows = C.read_corpus(spark, C.manifest_violations(spark, path)[1])
    rules = C.record_rules(HASH)
    watched, seen = C.observed(rows, rules)
    watched.select("record_id", F.col("line")).write.parquet(str(tmp_path / "copy"))
    broken = list(rules).index("unexpected schema_version")
    assert (seen.get["n_rows"], seen.get[f"n_{broken}"], seen.get[f"first_{broken}"]["line"]) == (21, 1, 21)
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 21

"""Teacher prompts, recovered answers and digests against plain Python."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from talkweft.operators import realization as R


def test_prompt_is_json_with_sorted_keys(spark):
    texts = ["plain", 'a "quote" and \\', "café\nund \U0001f600 mehr", "", "tab\there"]
    rows = spark.createDataFrame([(t, ["messages", "é"]) for t in texts], "t string, fields array<string>")
    got = {r.t: r.p for r in rows.select("t", R.teacher_prompt(F.lit("r1"), F.lit("sha256:x"), F.col("t"), F.lit("ok"), F.col("fields")).alias("p")).collect()}
    for t in texts:
        want = {"record_id": "r1", "immutable_hash": "sha256:x", "user_content": t, "final_response": "ok", "allowed_edits": ["user_content", "final_response"], "immutable_fields": ["messages", "é"]}
        assert got[t] == R.TEACHER_TEXT + json.dumps(want, sort_keys=True)


@pytest.mark.parametrize(
    "raw,failure,payload",
    [
        ('{"b": 1, "a": "é"}', None, {"a": "é", "b": 1}),
        ('```json\n{"a": 1}\n```', None, {"a": 1}),
        ('```\n{"a": {"b": "```"}}\n```', None, {"a": {"b": "```"}}),
        ('```json\n{"a": 1}', None, {"a": 1}),
        ('Sure: {"a": {"b": 2}} as asked', None, {"a": {"b": 2}}),
        ("nothing", "teacher output did not contain JSON", None),
        ("", "teacher output did not contain JSON", None),
        (None, "teacher output did not contain JSON", None),
        ("[1]", "teacher output JSON must be an object", None),
        ("null", "teacher output JSON must be an object", None),
        ("{broken}", "teacher output is not JSON", None),
    ],
)
def test_recovered_answers(raw, failure, payload):
    said, text = R.recover(raw)
    assert said == failure
    assert (None if text is None else json.loads(text)) == payload


def test_recovered_column_keeps_nulls(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, None), (3, "x")], "id int, raw string").select("id", R.recovered(F.col("raw")).alias("r")).orderBy("id").collect()
    assert [(r.r.failure is None, r.r.payload is None) for r in rows] == [(True, False), (False, True), (False, True)]


def digest(value):
    return "sha256:" + hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_immutable_hash_leaves_out_last_user_and_last_answer(spark):
    call = '[{"id":"c1","name":"list_cards"}]'
    turns = [("user", "hé", None), ("assistant", "first", None), ("user", "cards?", None), ("assistant", "", call), ("tool", "{}", None), ("assistant", "done", None)]

    def hashed(messages):
        df = spark.createDataFrame([([{"role": r, "content": c, "tool_calls": t} for r, c, t in messages],)], "m array<struct<content:string,role:string,tool_calls:string>>")
        return df.select(R.immutable_hash(F.col("m"), F.lit("r1"), F.lit("v1"), F.lit('{"tool_calls":[]}'), F.lit(None).cast("string"), F.lit("sha256:m"), F.lit("sha256:r"))).first()[0]

    kept = [{"content": c, "role": r} | ({"tool_calls": json.loads(t)} if t else {}) for i, (r, c, t) in enumerate(turns) if i not in (2, 5)]
    assert hashed(turns) == digest({"schema_version": "v1", "record_id": "r1", "messages_except_final_assistant": kept, "expected": {"tool_calls": []}, "split_keys": None, "validation": {"tool_manifest_hash": "sha256:m", "replay_hash": "sha256:r"}})
    reworded = [(r, c + " please" if i in (2, 5) else c, t) for i, (r, c, t) in enumerate(turns)]
    assert hashed(reworded) == hashed(turns)
    assert hashed([*turns[:1], ("assistant", "other", None), *turns[2:]]) != hashed(turns)
    assert hashed([]) == digest({"schema_version": "v1", "record_id": "r1", "messages_except_final_assistant": [], "expected": {"tool_calls": []}, "split_keys": None, "validation": {"tool_manifest_hash": "sha256:m", "replay_hash": "sha256:r"}})


def test_replay_hash_of_results_and_errors(spark):
    df = spark.range(1).select(F.array(
        F.struct(F.lit("call_r_0").alias("tool_call_id"), F.lit("list_cards").alias("name"), R.envelope(F.lit('{"cards":[]}'), F.lit(None).cast("string")).alias("content")),
        F.struct(F.lit("call_r_1").alias("tool_call_id"), F.lit("freeze_card").alias("name"), R.envelope(F.lit(None).cast("string"), F.lit('no "é" card')).alias("content")),
    ).alias("e"))
    events = [
        {"tool_call_id": "call_r_0", "name": "list_cards", "content": {"ok": True, "result": {"cards": []}}},
        {"tool_call_id": "call_r_1", "name": "freeze_card", "content": {"ok": False, "error": {"code": "backend_error", "message": 'no "é" card'}}},
    ]
    got = df.select(R.replay_hash(F.col("e")), R.final_state_hash(F.col("e"), F.lit("{}")), R.final_state_hash(F.slice("e", 1, 0), F.lit("{}"))).first()
    assert tuple(got) == (digest(events), digest({}), None)
    ids = spark.range(3).select(R.call_ids(F.lit("r"), F.col("id").cast("int"))).collect()
    assert [r[0] for r in ids] == [[], ["call_r_0"], ["call_r_0", "call_r_1"]]


def test_stages_and_limits(spark):
    stages = spark.createDataFrame([("prepare",), ("evaluate",)], "name string")
    assert R.selected_stages(stages, "all").count() == 2
    assert [r.name for r in R.selected_stages(stages, "evaluate").collect()] == ["evaluate"]
    assert R.selected_stages(stages, "none").count() == 0
    rows = spark.range(5)
    assert [r.id for r in R.limited(rows, "id", 2).collect()] == [0, 1]
    assert R.limited(rows, "id", None).count() == 5
    with pytest.raises(ValueError, match="--limit must be at least 1"):
        R.limited(rows, "id", 0)


def test_visible_history_of_no_list_is_empty(spark):
    rows = spark.createDataFrame([(None,), ([],), ([{"role": "system", "content": "x"}, {"role": "user", "content": " hi "}, {"role": "assistant", "content": None}],)], "m array<struct<role:string,content:string>>")
    got = [r.h for r in rows.select(R.visible_history(F.col("m")).alias("h")).collect()]
    assert [[tuple(x) for x in h] for h in got] == [[], [], [("user", " hi ")]]

"""Corpus gates: every call of every message counts, and each gate fails by itself."""

import pytest

from talkweft.operators import validation as V
from talkweft.plans import catalog

TOOLS, SPLITS = list(V.PUBLIC_ARGUMENTS), ["train", "validation", "test"]


def whole():
    records = [(f"r{i}", SPLITS[i % 3], p, True) for i, p in enumerate(V.REQUIRED_PATHS)]
    return records, [(t, i % 2 == 0) for i, t in enumerate(TOOLS)]


def gates(spark, records, calls):
    made = V.corpus_gates(spark.createDataFrame(records, "record_id string, split string, path string, accepted boolean"), spark.createDataFrame(calls, "name string, ok boolean"), SPLITS)
    return {r.gate: (r.n, r.passed) for r in made.collect()}


def test_a_whole_corpus_passes(spark):
    records, calls = whole()
    got = gates(spark, [*records, ("r7", "train", "conversation", True)], [*calls, ("freeze_card", None)])
    assert got == {"all_accepted": (8, True), "all_tools_covered": (9, True), "ok_present": (5, True), "error_present": (4, True), "required_paths": (7, True), "no_empty_split": (3, True), "unique_records": (8, True)}


@pytest.mark.parametrize(
    "gate, change",
    [
        ("all_accepted", lambda r, c: (r[:-1] + [(*r[-1][:3], False)], c)),
        ("all_accepted", lambda r, c: (r[:-1] + [(*r[-1][:3], None)], c)),
        ("all_tools_covered", lambda r, c: (r, c[:-1])),
        ("all_tools_covered", lambda r, c: (r, [*c, ("pay", True)])),
        ("ok_present", lambda r, c: (r, [(t, False) for t, _ in c])),
        ("error_present", lambda r, c: (r, [(t, True) for t, _ in c])),
        ("required_paths", lambda r, c: (r[:-1] + [(*r[-1][:2], "conversation", True)], c)),
        ("no_empty_split", lambda r, c: ([(a, "train" if s == "test" else s, p, k) for a, s, p, k in r], c)),
        ("unique_records", lambda r, c: (r + r[:1], c)),
    ],
)
def test_each_gate_fails_alone(spark, gate, change):
    assert [k for k, (_, passed) in gates(spark, *change(*whole())).items() if not passed] == [gate]


def test_an_empty_corpus(spark):
    """As the report's own rules: nothing is refused, nothing repeats, and all that must be there is missing."""
    assert {k for k, (_, passed) in gates(spark, [], []).items() if passed} == {"all_accepted", "unique_records"}


def test_every_call_of_every_turn_counts(spark, tmp_path):
    """One conversation's turns, in plain Python: each assistant's text makes up to two calls, other roles' none."""
    rows = [(3, t, "assistant" if t % 2 else "user", "x" * n if n else None) for t, n in enumerate([5, 2, 8, 5, 1, 8, 4, 11, 2, 14, 7, 0, 3, 6])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    made = [(TOOLS[(len(x or "") + 3 + i) % 9], len(x or "") + i) for _, _, role, x in rows if role == "assistant" for i in range(len(x or "") % 3)]
    told = [k % 4 != 1 for _, k in made if k % 11 != 6]
    got = {r.gate: r.n for r in catalog.queries()["corpus_gates"](spark, str(tmp_path)).collect()}
    assert len(made) > len(told) > 5
    assert (got["all_tools_covered"], got["ok_present"], got["error_present"]) == (len({t for t, _ in made}), sum(told), len(told) - sum(told))

"""Stated cases of the parses, of runs and of prefixes, which the queries of the same names now draw from the tables."""

from pyspark.sql import functions as F

from talkweft.operators import validation as V
from talkweft.operators import wire as W


def test_outputs(spark):
    df = spark.createDataFrame([(i, f[0]) for i, f in enumerate(W.FIXTURES)], "i int, raw string")
    names = lambda c: F.array_join(F.transform(F.col(c)["calls"], lambda x: x["name"]), ",")
    rows = df.select("i", W.parsed_wire(F.col("raw")).alias("w"), W.parsed_serving(F.col("raw"), F.lit("t")).alias("s"))
    got = rows.select("i", F.coalesce("w.failure", F.lit("")), names("w"), F.coalesce("s.failure", F.lit("")), names("s")).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {i: f[1:] for i, f in enumerate(W.FIXTURES)}


def test_runs(spark):
    calls = "array<struct<name:string,arguments:string>>"
    df = spark.createDataFrame([(i, n, raw, r[1], r[2], len(r[0])) for i, r in enumerate(W.RUNS) for n, raw in enumerate(r[0])], f"i int, n int, raw string, wanted {calls}, results int, size int")
    runs = df.withColumn("p", W.parsed_wire(F.col("raw"))).groupBy("i", "wanted", "results", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda x: x["p"]).alias("passes"))
    long = F.col("size") == 3
    made = F.when(long, W.trajectory(F.col("passes"), F.col("wanted"), F.col("results"), 3, 2)).otherwise(W.trajectory(F.col("passes"), F.col("wanted"), F.col("results"), 2, 8))
    got = {r.i: tuple(r.t) for r in runs.select("i", made.alias("t")).collect()}
    assert got == {i: tuple(r[3:]) for i, r in enumerate(W.RUNS)}


def test_prefixes(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(V.PREFIX_FIXTURES)], "i int, j string").select("i", F.from_json("j", V.MESSAGES).alias("m"))
    m = F.col("m")
    got = df.select("i", F.size(V.first_prefix(m)), F.size(V.grounded_prefix(m)), F.array_join(F.transform(V.target_results(m), lambda x: x["tool_call_id"]), ","), F.coalesce(V.last_of(m, lambda x: x["role"] == "user")["content"], F.lit(""))).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {i: p[1:] for i, p in enumerate(V.PREFIX_FIXTURES)}


def test_message_rules(spark):
    df = spark.createDataFrame([(i, f[0]) for i, f in enumerate(V.FIXTURES)], "i int, j string").select("i", F.from_json("j", V.MESSAGES).alias("m"))
    got = {r.i: r.v for r in df.select("i", F.coalesce(V.message_violation(F.lit("r1"), F.col("m")), F.lit("")).alias("v")).collect()}
    assert got == {i: f[1] for i, f in enumerate(V.FIXTURES)}


def test_agreement(spark):
    with_call, without = V._fixture(V._user(), V._calls(V._FREEZE), V._result("call_r1_0"), V._answer()), V._fixture(V._user(), V._answer())
    stated = [(without, [], [], False, []), (with_call, ["call_r1_0"], ["freeze_card"], True, []), (with_call, ["x"], ["freeze_card"], True, ["ordered_calls mismatch"]), (with_call, ["call_r1_0"], ["list_cards"], True, ["expected tool_calls mismatch"]), (with_call, ["call_r1_0"], ["freeze_card"], False, ["requires_tool mismatch"])]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(stated)], "i int, j string, ordered array<string>, names array<string>, needs boolean, want array<string>").withColumn("m", F.from_json("j", V.MESSAGES))
    for r in df.withColumn("got", V.agreement_violations(F.col("m"), F.col("ordered"), F.col("names"), F.col("needs"))).collect():
        assert r.got == r.want, r.i

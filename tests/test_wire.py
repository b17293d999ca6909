"""Argument schemas of the wire: every message, and values at their bounds."""

import pytest

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from talkweft.operators import plugins, router_rows, seeds
from talkweft.operators import wire as W

OBJECT = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1, "maximum": 5}, "x": {"type": ["number", "null"]}, "mode": {"type": "string", "enum": ["a", "b"]}, "free": True, "list": {"type": "array"}, "o": {"type": "object"}}, "additionalProperties": False}


@pytest.mark.parametrize(
    ("schema", "arguments", "said"),
    [
        (OBJECT, {"n": 1, "x": 2, "mode": "a", "free": object, "list": [], "o": {}}, None),
        (OBJECT, {"n": 5, "x": None}, None),
        (OBJECT, {"x": 2.5}, None),
        (OBJECT, {"n": 0}, "value below minimum for pay.n"),
        (OBJECT, {"n": 6}, "value above maximum for pay.n"),
        (OBJECT, {"n": 2.0}, "invalid type for pay.n: expected ['integer'], got number"),
        (OBJECT, {"n": True}, "invalid type for pay.n: expected ['integer'], got boolean"),
        (OBJECT, {"x": "1"}, "invalid type for pay.x: expected ['null', 'number'], got string"),
        (OBJECT, {"list": {}}, "invalid type for pay.list: expected ['array'], got object"),
        (OBJECT, {"mode": "c"}, "value not in enum for pay.mode"),
        (OBJECT, {"pin": 1, "a": 2, "n": 0}, "unsupported arguments for pay: ['a', 'pin']"),
        (OBJECT | {"required": ["n", "mode"]}, {"n": 1}, "missing required arguments for pay: ['mode']"),
        (OBJECT | {"additionalProperties": True}, {"pin": 1}, None),
        ({"properties": {"n": {"type": "integer"}}}, {"pin": 1}, None),
        ({"type": "array"}, {}, "tool schema for pay must be an object"),
        ({"properties": []}, {}, "tool schema for pay has invalid properties"),
        ({"required": "n"}, {}, "tool schema for pay has invalid required list"),
        ({}, {}, None),
    ],
)
def test_arguments(schema, arguments, said):
    assert W.arguments_problem("pay", arguments, schema) == said


def test_manifest_is_stable():
    assert len(W.manifest()) == 9 and W.manifest_hash().startswith("sha256:") and W.manifest_hash() == W.manifest_hash()


def test_regression_rows(spark):
    rows = seeds.held_out_rows(spark).orderBy("row_no").collect()
    assert [r.row_no for r in rows] == list(range(7)) and [len(r.relations) for r in rows] == [1, 1, 0, 2, 2, 3, 1]
    assert {r.source_split for r in rows} == {"test"} and [r.domain_label for r in rows] == [1] * 6 + [0]


def test_keys_and_capabilities(spark):
    df = spark.createDataFrame([("f", "", "c", "t", "cards"), ("g", "s", "c", "t", None)], "a string, b string, c string, d string, cap string")
    group = router_rows.split_group(*[F.col(x) for x in "abcd"])
    assert [tuple(r) for r in df.select(group, router_rows.checked_capability(F.col("cap"))).collect()] == [("f||c|t", "cards"), ("g|s|c|t", None)]
    with pytest.raises(PySparkException, match="unknown capability: pets"):
        df.select(router_rows.checked_capability(F.lit("pets"))).collect()
    with pytest.raises(PySparkException, match="missing split key: customer_id"):
        df.select(router_rows.split_group(F.col("a"), F.col("b"), F.lit(None).cast("string"), F.col("d"))).collect()


def test_committed_tables(spark, tmp_path):
    """A table is in place only after its check has passed; where that fails nothing is left, and what is there is never replaced."""
    path, rows = str(tmp_path / "table"), spark.range(5)
    with pytest.raises(RuntimeError):
        plugins.committed(rows, path, lambda df: (_ for _ in ()).throw(RuntimeError("no")))
    assert list(tmp_path.iterdir()) == []
    assert plugins.committed(rows, path, lambda df: df.count()) == 5 and spark.read.parquet(path).count() == 5
    with pytest.raises(FileExistsError):
        plugins.committed(spark.range(9), path, lambda df: 0)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["table"]


def test_batches_keep_their_length(spark):
    """A teacher that answers fewer requests than it was given fails, named."""
    df = spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1)
    assert [r.raw_output for r in plugins.generated(df, lambda: lambda rows: [r["text"].upper() for r in rows], ["text"]).collect()] == ["A", "B"]
    with pytest.raises(PySparkException, match="model gave 1 texts for 2 rows"):
        plugins.generated(df, lambda: lambda rows: ["one"], ["text"]).collect()

"""Where a model, a parser, a tokenizer or a check of one's own plugs in: Arrow batches in, columns out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import _fs, _path
from .toolcalls import PARSED


def generated(df: DataFrame, make: Callable[[], Callable[[list[dict]], list[str]]], reads: list[str], name: str = "raw_output") -> DataFrame:
    """``df`` with the texts of a model. ``make`` runs once a task and gives a function of a batch of rows that returns as many texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            out = model(batch.to_dict("records"))
            if len(out) != len(batch):
                raise ValueError(f"model gave {len(out)} texts for {len(batch)} rows")
            yield pd.Series(out, dtype=object)

    return df.withColumn(name, F.pandas_udf(run, "string")(F.struct(*reads)))


def parsed_by(raw: Column, adapter: Callable[[str], tuple[str | None, list[tuple[str, str]]]]) -> Column:
    """failure and calls (name, canonical arguments) of outputs, by an adapter of one's own."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [adapter(r or "") for r in s]
            yield pd.DataFrame({"failure": [f for f, _ in rows], "calls": [[{"name": n, "arguments": a} for n, a in c] for _, c in rows]})

    return F.pandas_udf(run, PARSED)(raw)


def counted(text: Column, count: Callable[[str], int]) -> Column:
    """Token counts by a tokenizer of one's own."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else count(t)).astype("Int64")

    return F.pandas_udf(run, "long")(text)


def rendered(messages: Column, render: Callable[[list], str]) -> Column:
    """Prompts of message lists by a template of one's own."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda m: None if m is None else render(list(m)))

    return F.pandas_udf(run, "string")(messages)


def committed(df: DataFrame, path: str, finalize: Callable[[DataFrame], object]) -> object:
    """Write a table, let ``finalize`` look at it, and only then put it in place; where that raises, nothing is left."""
    spark, staged = df.sparkSession, f"{path.rstrip('/')}._staged"
    fs, where = _fs(spark, staged)
    df.write.mode("overwrite").parquet(staged)
    try:
        result = finalize(spark.read.parquet(staged))
    except BaseException:
        fs.delete(where, True)
        raise
    if fs.exists(_path(spark, path)):
        fs.delete(where, True)
        raise FileExistsError(path)
    fs.rename(where, _path(spark, path))
    return result

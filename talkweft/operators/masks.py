"""Training rows from conversations: rendered text, its tokens, and labels on what the assistant says alone.

Templates render on the JVM; only tokenizing runs in Python, over Arrow batches. A mask is proved, not assumed: the tokens of
the text before an assistant message, and of the text through it, must be the first tokens of the whole text. Where they are
not (a merge reaches over the border, or the template rewrites what came before), the row says so and has no labels.

A conversation's texts are rendered once for each assistant message, as the proof needs: that work grows with its length times
its turns. Byte-level vocabularies are tokenized a line at a time, so that a beginning of a text costs its last line alone;
with others every beginning is tokenized whole.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .templates import Template

IGNORED = -100
# Where an assistant's text ends in templates that don't say, and what rows without labels report.
END_MARKS = ["<|im_end|>", "<|end_of_role|>", "\nuser:", "\ntool "]
UNSTABLE = "chat template is not prefix-stable; assistant-only loss cannot be proven"
NO_END = "could not locate assistant span end in chat template"
NO_CALL = "assistant tool-call span did not include tool_call syntax"
NO_TARGET = "record has no assistant target"
TOO_LONG = "no complete user-to-final-assistant tool chain fits max_seq_len"
LINE = re.compile(r"(?<=[!-~])(?=\n)")
BATCH_BYTES = 8 << 20  # an Arrow batch to a worker, one row at least
RUN_CHARS = 1 << 20  # texts whose ids and labels a worker holds at a time, one row at least
READ_BACK = {"n_spans": "long", "labelled": "string", "whole": "string", "failure": "string"}
MASKED = "struct<input_ids:array<int>,labels:array<int>,spans:array<struct<message:int,start:int,end:int>>,failure:string>"


def _targets(m: Column) -> Column:
    return (m["role"] == "assistant") & F.coalesce(m["loss"], F.lit(True))


def assistant_cuts(template: Template, messages: Column, kind: ArrayType, rendered: Column, **constants) -> Column:
    """For each assistant message with loss: its number, the characters before it, through it and through the next end mark, whether it has calls.

    ``head`` and ``upto`` are -1 where the text before or through it isn't how the whole text begins, ``mark`` where there is none.
    """

    def one(i: Column) -> Column:
        m = F.get(messages, i)
        prefix = template.render(F.slice(messages, F.lit(1), i), kind, True, **constants)
        through = template.render(F.slice(messages, F.lit(1), i + 1), kind, False, **constants)
        head = F.when(F.startswith(rendered, prefix), F.char_length(prefix))
        ends = [F.position(F.lit(mark), rendered, head + 1) for mark in END_MARKS]
        nearest = F.array_min(F.filter(F.array(*[F.when(at > 0, at - 1 + len(mark)) for at, mark in zip(ends, END_MARKS, strict=True)]), lambda x: x.isNotNull()))
        upto = F.when(F.startswith(rendered, through), F.char_length(through))
        return F.struct(i.alias("message"), F.coalesce(head, F.lit(-1)).alias("head"), F.coalesce(upto, F.lit(-1)).alias("upto"), F.coalesce(nearest, F.lit(-1)).alias("mark"), (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0).alias("calls"))

    numbers = F.filter(F.sequence(F.lit(0), F.size(messages) - 1), lambda i: _targets(F.get(messages, i)))
    return F.when(F.size(messages) > 0, F.transform(numbers, one)).otherwise(F.array().cast("array<struct<message:int,head:int,upto:int,mark:int,calls:boolean>>"))


class _Tokens:
    """A tokenizer of a worker process, read once."""

    known: dict[str, _Tokens] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        said = json.loads(self.tokenizer.to_str())
        level = said["pre_tokenizer"] or {}
        self.by_lines = said["normalizer"] is None and said["model"]["type"] == "BPE" and not said["model"]["dropout"] and level.get("type") == "ByteLevel" and level["use_regex"] and not level["add_prefix_space"] and all(t["special"] for t in said["added_tokens"])

    @classmethod
    def of(cls, path: str) -> _Tokens:
        if path not in cls.known:
            cls.known[path] = cls(path)
        return cls.known[path]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def lines(self, text: str) -> list[int]:
        """Where a text can be cut so that the tokens of any beginning of it are those of its parts in turn.

        The byte-level pattern never joins a printable ASCII character with the newline after it, whatever follows.
        """
        return [0, *(m.start() for m in LINE.finditer(text))] if self.by_lines else [0]


def _mask(tokens: _Tokens, text: str, cuts: list[dict]) -> dict:
    """ids, labels, spans of a text, or why there are none."""
    starts = tokens.lines(text)
    parts = tokens.encode([text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)])
    ids = np.concatenate(parts)
    offsets = np.cumsum([0, *(len(p) for p in parts)])

    def upto(n: int) -> int | None:
        """How many tokens the text's first n characters have; None where they are not the first of the whole text."""
        k = bisect_right(starts, n) - 1
        tail = tokens.encode([text[starts[k] : n]])[0]
        end = int(offsets[k]) + len(tail)
        return end if np.array_equal(ids[offsets[k] : end], tail) else None

    refused = lambda why: {"input_ids": ids, "labels": ids[:0], "spans": [], "failure": why}
    labels, spans = np.full(len(ids), IGNORED, np.int32), []
    for c in cuts:
        if c["head"] < 0:
            return refused(UNSTABLE)
        start = upto(c["head"])
        ends = (upto(n) for n in (c["upto"], c["mark"]) if n >= 0 and start is not None)
        end = next((e for e in ends if e is not None and e > start), None)
        if end is None:
            return refused(NO_END if c["mark"] < 0 else UNSTABLE)
        if c["calls"] and "<tool_call>" in text and "<tool_call>" not in tokens.tokenizer.decode(ids[start:end].tolist()):
            return refused(NO_CALL)
        labels[start:end] = ids[start:end]
        spans.append({"message": c["message"], "start": start, "end": end})
    return {"input_ids": ids, "labels": labels, "spans": spans, "failure": None} if spans else refused(NO_TARGET)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows, where the session sets no other size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def _runs(*columns: pd.Series) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts hold RUN_CHARS together at most, or single rows: what a batch makes is larger than the batch."""
    first, chars = 0, 0
    for i, texts in enumerate(zip(*columns, strict=True)):
        n = sum(len(t or "") for t in texts)
        if i > first and chars + n > RUN_CHARS:
            yield first, i
            first, chars = i, 0
        chars += n
    if len(columns[0]) > first:
        yield first, len(columns[0])


def masked(text: Column, cuts: Column, vocabulary: str) -> Column:
    """MASKED of a rendered text by its cuts. ``vocabulary`` is a tokenizer's file that every worker can open."""

    @F.pandas_udf(MASKED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tokens = _Tokens.of(vocabulary)
        for texts, all_cuts in batches:
            for a, b in _runs(texts):
                yield pd.DataFrame([_mask(tokens, t or "", list(c)) for t, c in zip(texts[a:b], all_cuts[a:b], strict=True)], columns=["input_ids", "labels", "spans", "failure"])

    return run(text, cuts)


def _said(tokens: _Tokens, made: dict, field: str):
    """One of READ_BACK of a mask."""
    if field == "n_spans":
        return len(made["spans"])
    if field == "failure":
        return made["failure"]
    ids = made["input_ids"] if field == "whole" else made["labels"][made["labels"] != IGNORED]
    return tokens.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def read_back(rows: DataFrame, views: dict[str, tuple[Template, str, list[str], dict]], vocabulary: str) -> DataFrame:
    """``rows`` with what masks say when they are decoded: of each view's template, messages, fields of READ_BACK and constants the columns view_field.

    The masks are those of ``training_rows``. All views are masked and decoded by one worker process a task, and no ids travel.
    """
    bound_batches(rows.sparkSession)
    fields = [(k, f) for k, (_, _, wanted, _) in views.items() for f in wanted]
    names = [f"{k}_{f}" for k, f in fields]

    @F.pandas_udf("struct<" + ",".join(f"{n}:{READ_BACK[f]}" for n, (_, f) in zip(names, fields, strict=True)) + ">")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        tokens = _Tokens.of(vocabulary)
        for columns in batches:
            for a, b in _runs(*columns[::2]):
                out = []
                for row in zip(*(c[a:b] for c in columns), strict=True):
                    made = {k: _mask(tokens, t or "", list(cuts)) for k, t, cuts in zip(views_named, row[::2], row[1::2], strict=True)}
                    out.append([_said(tokens, made[k], f) for k, f in fields])
                yield pd.DataFrame(out, columns=names)

    views_named, cut = list(views), rows
    for k, (template, messages, _, constants) in views.items():
        kind = rows.schema[messages].dataType
        m = F.coalesce(F.col(messages), F.array().cast(kind))
        cut = cut.withColumn(f"_text_{k}", template.render(m, kind, False, **constants))
        cut = cut.withColumn(f"_cuts_{k}", assistant_cuts(template, m, kind, F.col(f"_text_{k}"), **constants))
    both = [f"_{c}_{k}" for k in views for c in ("text", "cuts")]
    return cut.select(*rows.columns, run(*both).alias("_said")).select(*rows.columns, "_said.*")


def token_counts(texts: Column, vocabulary: str) -> Column:
    """How many tokens each text of an array has."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = _Tokens.of(vocabulary)
        for lists in batches:
            yield pd.Series([[len(ids) for ids in tokens.encode(list(x))] if x is not None else None for x in lists])

    return run(texts)


def decoded(ids: Column, vocabulary: str) -> Column:
    """The text of an array of token ids."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _Tokens.of(vocabulary).tokenizer
        for lists in batches:
            yield pd.Series([tokenizer.decode(list(x), skip_special_tokens=False) if x is not None else None for x in lists])

    return run(ids)


def fitted(rows: DataFrame, template: Template, messages: str, budget: int, counts: Callable[[Column], Column], **constants) -> DataFrame:
    """``rows`` with the longest run of newest messages that begins with a user's, holds an assistant message with loss and fits the budget.

    Leading system messages stay before it. ``offset`` is how many messages of the conversation were left out between them;
    ``messages`` is null where nothing fits. A conversation that fits whole stays whole. ``counts`` sizes an array of texts.
    """
    kind = rows.schema[messages].dataType
    m = F.col(messages)
    n_system = F.coalesce(F.array_min(F.filter(F.transform(m, lambda x, i: F.when(x["role"] != "system", i)), lambda i: i.isNotNull())), F.lit(0))
    starts = F.filter(F.transform(m, lambda x, i: F.when((x["role"] == "user") & (i >= n_system), i)), lambda i: i.isNotNull())
    suffix = lambda i: F.concat(F.slice(m, F.lit(1), n_system), F.slice(m, i + 1, F.size(m)))
    starts = F.filter(starts, lambda i: F.exists(suffix(i), _targets))
    whole = F.struct(F.lit(0).alias("offset"), m.alias("messages"))
    runs = F.concat(F.array(whole), F.transform(starts, lambda i: F.struct((i - n_system).alias("offset"), suffix(i).alias("messages"))))
    found = rows.withColumn("_runs", runs)
    found = found.withColumn("_sizes", counts(F.transform("_runs", lambda r: template.render(r["messages"], kind, False, **constants))))
    fits = F.filter(F.arrays_zip("_runs", "_sizes"), lambda x: x["_sizes"] <= budget)
    first = F.get(fits, 0)["_runs"]
    return found.withColumn(messages, first["messages"]).withColumn("offset", first["offset"]).drop("_runs", "_sizes")


def training_rows(rows: DataFrame, template: Template, messages: str, vocabulary: str, budget: int | None = None, **constants) -> DataFrame:
    """``rows`` with text, input_ids, labels, spans (message numbers of the whole conversation) and failure (null: none)."""
    bound_batches(rows.sparkSession)
    kind = rows.schema[messages].dataType
    picked = fitted(rows, template, messages, budget, lambda texts: token_counts(texts, vocabulary), **constants) if budget else rows.withColumn("offset", F.lit(0))
    m = F.coalesce(F.col(messages), F.array().cast(kind))
    text = picked.withColumn("text", template.render(m, kind, False, **constants))
    cuts = assistant_cuts(template, m, kind, F.col("text"), **constants)
    made = text.withColumn("_m", masked(F.col("text"), cuts, vocabulary))
    spans = F.transform("_m.spans", lambda s: F.struct((s["message"] + F.col("offset")).alias("message"), s["start"].alias("start"), s["end"].alias("end")))
    too_long = F.col(messages).isNull() & F.lit(budget is not None)
    return made.withColumns({"input_ids": F.col("_m.input_ids"), "labels": F.col("_m.labels"), "spans": spans, "failure": F.when(too_long, TOO_LONG).otherwise(F.col("_m.failure"))}).drop("_m")

"""Masks in bounded memory: a text's beginnings by lines, runs of a batch, one worker process a task."""

import random

import pandas as pd
from pyspark.sql import functions as F

from talkweft.operators import masks as K
from talkweft.operators import templates as T
from talkweft.plans import catalog
from talkweft.plans.trained import TOOLS, stored_messages, vocabulary

CONVERSATIONS = "/root/testdata/sf0.001"


def test_beginnings_by_lines_equal_whole_encodings():
    """Tokens of a text's parts in turn are those of the text, and every beginning is judged as if encoded whole."""
    tokens, rng = K._Tokens.of(vocabulary()), random.Random(7)
    assert tokens.by_lines
    whole = lambda t: tokens.tokenizer.encode(t, add_special_tokens=False).ids
    pieces = ["a", "it's", "'s", "'", "é", "9", ":", ">", "\n", "\n\n", "\r\n", "\r", " ", "   ", "\t", "\x0b", "\x1c", "\x85", "\u00a0", "\u2028", "\u3000", "\u200b", "𝒳", "<|endoftext|>", "<|end|>\n", "\nuser:"]
    parted = 0
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        ids, starts = whole(text), tokens.lines(text)
        parted += len(starts) > 1
        for n in range(len(text) + 1):
            k = max(s for s in starts if s <= n)
            assert whole(text[:k]) + whole(text[k:n]) == whole(text[:n])
        cuts = [{"message": 0, "head": n, "upto": len(text), "mark": -1, "calls": False} for n in range(len(text))]
        for c in cuts:
            a = whole(text[: c["head"]])
            made = K._mask(tokens, text, [c])
            assert made["input_ids"].tolist() == ids
            assert [s["start"] for s in made["spans"]] == ([len(a)] if ids[: len(a)] == a and len(a) < len(ids) else [])
    assert parted > 100


def test_other_pre_tokenizers_are_not_parted():
    import public_tokenizers

    tokens = K._Tokens.of(public_tokenizers.path("word_bpe_49k.json"))
    assert not tokens.by_lines and tokens.lines("a:\nb") == [0]


def test_runs_of_a_batch():
    """Whole, in order, and no more than RUN_CHARS at a time; a longer text stands alone."""
    n = K.RUN_CHARS // 4
    texts = pd.Series(["x" * k for k in (n, n, n, n, n, 5 * n, 1, 0)] + [None])
    assert list(K._runs(texts)) == [(0, 4), (4, 5), (5, 6), (6, 9)]
    assert list(K._runs(texts, texts))[:2] == [(0, 2), (2, 4)] and list(K._runs(texts[:0])) == []


def test_one_worker_a_task(spark):
    """Masks of both templates and what they decode to take one Python step, and no more of a batch than BATCH_BYTES."""
    made = catalog.queries()["token_masks"](spark, CONVERSATIONS)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") is not None


def test_read_back_says_what_training_rows_hold(spark):
    rows = stored_messages(spark.read.parquet(f"{CONVERSATIONS}/conversations.parquet")).withColumn("messages", T.template_messages(F.col("messages")))
    marked = T.Template.read(T.MARKED)
    held = {r.conv_id: r for r in K.training_rows(rows, marked, "messages", vocabulary(), tools=TOOLS).collect()}
    said = K.read_back(rows, {"v": (marked, "messages", list(K.READ_BACK), {"tools": TOOLS})}, vocabulary()).collect()
    decode = K._Tokens.of(vocabulary()).tokenizer.decode
    assert len(said) == len(held) > 0
    for r in said:
        h = held[r.conv_id]
        assert (r.v_n_spans, r.v_failure, r.v_whole) == (len(h.spans), h.failure, h.text)
        assert r.v_labelled == decode([x for x in h.labels if x != K.IGNORED], skip_special_tokens=False)

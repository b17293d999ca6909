"""Quality classifier: a linear-chain conditional random field that labels every line good or bad.

A line is described by its own shares (symbols, capitals, digits, marks, repeats, ...) and by those of the lines
before and after it. Training lines carry their document's label. Forward-backward gives each line's
probability of being good; their mean, weighted by line lengths, is the document's raw quality, which a
logistic fit on the training documents turns into ``score``.

The field is fitted on the driver on at most TRAIN_DOCS labelled documents of each label (least hashed ids, no
text over TRAIN_CHARS or TRAIN_LINES line breaks): a bounded sample, as parameters; the driver holds 350 MB of features at
most. Every document weighs the same within its label, in both gradients. Rows whose crc32(doc_id as text) mod 4 is 2 are held
out and never trained on; labels, language, source and id are no inputs of a score.

Edge cases: null and empty texts are one empty line; equal texts get equal scores; labels are taken once per
document (the largest), null labels not at all; where training rows lack one of both labels nothing can be
told apart and every score is 1; a null doc_id is held out of training, and its ``held_out`` is false; very long texts
are scored whole, a task at a time; an empty table gives no rows; other columns are not read, so names can't clash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_batches, map_batches, written

TRAIN_DOCS, TRAIN_CHARS, TRAIN_LINES = 1200, 200_000, 1000
STEPS, RATE, RIDGE = 150, 0.08, 1e-3
THRESHOLD = 0.7
OWN = 11
WIDTH = 3 * OWN + 3
SYMBOLS, UPPER, DIGITS, MARKS = b"#*$%&<>", bytes(range(65, 91)), b"0123456789", b"!?|"


def line_features(text: str | None) -> tuple[np.ndarray, list[int]]:
    """Features [lines, WIDTH] and lengths of the lines that hold a word; one empty line if none does."""
    data = (text or "").encode("utf-8", "surrogatepass")
    lines = [x for x in data.split(b"\n") if x.strip()] or [b""]
    rows, sizes, seen = [], [], set()
    for x in lines:
        n = max(len(x), 1)
        words = x.split()
        w = max(len(words), 1)
        rows.append((
            math.log1p(len(x)) / 8,
            (len(x) - len(x.translate(None, SYMBOLS))) / w,
            (len(x) - len(x.translate(None, UPPER))) / n,
            (len(x) - len(x.translate(None, DIGITS))) / n,
            (len(x) - len(x.translate(None, MARKS))) / w,
            n / w / 10,
            len(set(words)) / w,
            1.0 if x in seen else 0.0,
            1.0 if x.endswith(b".") else 0.0,
            1.0 if w < 4 else 0.0,
            sum(x.count(b) for b in (b",", b".")) / w,
        ))
        seen.add(x)
        sizes.append(n)
    own = np.array(rows, np.float32)
    edge = np.zeros((1, OWN), np.float32)
    first, last = np.zeros((len(own), 1), np.float32), np.zeros((len(own), 1), np.float32)
    first[0], last[-1] = 1, 1
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), first, last, np.ones((len(own), 1), np.float32)]), sizes


def forward_backward(unary: np.ndarray, trans: np.ndarray, counts: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals [lines, 2] and summed pair marginals [2, 2], each line's by its weight, of chains of ``counts`` lines, laid end to end."""
    order = np.argsort(-counts, kind="stable")
    starts, size = (np.cumsum(counts) - counts)[order], counts[order]
    m = np.exp(trans - trans.max())
    e = np.exp(unary - unary.max(1, keepdims=True))
    alpha, beta = np.empty_like(e), np.ones_like(e)
    live = np.searchsorted(-size, -np.arange(size[0]), "left")  # chains with over t lines
    at = starts
    a = e[at] / e[at].sum(1, keepdims=True)
    alpha[at] = a
    for t in range(1, int(size[0])):
        at = starts[: live[t]] + t
        a = (a[: live[t]] @ m) * e[at]
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    for t in range(int(size[0]) - 2, -1, -1):
        n = live[t + 1]
        at = starts[:n] + t
        b = (beta[at + 1] * e[at + 1]) @ m.T
        beta[at] = b / b.sum(1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    inner = np.ones(len(e), bool)
    inner[np.cumsum(counts) - 1] = False
    i = np.flatnonzero(inner)
    pair = alpha[i][:, :, None] * m * (e[i + 1] * beta[i + 1])[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return gamma, pair.sum(0) if weight is None else (pair * weight[i][:, :, None]).sum(0)


def fit(docs: list[tuple[np.ndarray, list[int], int]], share: float) -> dict:
    """The field and its calibration from (features, line lengths, label); ``share`` of label 1 among all labelled."""
    x = np.vstack([d[0] for d in docs]).astype(np.float64)
    counts = np.array([len(d[0]) for d in docs])
    labels = np.array([d[2] for d in docs])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    mean[-1], scale[-1] = 0, 1
    x = (x - mean) / scale
    y = np.repeat(labels, counts)
    weight = np.repeat(np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) / counts, counts)[:, None]
    target = np.stack([1 - y, y], 1)
    inner = np.ones(len(x), bool)
    inner[np.cumsum(counts) - 1] = False  # a document's last line has no next one
    same = np.diag([weight[inner & (y == q)].sum() for q in (0, 1)])
    w, t = np.zeros((WIDTH, 2)), np.zeros((2, 2))
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
    for step in range(1, STEPS + 1):
        gamma, pair = forward_backward(x @ w, t, counts, weight)
        gw = x.T @ ((target - gamma) * weight) - RIDGE * w
        gt = (same - pair) - 10 * RIDGE * t
        for g, m, v, p in ((gw, mw, vw, w), (gt, mt, vt, t)):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    model = {"w": w / scale[:, None], "bias": -(mean / scale) @ w, "t": t, "a": 1.0, "b": 0.0}
    raw = quality([(d[0], d[1]) for d in docs], model)
    z = np.log(raw / (1 - raw))
    p = np.where(labels == 1, share / max(1, (labels == 1).sum()), (1 - share) / max(1, (labels == 0).sum()))
    design, coef = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(30):  # Newton steps of a weighted logistic fit
        q = 1 / (1 + np.exp(-np.clip(design @ coef, -30, 30)))
        grad = design.T @ (p * (labels - q)) - 1e-4 * (coef - [1.0, 0.0])
        coef = coef + np.clip(np.linalg.solve((design * (p * q * (1 - q))[:, None]).T @ design + 1e-4 * np.eye(2), grad), -2, 2)
    return model | {"a": float(max(coef[0], 1e-3)), "b": float(coef[1])}


def quality(docs: list[tuple[np.ndarray, list[int]]], model: dict) -> np.ndarray:
    """Length-weighted mean of the lines' probabilities of being good, kept off 0 and 1."""
    counts = np.array([len(d[0]) for d in docs])
    gamma, _ = forward_backward(np.vstack([d[0] for d in docs]).astype(np.float64) @ model["w"] + model["bias"], model["t"], counts)
    size = np.concatenate([d[1] for d in docs]).astype(float)
    starts = np.cumsum(counts) - counts
    mean = np.add.reduceat(gamma[:, 1] * size, starts) / np.add.reduceat(size, starts)
    return np.clip(mean, 1e-6, 1 - 1e-6)


def scores_of(texts: list[str | None], model: dict | None) -> list[float]:
    if model is None:
        return [1.0] * len(texts)
    out: list[float] = []
    for a in range(0, len(texts), 1000):
        z = quality([line_features(t) for t in texts[a : a + 1000]], model)
        out += np.round(1 / (1 + np.exp(-(model["a"] * np.log(z / (1 - z)) + model["b"]))), 9).tolist()
    return out


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The field fitted on the training rows of ``docs``; None where a label is missing."""
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(~held_out())
    short = (F.length(F.coalesce("text", F.lit(""))) <= TRAIN_CHARS) & (F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) >= F.length(F.coalesce("text", F.lit(""))) - TRAIN_LINES)
    known = docs.where(short).select("doc_id").join(marks, "doc_id", "left_semi").distinct()
    known = written(known.join(marks, "doc_id"), "labelled")  # ids and labels: texts are measured once
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return None
    picked = {r[0]: r[1] for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS).collect()}

    def make():
        def work(x: dict) -> dict:
            made = [line_features(t) for t in x["text"]]
            return {"doc_id": x["doc_id"], "f": [f.tobytes() for f, _ in made], "sizes": [s for _, s in made]}

        return work

    rows = map_batches(docs.where(F.col("doc_id").isin(list(picked)) & short).select("doc_id", "text"), make, "doc_id long, f binary, sizes array<int>").collect()
    rows = list({r["doc_id"]: r for r in sorted(rows, key=lambda r: (r["doc_id"], bytes(r["f"])))}.values())
    return fit([(np.frombuffer(r["f"], np.float32).reshape(-1, WIDTH), list(r["sizes"]), picked[r["doc_id"]]) for r in rows], counts[1] / (counts[0] + counts[1]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    model = train(docs, labels)

    def make():
        return lambda x: {"doc_id": x["doc_id"], "score": scores_of(x["text"], model)}

    scored = map_batches(docs.select("doc_id", "text"), make, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` predicted good, with the columns of documents."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    model = train(docs, labels)

    def make():
        return lambda texts: [s >= THRESHOLD for s in scores_of(texts, model)]

    return filter_batches(docs.select(*cols), make, ["text"])

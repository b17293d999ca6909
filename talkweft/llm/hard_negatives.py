"""Hard negatives by blocked dense products.

Components are quantised to integers in doubles, so that a matrix product gives every inner product exactly (below 2^53;
blocks that could pass that are multiplied in Python's integers). Anchors are numbered and taken ANCHORS at a time. A wave of
anchors is broadcast and every task multiplies its candidates with it, tile by tile, keeping the first ``positives`` rows of
the anchor's label; what tasks keep is merged by anchor. A second pass keeps, for every anchor and positive, the first
``negatives`` rows of other labels whose score lies in the positive's window. Tasks send at most anchors x positives x
negatives rows, whatever they read, and a candidate that doesn't pass what is kept already costs one comparison.

Rows of null id, label or vector and of null or non-finite components take no part. Vectors of different lengths have no
product and don't meet; empty ones have product 0. Higher scores come first, ties by smaller id. A row with the anchor's id
is never its positive; rows that repeat an id are rows of their own otherwise, as anchors too. Scores beyond a long count as
the largest or least long. Negative positives have an empty window. An empty table gives an empty one. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, numbered, written

ANCHORS = 16_384  # anchors of a wave: 8 MB of 64 components, and at most 4 MB of kept rows a positive and task
TILE_ANCHORS, TILE_ROWS = 256, 1024  # scores at hand: 2 MB
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
PAIR = "anchor long, slot int, vec_id long, score long"


def prepared(vectors: DataFrame, scale: int = 256, label: Column | None = None) -> DataFrame:
    """vec_id, label and quantised vector of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    vector = F.transform("embedding", lambda x: _floored(x.cast("double") * float(scale)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("int").alias("label"), vector.alias("vector"))


def _floored(x: Column) -> Column:
    """Floor of a double as a double; from 2^52 on all are whole."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def _matrix(vectors: pa.ListArray, dim: int, rows: np.ndarray) -> np.ndarray:
    values, at = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[rows]
    return values[at[:, None] + np.arange(dim)] if dim else np.zeros((len(rows), 0))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all of ``b``, as doubles where they can't pass 2^53, else as longs' values in objects."""
    if not a.size or not b.size or np.abs(a).max(0) @ np.abs(b).max(0) < EXACT:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object)
    return np.clip(whole(a) @ whole(b).T, -LONG - 1, LONG)


class Kept:
    """The first k (score, id) of each of n lists; merges candidates in any order."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id, self.full = k, np.zeros((n, k), np.int64), np.full((n, k), LONG), np.zeros(n, np.int32)

    def beats(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of scores (a row a list) come before the last kept one; all where fewer than k are kept."""
        last, last_id = self.score[lists, -1][:, None], self.id[lists, -1][:, None]
        return (self.full[lists] < self.k)[:, None] | (scores > last) | ((scores == last) & (ids < last_id))

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(lists):
            return
        touched = np.unique(lists)
        slot = np.arange(self.k)[None, :] < self.full[touched][:, None]
        lists = np.concatenate([np.repeat(touched, self.full[touched]), lists])
        scores = np.concatenate([self.score[touched][slot], scores.astype(np.int64)])
        ids = np.concatenate([self.id[touched][slot], ids])
        order = np.lexsort((ids, ~scores, lists))
        lists, scores, ids = lists[order], scores[order], ids[order]
        at = np.arange(len(lists)) - np.searchsorted(lists, lists)
        kept = at < self.k
        self.score[lists[kept], at[kept]], self.id[lists[kept], at[kept]] = scores[kept], ids[kept]
        self.full[touched] = np.minimum(self.k, np.bincount(np.searchsorted(touched, lists), minlength=len(touched)))

    def rows(self, width: int) -> pa.RecordBatch:
        """List number i stands for anchor i // width and slot i % width."""
        n, at = np.nonzero(np.arange(self.k)[None, :] < self.full[:, None])
        return pa.RecordBatch.from_arrays([pa.array(n // width, pa.int64()), pa.array((n % width).astype(np.int32)), pa.array(self.id[n, at]), pa.array(self.score[n, at])], ["anchor", "slot", "vec_id", "score"])


def _tiles(batches: Iterator[pa.RecordBatch], wave: list, by_dim: dict[int, np.ndarray]):
    """For each tile: numbers of its anchors, their scores with its candidates, and the candidates' ids and labels."""
    for batch in batches:
        ids, labels, vectors = (batch.column(n) for n in ("vec_id", "label", "vector"))
        ids, labels, sizes = ids.to_numpy(), labels.to_numpy(), np.diff(vectors.offsets.to_numpy())
        for dim, anchors in by_dim.items():
            rows = np.flatnonzero(sizes == dim)
            for i in range(0, len(rows), TILE_ROWS):
                some = rows[i : i + TILE_ROWS]
                matrix = _matrix(vectors, dim, some)
                for j in range(0, len(anchors), TILE_ANCHORS):
                    own = anchors[j : j + TILE_ANCHORS]
                    yield own, _products(wave[2][own][:, :dim], matrix), ids[some], labels[some]


def _scan(candidates: DataFrame, wave: tuple, search: Callable) -> DataFrame:
    """``search`` gives what a task keeps of the tiles of its candidates."""
    shared = candidates.sparkSession.sparkContext.broadcast(wave)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        yield search(at, _tiles(batches, at, {int(d): np.flatnonzero(at[3] == d) for d in np.unique(at[3])}))

    return map_arrow(candidates, run, PAIR)


def _first(pairs: DataFrame, k: int) -> DataFrame:
    """What tasks have kept, merged: the first k of each anchor and slot, numbered from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positives(k: int) -> Callable:
    def search(wave: tuple, tiles) -> pa.RecordBatch:
        ids, labels, kept = wave[0], wave[1], Kept(len(wave[0]), k)
        for own, scores, others, other_labels in tiles:
            fit = (labels[own][:, None] == other_labels) & (ids[own][:, None] != others)
            a, c = np.nonzero(fit & kept.beats(own, scores, others))
            kept.add(own[a], scores[a, c], others[c])
        return kept.rows(1)

    return search


def _negatives(k: int, width: int) -> Callable:
    def search(wave: tuple, tiles) -> pa.RecordBatch:
        labels, bound, kept = wave[1], wave[4], Kept(len(wave[0]) * width, k)
        for own, scores, others, other_labels in tiles:
            other = labels[own][:, None] != other_labels
            for slot in range(width):
                most, least = bound[own, slot, 1][:, None], bound[own, slot, 0][:, None]
                a, c = np.nonzero(other & (scores <= most) & (scores >= least) & kept.beats(own * width + slot, scores, others))
                kept.add(own[a] * width + slot, scores[a, c], others[c])
        return kept.rows(width)

    return search


def _wave(rows: list) -> tuple:
    """Ids, labels, vectors (padded by zeros), their lengths."""
    sizes = np.array([len(r.vector) for r in rows], np.int64)
    vectors = np.zeros((len(rows), int(sizes.max(initial=0))))
    for i, r in enumerate(rows):
        vectors[i, : sizes[i]] = r.vector
    return np.array([r.vec_id for r in rows], np.int64), np.array([r.label for r in rows], np.int32), vectors, sizes


def _windows(found: list, n: int, width: int, low: int) -> np.ndarray:
    """The least and the largest score that a negative may have, by anchor and positive; an empty window where there is none."""
    bound = np.zeros((n, width, 2), np.int64)
    bound[:, :, 0] = 1
    for r in found:
        bound[r.anchor, r["rank"] - 1] = -(-low * r.score // 100), r.score
    return bound


def hard_negatives(vectors: DataFrame, anchors: Column | None = None, label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, at_once: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` says which rows are anchors (default: vec_id divisible by 100), ``label`` what a row's label becomes.
    A negative's score is at least ``low`` hundredths of the positive's and not above it.
    """
    candidates = written(prepared(vectors, scale, label), "vectors")
    queries = written(numbered(candidates.where(F.col("vec_id") % 100 == 0 if anchors is None else anchors), [F.asc("vec_id")], "anchors"), "anchors-numbered")
    out = None
    for start in range(0, max(1, queries.count()), at_once):
        rows = sorted(queries.where((F.col("number") >= start) & (F.col("number") < start + at_once)).collect(), key=lambda r: r.number)  # at most ``at_once``
        wave = _wave(rows)
        found = written(_first(_scan(candidates, wave, _positives(positives)), positives), "positives")
        bound = _windows(found.select("anchor", "rank", "score").collect(), len(rows), positives, low)
        best = _first(_scan(candidates, (*wave, bound), _negatives(negatives, positives)), negatives)
        names = queries.select((F.col("number") - start).alias("anchor"), F.col("vec_id").alias("anchor_id"))
        pairs = found.select("anchor", (F.col("rank") - 1).cast("int").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        joined = best.join(pairs, ["anchor", "slot"]).join(names, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        joined = written(joined, "negatives")
        out = joined if out is None else out.unionAll(joined)
    return out

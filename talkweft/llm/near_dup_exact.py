"""Candidates of near duplicates that miss no link: a prefix-filtered join of whole shingle sets.

Shingles are ordered by how often their cell of a fixed table of counters occurs (any order that all sets share is right; rare
ones first makes short lists). Two sets of n and m shingles that are similar enough share one of the first n - ceil(t n) + 1
of one and likewise of the other, so only these are posted. In a list, sizes must fit, and so must places: what both sets have
from here on must be enough for the share. Lists whose classes are all in one component are skipped; long lists are cut into
blocks, and each pair of blocks is a task's work of bounded size. A class becomes a candidate of a component, one row however
many of its classes it meets, and is then held against that component's whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, by_ids, map_arrow, map_batches, release, shuffle_partitions, slices

COUNTERS = 1 << 20  # 8 MB to the driver and to each worker, whatever the input
LIST = 1500
POSTS = "shingle long, rep long, comp long, members long, n int, place int"


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def prefix_size(n: int, share: int) -> int:
    """How many of n shingles must be posted so that sets with ``share`` hundredths of their union in common meet."""
    return n - -(-share * n // 100) + 1


def fits(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray, share: int) -> np.ndarray:
    """Whether sets of n and m shingles whose first common one stands at places i and j can be similar enough."""
    most = np.minimum(n - i, m - j)
    return (100 * n >= share * m) & (100 * m >= share * n) & ((100 + share) * most >= share * (n + m))


def _counts(texts: DataFrame, sets_of) -> np.ndarray:
    """Occurrences of shingles by cell."""

    def run(batches):
        total, sets = np.zeros(COUNTERS, np.int64), sets_of()
        for batch in (s for whole in batches for s in slices(whole)):
            for t in batch.column(0).to_pylist():
                np.add.at(total, _cell(sets(t)), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["cell", "n"])
        release()

    rows = map_arrow(texts.select("text"), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def _posts(rows: DataFrame, sets_of, shared, share: int) -> DataFrame:
    def make():
        sets = sets_of()

        def work(x: dict) -> dict:
            out: dict[str, list] = {k: [] for k in ("shingle", "rep", "comp", "members", "n", "place")}
            for rep, comp, members, text in zip(x["rep"], x["comp"], x["members"], x["text"], strict=True):
                s = sets(text)
                k = prefix_size(len(s), share)
                first = s[np.lexsort((s, shared.value[_cell(s)]))[:k]]
                out["shingle"] += first.view(np.int64).tolist()
                for name, v in (("rep", rep), ("comp", comp), ("members", members), ("n", len(s))):
                    out[name] += [v] * k
                out["place"] += range(k)
            return out

        return work

    return map_batches(rows, make, POSTS)


def wanted_pairs(known: DataFrame, docs: DataFrame, sets_of, share: int) -> DataFrame:
    """x (a class) and comp (a component not smaller than its own) that may be linked: none that is linked is missing.

    ``known`` has rep, comp and members (classes of the component); ``sets_of()`` gives a function from a text to its sorted hashes.
    """
    texts = by_ids(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), known.select(F.col("rep").alias("doc_id")), "left_semi").dropDuplicates(["doc_id"])
    rows = known.select("rep", "comp", "members").join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    shared = docs.sparkSession.sparkContext.broadcast(_counts(texts, sets_of))
    posts = _posts(rows, sets_of, shared, share)
    mixed = posts.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("shingle", "size")
    live = posts.join(mixed, "shingle")
    blocks = F.ceil(F.col("size") / LIST).cast("int")
    live = live.select("*", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("own"))
    rest = ["own", "rep", "comp", "members", "n", "place"]
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = live.select("shingle", *rest, other).select("shingle", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *rest)
    dealt = tasks.repartition(shuffle_partitions(docs.sparkSession), "shingle", "i", "j").sortWithinPartitions("shingle", "i", "j", "own", "rep")
    schema = _arrow_schema("x long, comp long")

    def run(batches):
        def meet(own, rep, comp, members, n, place) -> np.ndarray:
            """Rows of one task: of one block, or of two."""
            k = int(np.searchsorted(own, own[-1])) if own[0] != own[-1] else 0
            left, right = (slice(0, k), slice(k, None)) if k else (slice(None), slice(None))
            ok = (comp[left][:, None] != comp[right][None, :]) & fits(n[left][:, None], place[left][:, None], n[right][None, :], place[right][None, :], share)
            if not k:
                ok = np.triu(ok, 1)
            i, j = np.nonzero(ok)
            j = j + k
            swap = (members[i] > members[j]) | (members[i] == members[j]) & (comp[i] < comp[j])
            return np.stack([rep[np.where(swap, j, i)], comp[np.where(swap, i, j)]], 1)

        def emit(found):
            pairs = np.unique(np.concatenate([np.empty((0, 2), np.int64), *found]), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

        held = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(9)]
            cols = cols if held is None else [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            key = np.stack(cols[:3], 1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()]
            yield from emit([meet(*(c[s:e] for c in cols[3:])) for s, e in zip(edges[:-1], edges[1:], strict=True) if e - s > 1])
            held = [c[edges[-1] :] for c in cols]
        if held is not None and len(held[0]) > 1:
            yield from emit([meet(*held[3:])])
        release()

    return map_arrow(dealt.select("shingle", "i", "j", *rest), run, "x long, comp long").distinct()

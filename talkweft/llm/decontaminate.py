"""Benchmark decontamination by a prefix-filtered join of windows.

A window is ``size`` consecutive words of an item (all of a shorter item). Its shingles are runs of up to SHINGLE words. One
scan of the documents counts how often each shingle of a window occurs; in the order of rarity a window's first shingle is its
necessary prefix: a document that holds the window holds that shingle. A second scan meets every shingle of a document with
the prefixes, places the window by the shingle's position in it, drops places that begin before or end after the document
(position and length bounds), compares a rolling hash of the words there and then a 128-bit digest of the words themselves.
Work grows with the occurrences of the rarest shingles, not with pairs.

Shingles and windows are 8 and 16 bytes here, whatever their words. At most WINDOWS of them are broadcast at a time; more
take further scans over the same documents, and what each scan found is united by document.

Null and empty texts have no words and are clean. Items of null or empty text have no window; those of null id hit words but
are not listed. Repeated items and rows count once an item and once a row. Very long texts are cut into MBs of whole words.
An empty benchmark hits nothing, an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, by_ids, map_arrow, release, slices, written

SIZE = 10
SHINGLE = 3
WINDOWS = 500_000  # windows of a scan: about 20 MB broadcast
PIECE = 1 << 20  # bytes of text hashed at a time (one word at least)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SMALL = np.uint64(1_099_511_628_211)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By byte: part of a word, and the byte with A-Z lowered."""
    b = np.arange(256)
    upper = (b >= 65) & (b <= 90)
    lowered = np.where(upper, b + 32, b).astype(np.uint8)
    return upper | ((b >= 97) & (b <= 122)) | ((b >= 48) & (b <= 57)) | (b >= 128), lowered


def _powers(n: int) -> np.ndarray:
    out = np.full(n, SMALL, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of some texts: where they lie in ``data``, a 64-bit hash of each, and each text's first word (and the end)."""

    def __init__(self):
        self.inside, self.lowered = _tables()
        self.powers = _powers(1 << 10)

    def read(self, batch: pa.RecordBatch) -> None:
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        self.texts, self.data = texts, b"\n".join(texts)
        raw, found, at = np.frombuffer(self.data, np.uint8), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))], 0
        while at < len(raw):
            end = min(at + PIECE, len(raw))
            while end < len(raw) and self.inside[raw[end]]:  # to the end of a word
                end += 1
            found.append(self._piece(raw[at:end], at))
            at = end
        self.starts, self.ends, self.hashes = (np.concatenate(x) for x in zip(*found, strict=True))
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)]))
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def _piece(self, raw: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = self.inside[raw]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            return starts, ends, np.zeros(0, np.uint64)
        sizes = ends - starts
        if sizes.max() > len(self.powers):
            self.powers = _powers(int(sizes.max()))
        place, first = np.flatnonzero(inside[1:-1]), np.cumsum(sizes) - sizes
        value = (self.lowered[raw[place]].astype(np.uint64) + np.uint64(1)) * self.powers[np.arange(len(place)) - np.repeat(first, sizes)]
        value = np.add.reduceat(value, first)
        value = (value ^ (value >> np.uint64(31))) * BASE
        return starts + at, ends + at, value ^ (value >> np.uint64(29))

    def runs(self, n: int) -> np.ndarray:
        """A hash of the n words from each word on. Some reach into the next text."""
        return runs(self.hashes, np.arange(max(0, len(self.hashes) - n + 1)), n)

    def whole(self, n: int) -> np.ndarray:
        """Which of runs(n) stay in their text."""
        at = np.arange(max(0, len(self.hashes) - n + 1))
        return self.text_of[at] == self.text_of[at + n - 1]

    def digest(self, at: int, n: int) -> bytes:
        """Of n lowered words joined by a space; bytes.lower lowers A-Z only."""
        return hashlib.blake2b(b" ".join(self.data[a:b].lower() for a, b in zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist(), strict=True)), digest_size=16).digest()


def runs(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each of the places ``at``."""
    out = np.full(len(at), n, np.uint64)
    for k in range(n):
        out = (out * BASE) ^ hashes[at + k]
    out ^= out >> np.uint64(32)
    return (out * BASE).view(np.int64)


def item_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """item_id, window (digest), n_words, rolling (hash of all its words) and shingles of every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in (s for b in batches for s in slices(b)):
            words.read(batch)
            rows: list[tuple] = []
            for item, a, b in zip(batch.column("item_id").to_pylist(), words.first.tolist(), words.first[1:].tolist(), strict=False):
                n = min(size, b - a)
                k = min(SHINGLE, n)
                for at in range(a, b - n + 1) if n else ():
                    rows.append((item, words.digest(at, n), n, int(runs(words.hashes, np.array([at]), n)[0]), runs(words.hashes, np.arange(at, at + n - k + 1), k).tolist()))
                    if len(rows) == 20_000:
                        yield _batch(rows)
                        rows = []
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["item_id", "window", "n_words", "rolling", "shingles"])

    return map_arrow(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), run, "item_id long, window binary, n_words int, rolling long, shingles array<long>")


def _blocks(table: DataFrame, key: str, at_once: int) -> Iterator[pa.Table]:
    """The rows of a table in blocks of about ``at_once``, dealt by the hash of ``key``; one block, maybe empty, at least."""
    n = max(1, -(-table.count() // at_once))
    for i in range(n):
        yield (table if n == 1 else table.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)).toArrow()


def _by_kind(block: pa.Table) -> dict[int, pa.Table]:
    return {k: block.filter(pc.equal(block["kind"], k)) for k in pc.unique(block["kind"]).to_pylist()}


def shingle_counts(docs: DataFrame, shingles: DataFrame, at_once: int = 4 * WINDOWS) -> DataFrame:
    """shingle, kind (its words) and how often it occurs in all documents, for those of ``shingles`` that occur."""
    out = None
    for block in _blocks(shingles, "shingle", at_once):
        shared = docs.sparkSession.sparkContext.broadcast({k: np.unique(t["shingle"].to_numpy()) for k, t in _by_kind(block).items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words, known = Words(), shared.value
            seen = {k: np.zeros(len(v), np.int64) for k, v in known.items()}
            for batch in (s for b in batches for s in slices(b)):
                words.read(batch)
                for k, own in known.items():
                    each = words.runs(k)[words.whole(k)]
                    at = np.minimum(np.searchsorted(own, each), len(own) - 1)
                    seen[k] += np.bincount(at[own[at] == each], minlength=len(own))
            for k, n in seen.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(known[k][some]), pa.array(np.full(len(some), k, np.int32)), pa.array(n[some])], ["shingle", "kind", "n"])
            release()

        found = map_arrow(docs.select("text"), run, "shingle long, kind int, n long").groupBy("shingle", "kind").agg(F.sum("n").alias("n"))
        out = found if out is None else out.unionAll(found)
    return out


def prefixes(docs: DataFrame, windows: DataFrame, at_once: int = WINDOWS) -> DataFrame:
    """Distinct windows, each with its rarest shingle over all documents (ties: smaller hash) and that shingle's place.

    Windows that have a shingle which no document holds can't occur and are left out.
    """
    each = windows.dropDuplicates(["window"]).select("window", "n_words", "rolling", F.least("n_words", F.lit(SHINGLE)).alias("kind"), F.posexplode("shingles").alias("place", "shingle"))
    each = written(each, "shingles")
    counts = shingle_counts(docs, each.select("shingle", "kind").distinct(), 4 * at_once)
    ranked = each.join(counts, ["shingle", "kind"], "left").groupBy("window", "n_words", "rolling", "kind").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "place")).alias("first"))
    return written(ranked.where("first.n > 0").select("window", "n_words", "rolling", "kind", "first.shingle", "first.place"), "prefixes")


class Prefixes:
    """Windows by prefix shingle, for one kind of shingle."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("shingle")
        self.shingle, self.place, self.n, self.rolling = (rows[c].to_numpy().astype(np.int64) for c in ("shingle", "place", "n_words", "rolling"))
        self.window = rows["window"].to_pylist()

    def occurrences(self, words: Words, kind: int) -> Iterator[tuple[int, int, bytes]]:
        """First word, number of words and digest of each window that occurs."""
        each = words.runs(kind)
        left = np.searchsorted(self.shingle, each)
        met = np.flatnonzero(self.shingle[np.minimum(left, len(self.shingle) - 1)] == each)
        sizes = np.searchsorted(self.shingle, each[met], "right") - left[met]
        at = np.repeat(left[met] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        met = np.repeat(met, sizes)
        text, begin = words.text_of[met], met - self.place[at]
        inside = (begin >= words.first[text]) & (begin + self.n[at] <= words.first[text + 1])
        begin, at = begin[inside], at[inside]
        for n in np.unique(self.n[at]).tolist():
            some = np.flatnonzero(self.n[at] == n)
            some = some[runs(words.hashes, begin[some], n) == self.rolling[at[some]]]
            for a, row in zip(begin[some].tolist(), at[some].tolist(), strict=True):
                if words.digest(a, n) == self.window[row]:
                    yield a, n, self.window[row]


def _united(spans: list[tuple[int, int]]) -> list[dict]:
    """Spans in order, those that meet made one."""
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


FOUND = "doc_id long, digest binary, n_words long, spans array<struct<start: int, end: int>>, windows array<binary>"


def _search(docs: DataFrame, block: pa.Table) -> DataFrame:
    """A row for each document: words, united spans of hit words, windows that occur."""
    shared = docs.sparkSession.sparkContext.broadcast({k: Prefixes(t) for k, t in _by_kind(block).items()})
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = Words(), shared.value
        for batch in (s for b in batches for s in slices(b)):
            words.read(batch)
            spans, windows = defaultdict(list), defaultdict(set)
            for kind, own in known.items():
                for a, n, window in own.occurrences(words, kind):
                    text = int(words.text_of[a])
                    spans[text].append((a - int(words.first[text]), a - int(words.first[text]) + n))
                    windows[text].add(window)
            digests = [hashlib.blake2b(t, digest_size=16).digest() for t in words.texts]
            texts = range(batch.num_rows)
            columns = [pa.array(digests, pa.binary()), pa.array(np.diff(words.first)), pa.array([_united(spans[i]) if i in spans else [] for i in texts], spans_type), pa.array([sorted(windows[i]) if i in windows else [] for i in texts], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "digest", "n_words", "spans", "windows"])
        release()

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, FOUND)


def find_windows(docs: DataFrame, windows: DataFrame, at_once: int = WINDOWS) -> DataFrame:
    """doc_id, digest of the text, copies (rows of both), n_words, n_hit, spans of hit words by scan, digests of windows that occur."""
    found = None
    for i, block in enumerate(_blocks(prefixes(docs, windows, at_once), "window", at_once)):
        part = _search(docs, block).withColumn("scan", F.lit(i))
        found = part if found is None else found.unionAll(part)
    one = found.groupBy("doc_id", "digest").agg(F.max("n_words").alias("n_words"), F.count_if(F.col("scan") == 0).alias("copies"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("windows"))).alias("windows"))
    start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("upto"))
    step = lambda got, s: F.struct((got.hit + F.greatest(s.end - F.greatest(s.start, got.upto), F.lit(0))).alias("hit"), F.greatest(got.upto, s.end).alias("upto"))
    return written(one.withColumn("n_hit", F.aggregate("spans", start, step).hit), "found")


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, at_once: int = WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, spans (start and end in words) and items (sorted strings) of every row of ``docs``."""
    windows = written(item_windows(items, size), "windows")
    found = find_windows(docs, windows, at_once)
    listed = windows.where("item_id IS NOT NULL").select("window", F.col("item_id").cast("string").alias("item")).distinct()
    if listed.count() <= BROADCAST_ROWS // 8:
        listed = F.broadcast(listed)
    each = found.where(F.size("windows") > 0).select("doc_id", "digest", F.explode("windows").alias("window")).join(listed, "window")
    held = each.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), "items")
    rows = found.join(held, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")), "left")
    return rows.select("doc_id", "n_words", "n_hit", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")


def keep_clean(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows of ``docs`` that hold no window; rows of null id are judged by nothing and stay."""
    bad = contamination(docs, items, size).where("n_hit > 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return by_ids(docs, bad, "left_anti")

"""Near duplicates by an inverted join of MinHash coordinates.

1. Every document gets the set of its distinct shingles, a digest of the set, and a signature of COORDS
   minima. Documents of equal sets form a class; the class stands for them from here on.
2. Stars: classes that agree on BAND consecutive coordinates are linked to the least class there, never to each
   other. Links are confirmed on the full sets, and confirmed links give first components.
3. Inverted join: a class is posted under its coordinate-value pairs. Two classes that agree on MATCHES
   coordinates must share one of their COORDS - MATCHES + 1 rarest pairs, so only that prefix is posted. Lists whose
   classes are all in one component are skipped, hence groups of copies cost no pairs. In the others agreeing
   coordinates are counted for classes of different components; lists over LIST rows are cut into blocks, and
   each pair of blocks is a task's work of bounded size. From MATCHES on, the class of the smaller component
   becomes a candidate of the other component: one row, however many of its classes agree. Where that component is
   a single class, the SKETCH least hashes of both sets may rule the pair out. All others are then held, on full sets, against the classes of that component, block by block, until one is linked: one link joins both.
4. Components of all confirmed links, by repeated minima, checkpointed as tables in the shared folder.

A link is missed when its signature agrees on fewer than MATCHES of COORDS (probability 4.3e-5 at similarity 0.8, 6e-6 at
0.82, 1.5e-7 at 0.85) and the stars don't join its components. Coordinates are compared by 16 bits; a pair is taken up in
the list of its first posted coordinate that agrees, so a chance agreement before it costs at most 4e-5 more, and
sketches at most 2e-5. Everything
confirmed is exact.

Edge cases: A-Z is lower-cased; texts of one word are one shingle; null, empty and blank texts have no shingles
and no links, so each is a component by itself; null doc_ids keep a null component and are linked with nothing;
rows that repeat a doc_id are one document in links and keep their rows; ties go to the smallest doc_id; very long texts
are shingled whole; an empty table gives no rows; other columns are not read, so names can't clash.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, _arrow_schema, by_ids, forget, map_arrow, map_batches, release, shuffle_partitions, slices, written
from .near_dup_exact import wanted_pairs

SHINGLE, SHARE = 2, 80  # words a shingle; hundredths of the union that a link needs in common
COORDS, MATCHES, BAND = 64, 38, 4
PREFIX = COORDS - MATCHES + 1
CELLS = 1 << 18  # counters of coordinate-value pairs: a table of fixed size
LIST = 1500
SKETCH, SLACK = 256, 4.3  # least hashes of a set for a closer look; standard deviations below the share that pass
BLOCK = 500  # classes of a component that a task holds at once
WORDS = 200_000
HUB_EDGES = 1_000_000  # links from which hubs are looked for: with fewer no node's links fill a task
SET_SCHEMA = "doc_id long, n_shingles long, digest binary, sig binary"


def shingles(text: str | None, width: int = SHINGLE) -> set:
    """The set that defines similarity, of word tuples."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else set(zip(*(words[i:] for i in range(width)), strict=False))


def linked(a: set, b: set, share: int = SHARE) -> bool:
    if not a or not b:
        return False
    both = len(a & b)
    return 100 * both >= share * (len(a) + len(b) - both)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hashed_set(text: str | None, hashes: _Hashes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(width, len(h))):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240601)
    return rng.integers(1, 1 << 63, COORDS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, COORDS, dtype=np.uint64)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(COORDS, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(s), 4096):
        out = np.minimum(out, ((s[i : i + 4096] * a[:, None] + b[:, None]) >> np.uint64(32)).min(1))
    return out.astype(np.uint32)


def document_sets(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, digest of the set and signature of every row."""

    def make():
        hashes = _Hashes()
        a, b = multipliers()

        def work(x: dict) -> dict:
            sets = [hashed_set(t, hashes, width) for t in x["text"]]
            return {
                "doc_id": x["doc_id"],
                "n_shingles": [len(s) for s in sets],
                "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                "sig": [signature(s, a, b).tobytes() if len(s) else b"" for s in sets],
            }

        return work

    return map_batches(docs.select("doc_id", "text"), make, SET_SCHEMA)


def _stars(classes: DataFrame) -> DataFrame:
    """Candidate links (a, b), a < b, to the least class under every band of equal coordinates."""

    def make():
        def work(x: dict) -> dict:
            ids, keys = [], []
            for i, s in zip(x["rep"], x["sig"], strict=True):
                for k in range(0, COORDS, BAND):
                    ids.append(i)
                    keys.append(xxhash.xxh3_64_intdigest(s[4 * k : 4 * (k + BAND)], seed=k) - (1 << 63))
            return {"rep": ids, "key": keys}

        return work

    posts = map_batches(classes.select("rep", "sig"), make, "rep long, key long")
    least = posts.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("key", "a")
    return posts.join(least, "key").where("rep > a").select("a", F.col("rep").alias("b")).distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, share: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; texts of classes in pairs are read only."""
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "candidate-ids")
    texts = by_ids(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), ids, "left_semi")
    ta = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def make():
        last: dict = {"id": None, "set": None}

        def work(x: dict) -> dict:
            out: dict[str, list] = {"a": [], "b": []}
            for a, b, s, t in zip(x["a"], x["b"], x["ta"], x["tb"], strict=True):
                if (a, s) != last["id"]:
                    last["id"], last["set"] = (a, s), shingles(s, width)
                if linked(last["set"], shingles(t, width), share):
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return work

    # b first: after the join on a, rows of one a follow each other and its set is made once
    return map_batches(pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb"), make, "a long, b long").distinct()


def _least_beside(edges: DataFrame, n: int) -> DataFrame:
    """``edges`` (u, v) with ``m``, the least v of each u.

    With many edges the nodes of more than a hundred-thousandth of them, which are 100,000 at most, get theirs by a broadcast: no
    task holds all edges of a hub.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    if n < HUB_EDGES:
        return edges.join(low.select("u", "m"), "u")
    hub = n // 100_000
    marked = edges.join(F.broadcast(low.where(F.col("degree") > hub).select("u", F.col("m").alias("hub_m"))), "u", "left")
    plain = marked.where("hub_m IS NULL").select("u", "v").join(low.where(F.col("degree") <= hub).select("u", "m"), "u")
    return plain.select("u", "v", "m").union(marked.where("hub_m IS NOT NULL").select("u", "v", F.col("hub_m").alias("m")))


def components(links: DataFrame) -> DataFrame:
    """node and comp (its least reachable node) for every node of ``links`` (a, b); rounds of large and small stars."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    n = edges.count()
    if not n:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        large = _least_beside(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        joined = _least_beside(large, n)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, edges = edges, written(small, "edges")
        forget(last)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        before, n = state, state[0]


def _cell_counts(classes: DataFrame) -> np.ndarray:
    """How often the coordinate-value pairs of each of CELLS cells occur: CELLS numbers, whatever the input."""

    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                np.add.at(total, cells(np.frombuffer(s, np.uint32)), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["cell", "n"])

    rows = map_arrow(classes.select("sig"), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS, np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def pairs_of(sig: np.ndarray) -> np.ndarray:
    """A 64-bit name of each coordinate-value pair."""
    x = (sig.astype(np.uint64) << np.uint64(8) | np.arange(COORDS, dtype=np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def cells(sig: np.ndarray) -> np.ndarray:
    return (pairs_of(sig) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)


def rarest(sig: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The PREFIX coordinates of a signature whose pairs are rarest; equal counts go by name."""
    return np.lexsort((pairs_of(sig), counts[cells(sig)]))[:PREFIX]


def _postings(classes: DataFrame, shared) -> DataFrame:
    """Each class under its PREFIX rarest coordinate-value pairs; its coordinates join the lists that are counted."""

    def make():
        def work(x: dict) -> dict:
            out: dict[str, list] = {k: [] for k in ("pair", "rep", "comp", "coord")}
            for rep, comp, s in zip(x["rep"], x["comp"], x["sig"], strict=True):
                sig = np.frombuffer(s, np.uint32)
                first = rarest(sig, shared.value)
                out["pair"] += pairs_of(sig)[first].view(np.int64).tolist()
                out["rep"] += [rep] * PREFIX
                out["comp"] += [comp] * PREFIX
                out["coord"] += first.tolist()
            return out

        return work

    return map_batches(classes.select("rep", "comp", "sig"), make, "pair long, rep long, comp long, coord int")


def _coordinates(classes: DataFrame, shared) -> DataFrame:
    """What counting needs of a class, once: its coordinates by 16 bits, and which are posted."""

    def make():
        def work(x: dict) -> dict:
            sigs = [np.frombuffer(s, np.uint32) for s in x["sig"]]
            posted = [np.bitwise_or.reduce(np.uint64(1) << rarest(s, shared.value).astype(np.uint64)) for s in sigs]
            return {"rep": x["rep"], "members": x["members"], "n": x["n_shingles"], "bytes": [s.astype(np.uint16).tobytes() for s in sigs], "mask": [int(m.view(np.int64)) for m in posted]}

        return work

    return map_batches(classes.select("rep", "members", "n_shingles", "sig"), make, "rep long, members long, n long, bytes binary, mask long")


def _agreeing(left: tuple, right: tuple, same: bool, coord: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two blocks (comp, n, coordinates, posted) that may be linked and agree first at ``coord``."""
    if same and len(left[0]) <= 64:
        i, j = np.triu_indices(len(left[0]), 1)
        ok = left[0][i] != left[0][j]
        i, j = i[ok], j[ok]
    else:
        ok = left[0][:, None] != right[0][None, :]
        if same:
            ok &= np.tri(len(left[0]), k=-1, dtype=bool).T
        i, j = np.nonzero(ok)
    n, m = left[1][i], right[1][j]
    ok = (100 * n >= share * m) & (100 * m >= share * n)
    i, j = i[ok], j[ok]
    found = [np.empty((2, 0), np.int64)]
    for a in range(0, len(i), 1 << 15):
        p, q = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
        equal = left[2][p] == right[2][q]
        ok = equal.sum(1) >= MATCHES
        p, q, equal = p[ok], q[ok], equal[ok]
        ok = np.argmax(equal & left[3][p] & right[3][q], axis=1) == coord
        found.append(np.stack([p[ok], q[ok]]))
    both = np.concatenate(found, axis=1)
    return both[0], both[1]


def _joined(known: DataFrame, share: int) -> DataFrame:
    """x (a class) and comp (a component not smaller than its own) that may be linked, from lists of several components."""
    shared = known.sparkSession.sparkContext.broadcast(_cell_counts(known))
    posts = _postings(known, shared)
    mixed = posts.groupBy("pair").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("pair", "size")
    live = posts.join(mixed, "pair").join(_coordinates(known, shared), "rep")
    blocks = F.ceil(F.col("size") / LIST).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    live = live.select("*", blocks.alias("blocks"), own.alias("own"))
    # block i meets every block j: rows of i go to the tasks (min, max) for all j
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rest = ["own", "rep", "comp", "members", "n", "mask", "coord", "bytes"]
    tasks = live.select("pair", *rest, other).select("pair", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *rest)
    dealt = tasks.repartition(shuffle_partitions(posts.sparkSession), "pair", "i", "j").sortWithinPartitions("pair", "i", "j", "own", "rep")
    schema = _arrow_schema("x long, comp long")

    def run(batches):
        def meet(cols: list[np.ndarray]) -> np.ndarray:
            """cols: own, rep, comp, members, n, mask, coord, coordinates of one task."""
            own, rep, comp, members, n, mask, coord, sig = cols
            posted = (mask[:, None] >> np.arange(COORDS)) & 1 == 1
            k = 0 if own[0] == own[-1] else int(np.searchsorted(own, own[-1]))
            left, right = (slice(0, k), slice(k, None)) if k else (slice(None), slice(None))
            i, j = _agreeing((comp[left], n[left], sig[left], posted[left]), (comp[right], n[right], sig[right], posted[right]), not k, int(coord[0]), share)
            j = j + k
            swap = (members[i] > members[j]) | (members[i] == members[j]) & (comp[i] < comp[j])
            return np.stack([rep[np.where(swap, j, i)], comp[np.where(swap, i, j)]], 1)

        def emit(found):
            rows = np.unique(np.concatenate([np.empty((0, 2), np.int64), *found]), axis=0)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], schema=schema)

        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(10)]
            cols.append(np.frombuffer(b"".join(batch.column(10).to_pylist()), np.uint16).reshape(-1, COORDS))
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            key = np.stack(cols[:3], 1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()]
            found = []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if e - s > 1 and (cols[5][s] != cols[5][s:e]).any():
                    found.append(meet([c[s:e] for c in cols[3:]]))
            held = [c[edges[-1] :] for c in cols]
            yield from emit(found)
        if held is not None and len(held[0]) > 1:
            yield from emit([meet(held[3:])])
        release()

    return map_arrow(dealt.select("pair", "i", "j", *rest), run, "x long, comp long").distinct()


def sketch_of(s: np.ndarray) -> bytes:
    """The SKETCH least hashes of a set, by 32 bits."""
    return (s[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes()


def may_link(a: bytes, b: bytes, share: int = SHARE) -> bool:
    """Whether the share of common hashes among the SKETCH least of the union leaves a link possible."""
    x, y = np.unique(np.frombuffer(a, np.uint32)), np.unique(np.frombuffer(b, np.uint32))
    union = np.union1d(x, y)[:SKETCH]
    both = np.intersect1d(np.intersect1d(x, y, True), union, True)
    return len(both) >= len(union) * share / 100 - SLACK * (len(union) * share / 100 * (1 - share / 100)) ** 0.5


def _sketched(wanted: DataFrame, known: DataFrame, docs: DataFrame, width: int, share: int) -> DataFrame:
    """``wanted`` without the pairs of classes that their sketches rule out; components of several classes stay."""
    wide = wanted.join(known.where("rep = comp AND members > 1").select("comp"), "comp", "left_semi").select("x", "comp")
    pairs = written(wanted.join(known.where("rep = comp AND members = 1").select("comp"), "comp", "left_semi").select("x", "comp"), "single")
    ids = written(pairs.select(F.col("x").alias("doc_id")).union(pairs.select("comp")).distinct(), "candidate-ids")

    def sketch():
        hashes = _Hashes()
        return lambda x: {"rep": x["doc_id"], "sketch": [sketch_of(hashed_set(t, hashes, width)) for t in x["text"]]}

    texts = by_ids(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), ids, "left_semi")
    sketches = written(map_batches(texts, sketch, "rep long, sketch binary"), "sketches")
    left, right = sketches.select(F.col("rep").alias("x"), F.col("sketch").alias("l")), sketches.select(F.col("rep").alias("comp"), F.col("sketch").alias("r"))

    def make():
        def work(x: dict) -> dict:
            ok = [i for i, (a, b) in enumerate(zip(x["l"], x["r"], strict=True)) if may_link(a, b, share)]
            return {k: [x[k][i] for i in ok] for k in ("x", "comp")}

        return work

    return wide.union(map_batches(pairs.join(left, "x").join(right, "comp").select("x", "comp", "l", "r"), make, "x long, comp long").distinct())


def _confirmed_against(wanted: DataFrame, known: DataFrame, docs: DataFrame, width: int, share: int, least: int = MATCHES) -> DataFrame:
    """A link (a, b) for every x and comp of ``wanted`` that have one; classes that agree on fewer than ``least`` coordinates aren't held against each other."""
    n = wanted.groupBy("comp").agg(F.count(F.lit(1)).alias("n_x"))
    sizes = written(n.join(known.where("rep = comp").select("comp", "members"), "comp").select("comp", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n_x") / (4 * BLOCK)).cast("int").alias("parts")), "sizes")
    doc = known.select("rep", F.col("n_shingles").alias("n"), "sig")
    m, p = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    inside = known.select("rep", "comp").join(sizes, "comp").select("comp", m.alias("m"), upto("parts").alias("p"), F.lit(0).alias("side"), "rep")
    outside = wanted.withColumnRenamed("x", "rep").join(sizes, "comp").select("comp", upto("blocks").alias("m"), p.alias("p"), F.lit(1).alias("side"), "rep")
    rows = written(inside.union(outside), "tasks")
    texts = by_ids(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), written(rows.select(F.col("rep").alias("doc_id")).distinct(), "candidate-ids"), "left_semi")
    full = rows.join(doc, "rep").join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    dealt = full.repartition(shuffle_partitions(docs.sparkSession), "comp", "m", "p").sortWithinPartitions("comp", "m", "p", "side", "rep")
    schema = _arrow_schema("a long, b long")

    def run(batches):
        key, ids, counts, sigs, sets = None, [], [], [], []
        table: tuple | None = None
        for batch in (s for whole in batches for s in slices(whole)):
            found: list[tuple[int, int]] = []
            for comp, m, p, side, rep, n, sig, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (comp, m, p) != key:
                    key, ids, counts, sigs, sets, table = (comp, m, p), [], [], [], [], None
                own = np.frombuffer(sig, np.uint32)
                if side == 0:
                    ids.append(rep)
                    counts.append(n)
                    sigs.append(own)
                    sets.append(text)
                    continue
                if not ids:
                    continue
                table = table or (np.array(counts), np.stack(sigs))
                same = (table[1] == own).sum(1)
                fits = np.flatnonzero((same >= least) & (100 * table[0] >= share * n) & (100 * n >= share * table[0]))
                words = shingles(text, width) if len(fits) else set()
                for k in fits[np.argsort(-same[fits], kind="stable")].tolist():
                    if not isinstance(sets[k], set):
                        sets[k] = shingles(sets[k], width)
                    if linked(words, sets[k], share):
                        found.append((rep, ids[k]))
                        break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=schema)
        release()

    return map_arrow(dealt.select("comp", "m", "p", "side", "rep", "n", "sig", "text"), run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, share: int = SHARE, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    With ``exact`` candidates come from whole shingle sets (``near_dup_exact``) in place of signatures and sketches: no link is
    missed, at the cost of posting a fifth of all shingles.
    """
    sets = written(document_sets(docs, width), "sets")
    some = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = written(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig"), F.min("n_shingles").alias("n_shingles")), "classes")
    links = written(_confirmed(written(_stars(classes), "stars"), docs, width, share), "links")
    first = components(links)
    sizes = first.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
    first = written(first.join(sizes, "comp").withColumnRenamed("node", "rep"), "members")
    if first.count() <= BROADCAST_ROWS // 4:  # three numbers a row
        first = F.broadcast(first)
    known = classes.join(first, "rep", "left").select("rep", F.coalesce("comp", "rep").alias("comp"), F.coalesce("members", F.lit(1)).alias("members"), "n_shingles", "sig")
    known = written(known, "first-components")
    if exact:
        wanted = written(wanted_pairs(known, docs, lambda: partial(hashed_set, hashes=_Hashes(), width=width), share), "joined")
    else:
        wanted = written(_sketched(written(_joined(known, share), "joined"), known, docs, width, share), "sketched")
    more = _confirmed_against(wanted, known, docs, width, share, 0 if exact else MATCHES)
    final = components(links.union(written(more, "links")))
    label = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("comp", "rep").alias("comp"))
    ids = sets.select("doc_id", "n_shingles", "digest")  # texts without shingles share one digest, and need no label
    ids = ids.where("n_shingles > 0").join(label, "digest", "left").select("doc_id", "n_shingles", "comp").union(ids.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long")))
    comp = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("comp")).otherwise(F.col("doc_id"))
    return ids.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, width: int = 5, share: int = SHARE) -> DataFrame:
    """``docs`` without the documents that near_duplicates() doesn't keep."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    gone = written(near_duplicates(docs, width, share).where("NOT kept").select("doc_id").distinct(), "not-kept")
    return by_ids(docs.select(*cols), gone, "left_anti")

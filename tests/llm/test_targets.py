"""Resampling, hard negatives and decontamination against plain versions, on drawn tables with every edge."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from test_edges import TEXTS, table

from talkweft.llm import decontaminate, hard_negatives, target_resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string, words int")


def drawn(spark, rng, n=60):
    """Texts over few words, with É beside é, copies, nulls, ids that repeat and a very long text."""
    vocabulary = ["the", "The", "É", "é", "İx", "straße", "a", "b2", "漢字", "zz"]
    rows = [(i % (n - 2), None if i % 17 == 0 else "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "_"]) for _ in range(rng.choice([0, 1, 2, 9, 10, 11, 19, 20, 21, 60])))) for i in range(n)]
    rows += [(None, "the a b2 " * 9), (None, None), (900, " ".join(rng.choice(vocabulary) for _ in range(300_000))), rows[5], rows[5]]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_resample_equals_plain(spark):
    docs, rows = drawn(spark, random.Random(3))
    target = [(1, "the É a the b2"), (2, None), (3, "unseen words"), (None, "a a a")]
    grams = lambda t: (w := words(t)) + [f"{a} {b}" for a, b in zip(w, w[1:])]
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = Counter(bucket(g) for _, x in rows for g in grams(x)), Counter(bucket(g) for _, x in target for g in grams(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000.0) / ((s[b] + 1) * (all_t + 10000.0)))) for b in s}
    want, enter = [], []
    for i, x in rows:
        g = [gain[bucket(f)] for f in grams(x)]
        weight = sum(g) // len(g) if g else 0
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296)))
        want.append((i, len(g), weight, score))
        if score is not None and len(words(x)) >= 20:
            enter.append((-score, i))
    got = target_resample.importance_resample(docs, items(spark, [(i, x, "c", 1) for i, x in target])).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(want)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 25 * len(enter) // 100 + 1))
    assert [(-r.score, r.doc_id) for r in ranked] == sorted(enter)[: len(ranked)]


def test_resample_edges(spark):
    bench = items(spark, [(1, "lorem ipsum", "x", 1)])
    got = target_resample.importance_resample(table(spark), bench).collect()
    assert len(got) == len(TEXTS) + 1 and len({(r.n_features, r.weight, r.score) for r in got if r.doc_id == 6}) == 1
    by = {r.doc_id: r for r in got}
    assert by[0].weight == by[1].weight == by[2].n_features == 0 and by[None].score is None and by[10].n_features > 10_000
    assert target_resample.importance_resample(table(spark, True), bench).collect() == []
    assert target_resample.importance_resample(table(spark), bench.where("false")).count() == len(got)
    assert {r.doc_id for r in target_resample.draw(table(spark), bench, share=100).collect()} == {r.doc_id for r in got if r.doc_id is not None and r.n_features >= 39}


def plain_negatives(rows):
    def vector(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]

    clean = [(i, (m + 1) % 10 if i % 7 == 0 else m, q) for i, v, m in rows if i is not None and m is not None and (q := vector(v)) is not None]
    out = []
    for i, m, q in clean:
        if i % 100:
            continue
        scored = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, o)))), j, k) for j, k, o in clean if len(o) == len(q)]
        for p, j in sorted(((s, j) for s, j, k in scored if k == m and j != i), key=lambda x: (-x[0], x[1]))[:5]:
            found = sorted(((s, o) for s, o, k in scored if k != m and 80 * p <= 100 * s <= 100 * p), key=lambda x: (-x[0], x[1]))[:5]
            out += [(i, j, n, o, p, s) for n, (s, o) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("at_once", [hard_negatives.ANCHORS, 3])
def test_negatives_equal_plain(spark, at_once):
    rng = random.Random(5)
    rows = [(i * 25, [rng.choice([-0.5, 0.25, 0.3, 1.0]) for _ in range(3)], rng.randrange(3)) for i in range(200)]
    rows += [(7000 + i, [0.3, 0.3, 0.3], i % 2) for i in range(40)] + [(7000, [0.3, 0.3, 0.3], 0), (8000, [], 1), (8001, [], 2), (8002, [], 1), (8100, [1.0, 2.0], 4), (8101, [1.0, 1.5], 4), (8102, [1.0, 1.4], 5)]
    rows += [(9000, None, 1), (9100, [None, 1.0, 1.0], 1), (9200, [float("nan"), 1.0, 1.0], 1), (9300, [float("inf"), 1.0, 1.0], 1), (9400, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(10_000, [1e6, 2e6, 3e6], 7), (10_001, [1e6, 2e6, 3e6], 7), (10_002, [1e6, 2e6, 2.9999e6], 8), (10_003, [3e38, 3e38, 3e38], 8)]
    vectors = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, anchor string")
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    label = hard_negatives.F.when(hard_negatives.F.col("vec_id") % 7 == 0, (hard_negatives.F.col("label") + 1) % 10).otherwise(hard_negatives.F.col("label"))
    got = hard_negatives.hard_negatives(vectors, label=label, at_once=at_once)
    want = plain_negatives(rows)
    assert sorted(tuple(r) for r in got.collect()) == want and len({w[0] for w in want}) > 20
    assert any(w[0] == 10_000 for w in want) and any(w[0] == 8000 for w in want)
    assert hard_negatives.hard_negatives(vectors.where("false")).collect() == []


def plain_contamination(rows, bench, size=10):
    windows = {}
    for item, x in bench:
        w = words(x)
        for k in range(len(w) - min(size, len(w)) + 1) if w else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    out = []
    for i, x in rows:
        w, hit, found = words(x), set(), set()
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[g] - {None}
        out.append((i, len(w), len(hit), tuple(sorted(map(str, found)))))
    return Counter(out)


@pytest.mark.parametrize("at_once", [decontaminate.WINDOWS, 7])
def test_contamination_equals_plain(spark, at_once):
    rng = random.Random(9)
    docs, rows = drawn(spark, rng)
    cut = lambda n: " ".join(words(rows[62][1])[(k := rng.randrange(290_000)) : k + n])
    bench = [(1, cut(14)), (2, cut(10).upper()), (11, cut(30)), (3, "the a"), (4, "é é é"), (5, None), (6, " .. "), (None, cut(12)), (7, "never seen " * 9), (8, "b2 " * 12), (1, cut(11)), (2, "zz")]
    got = decontaminate.contamination(docs, items(spark, [(i, x, "c", 1) for i, x in bench]), at_once=at_once).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == plain_contamination(rows, bench)
    assert sum(r.n_hit > 0 for r in got) > 20 and any(r.n_hit == 0 for r in got)


def test_contamination_edges(spark):
    bench = items(spark, [(1, " ".join(TEXTS[5].split()[3:13]), "x", 1), (2, "漢😀", "x", 1)])
    got = decontaminate.contamination(table(spark), bench).collect()
    assert len(got) == len(TEXTS) + 1
    by = {r.doc_id: r for r in got}
    assert [by[i].n_hit for i in (0, 1, 2, 3, 5, 6, 9)] == [0, 0, 0, 0, 10, 10, 0] and by[10].n_hit == 15_000 and by[5]["items"] == ["1"] and by[8]["items"] == []
    assert decontaminate.contamination(table(spark, True), bench).collect() == []
    assert not any(r.n_hit for r in decontaminate.contamination(table(spark), bench.where("false")).collect())
    assert {r.doc_id for r in decontaminate.keep_clean(table(spark), bench).collect()} == {r.doc_id for r in got if r.doc_id is None or not r.n_hit}

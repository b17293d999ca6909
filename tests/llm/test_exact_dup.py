"""Exact near duplicates against all pairs, on the small table and on sets at the border of the share."""

import random

import pytest
from test_oracles import DATA, against_sql, rows_of

from talkweft.llm import near_dup, near_dup_exact, queries


def plain(texts, width, share):
    sets = [near_dup.shingles(t, width) for t in texts]
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if near_dup.linked(sets[i], sets[j], share):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return [root(i) for i in range(len(texts))]


def test_equals_sql(spark):
    want = against_sql(spark, DATA, "op9_near_dup")[1]
    got = near_dup.near_duplicates(spark.read.parquet(f"{DATA}/documents.parquet"), exact=True)
    assert rows_of(got.columns, got.collect()) == want


@pytest.mark.parametrize("block", [near_dup_exact.LIST, 4])
def test_borders_and_long_lists(spark, monkeypatch, block):
    """Sets a word or two around the share, families that meet in one word, copies, and texts of a few words; lists cut into blocks."""
    monkeypatch.setattr(near_dup_exact, "LIST", block)
    rng = random.Random(6)
    texts = [None, "", "one", "one", "a b"]
    for f in range(12):
        base = [f"w{f}x{i}" for i in range(60)]
        for _ in range(6):
            own = list(base)
            for at in rng.sample(range(60), rng.choice([3, 5, 6, 7])):
                own[at] = f"z{rng.randrange(10**9)}"
            texts.append("hot words " + " ".join(own))
        texts.append(texts[-1].upper())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, exact=True).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, near_dup.SHINGLE, near_dup.SHARE)
    assert len(set(got.values())) > 20 and "op9_near_dup" in queries.queries()


def test_prefix_and_bounds_lose_nothing():
    """Every pair of drawn sets that is similar enough shares a posted shingle that passes both bounds."""
    rng = random.Random(1)
    import numpy as np

    for _ in range(3000):
        share = rng.choice([50, 80, 93, 100])
        n = rng.randrange(1, 30)
        a = set(rng.sample(range(40), n))
        b = set(a)
        for _ in range(rng.randrange(6)):
            b.discard(rng.randrange(40))
            b.add(rng.randrange(40))
        b = b or {1}
        if 100 * len(a & b) >= share * len(a | b):
            x, y = sorted(a), sorted(b)
            p, q = x[: near_dup_exact.prefix_size(len(x), share)], y[: near_dup_exact.prefix_size(len(y), share)]
            one = lambda v: np.array([v])
            assert any(near_dup_exact.fits(one(len(x)), one(p.index(s)), one(len(y)), one(q.index(s)), share)[0] for s in set(p) & set(q))


def test_hubs_of_links(spark, monkeypatch):
    """Components with and without the hubs' broadcast: a hub of 3,000 links, chains, and single pairs."""
    links = [(5, 100 + i) for i in range(3000)] + [(10_000 + i, 10_001 + i) for i in range(60)] + [(20_000 + 2 * i, 20_001 + 2 * i) for i in range(50)] + [(3, 3000), (7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    want = {5: 3, 3: 3} | {100 + i: 3 for i in range(3000)} | {10_000 + i: 10_000 for i in range(61)} | {20_000 + 2 * i + k: 20_000 + 2 * i for i in range(50) for k in (0, 1)}
    for least in (near_dup.HUB_EDGES, 0):
        monkeypatch.setattr(near_dup, "HUB_EDGES", least)
        got = {r.node: r.comp for r in near_dup.components(df).collect()}
        assert got == want

"""Corpus queries against their SQL, and whole query outputs against plain versions, on the small tables."""

import hashlib
import zlib

import duckdb
import pytest

from talkweft.llm import best_fit, flac_media, queries

DATA = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def against_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", *(("benchmark", "embeddings") if folder == DATA else ())):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if folder != DATA else ''}')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    return rows_of(got.columns, got.collect()), rows_of(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    got, want = against_sql(spark, DATA, name)
    assert len(got) > 0 and got == want


def test_urls_equal_sql_where_templates_decide(spark, tmp_path):
    """Labelled branches that merge, that differ, that are many, and that go deeper than the tree."""
    pages = [(i, f"https://a.{'org' if i % 2 else 'com'}/{'spam' if i % 4 < 2 else 'news'}/{'abcdefg'[i % 7]}/x/y/z/{i}", None) for i in range(700)]
    pages += [(1000 + i, f"http://B.org/{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}/p", None) for i in range(100)] + [(2000, None, "x"), (2001, "mailto:x", "x"), (2002, "http://a.org/spam/q/unseen", "x")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, 0 if i % 4 < 2 else 1, 0) for i in range(700)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = against_sql(spark, str(tmp_path), "op8_urls")
    assert got == want and {r[-1] for r in got} == {"allow", "block"}
    by = {r[1]: r for r in got}
    assert by[0][-1] == "block" and by[2][-1] == "allow" and by[2002][-1] == "block" and by[1001][5] == "/*/p"


def test_archive_equals_sql_with_copies(spark, tmp_path):
    rows = [(i, f"http://h/{i}", ["", "same", None, "é" * 99, f"own {i}"][i % 5]) for i in range(200)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for t in ("labels", "documents"):
        spark.createDataFrame([(0, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/{t}.parquet")
    got, want = against_sql(spark, str(tmp_path), "op6_warc")
    assert got == want and sum(r[-2] == "revisit" for r in got) > 100


def test_flac_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op3_flac(spark, DATA).collect()}
    for i, t in texts.items():
        data = t.encode()
        padded = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    stream = flac_media.encode_many([flac_media.payload_of(texts[max(texts)])[1]], (flac_media.crc8_table(), flac_media.crc16_table()))[0]
    assert (got[max(texts)].media_bytes, got[max(texts)].media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())


def test_held_out_is_crc(spark):
    got = queries.op7_line_crf(spark, DATA).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_packing_query(spark):
    """Every token of every document is placed once, bins don't overlap, and lengths are the least that fit."""
    from tokenizers import Tokenizer

    from talkweft.llm.tokens import default_vocabulary

    t = Tokenizer.from_file(default_vocabulary())
    want = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op1_best_fit(spark, DATA).collect()
    for i, n in want.items():
        own = sorted((r.piece_start, r.n_tokens) for r in rows if r.doc_id == i)
        assert [a for a, _ in own] == list(range(0, n, max(best_fit.LENGTHS))) and sum(k for _, k in own) == n
    bins: dict = {}
    for r in rows:
        bins.setdefault((r.shard, r.bin, r.bin_length), []).append((r.bin_offset, r.n_tokens))
    for (_, _, length), held in bins.items():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert length == min(x for x in best_fit.LENGTHS if x >= at)

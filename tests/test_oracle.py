"""Every registered query of the conversation engine against its SQL on the small tables."""

import math

import duckdb
import pytest

from talkweft.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got = catalog.queries()[name](spark, DATA)
    want = db.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    left, right = rows_of(got.columns, got.collect()), rows_of(columns, want.fetchall())
    assert len(left) == len(right) > 0 or name in ("held_out_rows",)
    assert left == right


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_top_candidates_of_whole_vectors(spark, db):
    """The three largest of all 64 entries, in plain Python."""
    vectors = dict(db.execute("SELECT vec_id, embedding FROM embeddings").fetchall())
    want = {i: ",".join(map(str, sorted(range(len(v)), key=lambda k: (-v[k], k))[:3])) for i, v in vectors.items()}
    assert {len(v) for v in vectors.values()} == {64}
    assert {r.vec_id: r.best for r in catalog.queries()["top_candidates_whole"](spark, DATA).collect()} == want

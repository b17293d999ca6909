"""Case folding and white space against Python's on every code point."""

import sys

from pyspark.sql import functions as F

from talkweft.functions import text as T


def test_all_code_points(spark):
    points = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    rows = [("".join(points[i : i + 64]),) for i in range(0, len(points), 64)] + [(c,) for c in points if c != c.casefold()]
    df = spark.createDataFrame(rows, "t string").repartition(4)
    wrong = [r.t for r in df.select("t", T.casefold(F.col("t")).alias("f")).collect() if r.f != r.t.casefold()]
    assert wrong == []


def test_normalized_like_plain(spark):
    texts = ["", None, "  Straße  STRASSE ", "ΣΊΣΥΦΟΣ ﬁ İİ", "\x1c a\x85b　", "Weiß\tWEISS"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.norm_spaces(F.col("t")).alias("n")).collect()]
    assert got == [None if t is None else " ".join(t.casefold().split()) for t in texts]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.strip(F.col("t")).alias("n")).collect()]
    assert got == [None if t is None else t.strip() for t in texts]

"""Selected order statistics against sorted values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweft.operators import measures as A
from talkweft.operators import quantiles as Q


def test_five_million_values(spark):
    """More values than are ever fetched: equal to sorting them all."""
    n = 5_000_000
    df = spark.range(n).select((F.pow(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / (1 << 40), F.lit(9.0)) * F.when(F.col("id") % 3 == 0, 1e-200).otherwise(1e9)).alias("g"))
    values = np.sort(df.toPandas()["g"].to_numpy())
    ranks = [0, 1, n // 3, n // 2, int(0.99 * n), int(0.999 * n), n - 1]
    assert Q.order_statistics(df, "g", ranks, few=1000) == {r: values[r] for r in ranks}


@pytest.mark.parametrize("kind", ["ties", "two", "one", "mixed"])
def test_hard_distributions(spark, kind):
    rng = random.Random(8)
    draw = {"ties": lambda: rng.choice([0.0, 0.0, 1.0, -1.0, 2.5]), "two": lambda: rng.choice([3.0, 4.0]), "one": lambda: 7.0, "mixed": lambda: rng.choice([rng.gauss(0, 1), -1e300, 1e300, math.inf, -math.inf, math.nan, 5e-324])}[kind]
    values = [draw() for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "g double")
    order = sorted(values, key=lambda v: (math.isnan(v), v if not math.isnan(v) else 0))
    got = Q.order_statistics(df, "g", list(range(0, 3000, 97)) + [2999], few=3, accuracy=50)
    for r, v in got.items():
        assert v == order[r] or (math.isnan(v) and math.isnan(order[r]))


def test_interpolates_and_refuses(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 8)], "g double")
    assert Q.quantiles(df, "g", [0.0, 0.5, 0.9, 1.0], 4) == [1.0, 3.0, pytest.approx(np.quantile([1, 2, 4, 8], 0.9)), 8.0]
    assert Q.quantiles(df.where("false"), "g", [0.5], 0) == [None]
    with pytest.raises(ValueError):
        Q.order_statistics(df, "g", [4])


def test_parity_beyond_what_is_fetched(spark):
    rng = np.random.default_rng(2)
    left, right = rng.normal(size=(400, 50)), rng.normal(size=(400, 50))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(left, right, strict=True))], "i int, l array<double>, r array<double>")
    gap = np.abs(left - right)
    for few in (10, 1_000_000):
        r = A.parity(df, "l", "r", few).first()
        assert (r.prompt_count, r.compared, r.finite) == (400, 20_000, 20_000)
        assert (r.max_diff, r.mean_diff, r.p99_diff, r.p999_diff) == pytest.approx((gap.max(), gap.mean(), np.quantile(gap, 0.99), np.quantile(gap, 0.999)), rel=1e-12)
        assert r.argmax_agreement == pytest.approx((left.argmax(1) == right.argmax(1)).mean())
    empty = A.parity(df.where("false"), "l", "r").first()
    assert empty.prompt_count == 0 and empty.p99_diff is None

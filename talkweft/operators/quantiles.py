"""Exact order statistics of values in any number, by selection: no sort, no sample, nothing collected beyond FEW values.

Each round asks an approximate sketch for two values around the wanted rank, counts exactly how many values lie before and
at them, and goes on between them. The sketch is off by at most one in ACCURACY of what is left, so a round leaves a few
ten-thousandths of it; whatever the sketch says, only exact counts decide, and every round leaves out the two values
themselves, so ties and odd distributions only cost rounds. NaN comes after all other values; nulls don't count.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEW = 20_000  # values that are fetched at the end, at most
ACCURACY = 10_000


@dataclass
class _Range:
    """Values strictly between low and high (null: open) hold rank ``rank``; ``below`` values come before them, ``size`` are there."""

    rank: int
    below: int
    size: int
    low: float | None = None
    high: float | None = None
    found: float | None = None

    def holds(self, x: Column) -> Column:
        inside = F.lit(True)
        if self.low is not None:
            inside = inside & (x > self.low)
        if self.high is not None:
            inside = inside & (x < self.high)
        return inside

    def narrow(self, a: float, b: float, before_a: int, to_a: int, before_b: int, to_b: int) -> None:
        """By the numbers of all values before and up to a and b."""
        if self.rank < before_a:
            self.high, self.size = a, before_a - self.below
        elif self.rank < to_a:
            self.found = a
        elif self.rank < before_b:
            self.low, self.high, self.below, self.size = a, b, to_a, before_b - to_a
        elif self.rank < to_b:
            self.found = b
        else:
            self.low, self.size, self.below = b, self.below + self.size - to_b, to_b


def order_statistics(df: DataFrame, value: str, ranks: list[int], few: int = FEW, accuracy: int = ACCURACY) -> dict[int, float]:
    """The values of the given ranks (from 0) in ascending order. One scan to count, two a round for all ranks together, one at the end."""
    x = F.col(value)
    real = df.select(x.cast("double").alias(value)).where(x.isNotNull())
    n, n_nan = real.agg(F.count(F.lit(1)), F.count_if(F.isnan(x))).first()
    if any(not 0 <= r < n for r in ranks):
        raise ValueError(f"no such rank among {n} values")
    plain = real.where(~F.isnan(x))
    ranges = {r: _Range(r, 0, n - n_nan, found=math.nan if r >= n - n_nan else None) for r in ranks}
    while open_ := [g for g in ranges.values() if g.found is None and g.size > few]:
        around = lambda g: [max(0.0, min(1.0, (g.rank - g.below + d * g.size / accuracy) / g.size)) for d in (-1.5, 1.5)]
        pivots = plain.agg(*[F.percentile_approx(F.when(g.holds(x), x), around(g), accuracy) for g in open_]).first()
        ends = [sorted(p) for p in pivots]
        counts = plain.agg(*[F.count_if(c) for a, b in ends for c in (x < a, x <= a, x < b, x <= b)]).first()
        for i, g in enumerate(open_):
            g.narrow(*ends[i], *counts[4 * i : 4 * i + 4])
    rest = [g for g in ranges.values() if g.found is None]
    if rest:
        lists = plain.agg(*[F.array_sort(F.collect_list(F.when(g.holds(x), x))) for g in rest]).first()  # at most ``few`` each
        for g, values in zip(rest, lists, strict=True):
            g.found = values[g.rank - g.below]
    return {r: g.found for r, g in ranges.items()}


def quantiles(df: DataFrame, value: str, shares: list[float], n: int, few: int = FEW, accuracy: int = ACCURACY) -> list[float | None]:
    """Quantiles of ``n`` values, interpolated between neighbours; all null where there are none."""
    if not n:
        return [None] * len(shares)
    places = [(s * (n - 1), math.floor(s * (n - 1))) for s in shares]
    at = order_statistics(df, value, sorted({r for _, k in places for r in (k, min(k + 1, n - 1))}), few, accuracy)
    return [(k + 1 - place) * at[k] + (place - k) * at[min(k + 1, n - 1)] if place > k else at[k] for place, k in places]

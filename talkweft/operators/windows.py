"""Points in intervals: a join by cells of time, and the checks of where an artifact comes from that it serves.

Cells are cut at quantiles of the points, so that dense times have narrow cells. A point has one cell, an interval all those
that it touches; both meet by an equal join on the cell (and keys), which Spark shuffles, and which AQE splits where many
points share one instant. An interval is copied at most once a cell, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 256


def cell_bounds(points: DataFrame, at: str, cells: int = CELLS) -> list:
    """Up to ``cells`` - 1 ascending values that cut the points into cells of about equal size."""
    found = points.agg(F.percentile_approx(at, [i / cells for i in range(1, cells)], 100 * cells)).first()[0]
    return sorted(set(found or []))


def _cell(value: Column, bounds: list) -> Column:
    """How many bounds are at or below a value."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= value))


def interval_join(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, keys: tuple[str, ...] = (), how: str = "inner", cells: int = CELLS) -> DataFrame:
    """Each point with each interval (of the same keys) that holds it, both ends included; ``how`` is inner, left, left_semi or left_anti.

    ``start``, ``end`` and ``at`` are of one type. Null times meet nothing; intervals that end before they begin hold nothing.
    Other columns of both sides must differ in name.
    """
    bounds = cell_bounds(points, at, cells)
    left = points.withColumn("_cell", F.explode(F.array(_cell(F.col(at), bounds))))  # as a generated column the optimizer doesn't copy its expression to the other side
    spans = intervals.where(F.col(start) <= F.col(end)).withColumn("_cell", F.explode(F.sequence(_cell(F.col(start), bounds), _cell(F.col(end), bounds))))
    for k in (*keys, "_cell"):
        spans = spans.withColumnRenamed(k, f"_right_{k}")
    on = (F.col("_cell") == F.col("_right__cell")) & (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_right_{k}"))
    return left.join(spans, on, how).drop("_cell", "_right__cell", *[f"_right_{k}" for k in keys])


def mismatches(expected: dict[str, tuple[Column, Column]]) -> Column:
    """What differs between (found, requested) pairs, as a list of texts; nulls are named None."""
    shown = lambda c: F.coalesce(F.concat(F.lit("'"), c.cast("string"), F.lit("'")), F.lit("None"))
    return F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.concat(F.lit(f"{name}: metadata="), shown(a), F.lit(", requested="), shown(b))) for name, (a, b) in expected.items()]))


def outside_windows(artifacts: DataFrame, at: str, jobs: DataFrame, job: str, started: str, finished: str, slack: str = "1 second") -> DataFrame:
    """Artifacts whose time lies in no window of their job, ``slack`` after its end allowed; also those of jobs without a whole window."""
    windows = jobs.where(F.col(started).isNotNull() & F.col(finished).isNotNull()).select(job, F.col(started).alias("_from"), (F.col(finished) + F.expr(f"INTERVAL {slack}")).alias("_to"))
    return interval_join(artifacts, at, windows, "_from", "_to", (job,), "left_anti")

"""Counts, ratios, thresholds, routes and gates over tables of predictions.

Ratios of nothing follow the rule each caller names; sums are taken once, grids are read off histograms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    r = F.try_divide(num.cast("double"), den)
    return r if empty is None else F.coalesce(r, F.lit(empty))


def confusion(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    hit, real = F.col(score) >= threshold, F.col(label) == 1
    return df.agg(F.count_if(hit & real).alias("true_positive"), F.count_if(hit & ~real).alias("false_positive"), F.count_if(~hit & real).alias("false_negative"), F.count_if(~hit & ~real).alias("true_negative"))


def macro_f1(df: DataFrame, predicted: str, label: str, ignore: int = -100) -> DataFrame:
    """macro_f1_any counts every class seen in predictions or labels; macro_f1_supported those with labels only."""
    rows = df.where(F.col(label) != ignore)
    pairs = rows.groupBy(F.col(predicted).alias("p"), F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n"))  # classes x classes
    both = pairs.select(F.col("p").alias("c"), F.when(F.col("p") == F.col("l"), F.col("n")).otherwise(0).alias("tp"), F.when(F.col("p") != F.col("l"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn"))
    both = both.union(pairs.where("p <> l").select(F.col("l"), F.lit(0), F.lit(0), F.col("n")))
    each = both.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    supported = (F.col("tp") + F.col("fn")) > 0
    return each.agg(F.coalesce(F.avg(f1), F.lit(0.0)).alias("macro_f1_any"), F.coalesce(F.avg(F.when(supported, f1)), F.lit(0.0)).alias("macro_f1_supported"))


def multilabel_f1(df: DataFrame, names: list[str], threshold: float) -> DataFrame:
    """F1 of each label column pair p_<name>, l_<name>, in one pass."""
    cols = []
    for n in names:
        hit, real = F.col(f"p_{n}") >= threshold, F.col(f"l_{n}") == 1
        tp, wrong = F.count_if(hit & real), F.count_if(hit != real)
        cols.append(ratio(2 * tp, 2 * tp + wrong).alias(n))
    return df.agg(*cols).unpivot([], names, "label", "f1")


def cell(score: Column, steps: int) -> Column:
    """The number of thresholds i / steps (i from 1) that a score reaches, exact at the thresholds."""
    b = F.floor(score * steps)
    return F.when((b + 1) / F.lit(float(steps)) <= score, b + 1).when(b / F.lit(float(steps)) > score, b - 1).otherwise(b).cast("int")


def threshold_table(df: DataFrame, score: str, label: str, steps: int) -> DataFrame:
    """For each threshold i / steps: counts of both labels at or over it. One pass, then a window over steps rows."""
    spark = df.sparkSession
    hist = df.groupBy(cell(F.col(score), steps).alias("i")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    grid = spark.range(0, steps + 1).select(F.col("id").cast("int").alias("i"))
    filled = grid.join(hist, "i", "left").select("i", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg"))
    over = Window.orderBy(F.desc("i"))
    whole = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return filled.select("i", F.sum("pos").over(over).alias("tp"), F.sum("neg").over(over).alias("fp"), F.sum("pos").over(whole).alias("positive"), F.sum("neg").over(whole).alias("negative"))


def best_threshold(df: DataFrame, score: str, label: str, least_recall: float) -> DataFrame:
    """Of thresholds i / 200 that keep the recall (all, if none does): best specificity, balanced accuracy, threshold."""
    t = threshold_table(df, score, label, 200).where("i BETWEEN 1 AND 199")
    t = t.select((F.col("i") / F.lit(200.0)).alias("threshold"), ratio(F.col("tp"), F.col("positive")).alias("recall"), ratio(F.col("negative") - F.col("fp"), F.col("negative")).alias("specificity"))
    t = t.withColumn("balanced", (F.col("recall") + F.col("specificity")) / 2)
    return t.agg(F.max(F.struct((F.col("recall") >= least_recall).alias("ok"), "specificity", "balanced", "threshold", "recall")).alias("r")).select("r.threshold", "r.recall", "r.specificity", F.col("r.balanced").alias("balanced_accuracy"))


def f1_threshold(df: DataFrame, score: str, label: str, tolerance: float) -> DataFrame:
    """The least of thresholds 0.05 .. 0.95 whose F1 is within the tolerance of the best."""
    t = threshold_table(df, score, label, 20).where("i BETWEEN 1 AND 19")
    t = t.select((F.col("i") / F.lit(20.0)).alias("threshold"), ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positive")).alias("f1"))
    best = t.agg(F.array_sort(F.collect_list(F.struct("threshold", "f1"))).alias("t"), F.max("f1").alias("best"))  # 19 rows
    return best.select(F.expr(f"filter(t, x -> x.f1 >= best - {tolerance!r})[0].threshold").alias("threshold"), F.col("best").alias("best_f1"))


def kind_threshold(df: DataFrame, score: str, label: str, kind: Column, least_recall: float, least_kind_recall: float) -> DataFrame:
    """As ``best_threshold``, but rows of a kind must keep a recall of their own too (1 where there are none). One pass for both."""
    marked = df.select(F.col(score), F.col(label), kind.alias("_kind"))
    whole = threshold_table(marked, score, label, 200).where("i BETWEEN 1 AND 199")
    own = threshold_table(marked.where("_kind"), score, label, 200).select("i", F.col("tp").alias("k_tp"), F.col("positive").alias("k_positive"), F.col("negative").alias("k_negative"))
    t = whole.join(own, "i")
    n = F.coalesce("k_positive", F.lit(0)) + F.coalesce("k_negative", F.lit(0))
    t = t.select((F.col("i") / F.lit(200.0)).alias("threshold"), ratio(F.col("tp"), F.col("positive")).alias("recall"), F.when(n == 0, 1.0).otherwise(ratio(F.col("k_tp"), F.col("k_positive"))).alias("kind_recall"), ratio(F.col("negative") - F.col("fp"), F.col("negative")).alias("specificity"))
    t = t.withColumn("balanced", (F.col("recall") + F.col("specificity")) / 2).withColumn("ok", (F.col("recall") >= least_recall) & (F.col("kind_recall") >= least_kind_recall))
    return t.agg(F.max(F.struct("ok", "specificity", "balanced", "threshold", "recall", "kind_recall")).alias("r")).select("r.threshold", "r.recall", "r.kind_recall", "r.specificity", F.col("r.balanced").alias("balanced_accuracy"))


def relation_thresholds(df: DataFrame, relations: dict[str, tuple[Column, Column, float]]) -> DataFrame:
    """relation and the least of thresholds 0.05 .. 0.95 whose F1 comes within the relation's tolerance of its best.

    ``relations``: score, label (1 or other) and tolerance of each. One pass counts all; what follows has 20 rows a relation.
    """
    each = F.array(*[F.struct(F.lit(name).alias("relation"), cell(score, 20).alias("i"), (label == 1).alias("hit")) for name, (score, label, _) in relations.items()])
    counts = df.select(F.explode(each).alias("r")).groupBy("r.relation", "r.i").agg(F.count_if("r.hit").alias("pos"), F.count_if(~F.col("r.hit")).alias("neg"))
    names = df.sparkSession.range(1, 20).select(F.col("id").cast("int").alias("t"), F.explode(F.array(*[F.lit(n) for n in relations])).alias("relation"))
    at = names.join(counts, "relation", "left").groupBy("relation", "t").agg(F.coalesce(F.sum(F.when(F.col("i") >= F.col("t"), F.col("pos"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(F.col("i") >= F.col("t"), F.col("neg"))), F.lit(0)).alias("fp"), F.coalesce(F.sum("pos"), F.lit(0)).alias("positive"))
    f1 = at.select("relation", (F.col("t") / F.lit(20.0)).alias("threshold"), ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positive")).alias("f1"))
    best = f1.groupBy("relation").agg(F.max("f1").alias("best_f1"))
    slack = F.create_map(*[x for n, (_, _, t) in relations.items() for x in (F.lit(n), F.lit(max(t, 1e-12)))])
    return f1.join(best, "relation").where(F.col("f1") >= F.col("best_f1") - slack[F.col("relation")]).groupBy("relation", "best_f1").agg(F.min("threshold").alias("threshold")).select("relation", "threshold", "best_f1")


def route(domain: Column, rescue: Column, ood: float, inside: float, rescue_at: float) -> Column:
    return F.when(domain >= inside, "in_domain").when((domain < ood) & (rescue < rescue_at), "out_of_domain").otherwise("uncertain")


def policy_grid(df: DataFrame, inside: float = 0.5) -> DataFrame:
    """Every boundary pair of the grid with its four rates, from one pass with an aggregate for each pair.

    ``df`` has domain, rescue, label, context (0/1), repair (0/1).
    """
    aggs, names = [F.count_if(F.col("label") == 1).alias("n_in"), F.count_if(F.col("label") == 0).alias("n_out"), F.count_if((F.col("label") == 1) & (F.col("context") == 1)).alias("n_context"), F.count_if((F.col("label") == 1) & (F.col("repair") == 1)).alias("n_repair")], []
    for o in range(10, 50, 5):
        for r in (40, 50, 60):
            out = route(F.col("domain"), F.col("rescue"), o / 100, inside, r / 100) == "out_of_domain"
            own = f"{o}_{r}"
            names.append((own, o / 100, r / 100))
            mine = F.col("label") == 1
            aggs += [F.count_if(~out & mine).alias(f"i_{own}"), F.count_if(out & (F.col("label") == 0)).alias(f"o_{own}"), F.count_if(~out & mine & (F.col("context") == 1)).alias(f"c_{own}"), F.count_if(~out & mine & (F.col("repair") == 1)).alias(f"r_{own}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(o).alias("ood_boundary"), F.lit(r).alias("rescue_boundary"), ratio(F.col(f"i_{k}"), F.col("n_in")).alias("in_domain_recall"), ratio(F.col(f"o_{k}"), F.col("n_out")).alias("ood_specificity"), ratio(F.col(f"c_{k}"), F.col("n_context"), 1.0).alias("contextual_recall"), ratio(F.col(f"r_{k}"), F.col("n_repair"), 1.0).alias("repair_recall")) for k, o, r in names])
    return one.select(F.inline(rows))


def best_policy(grid: DataFrame) -> DataFrame:
    ok = (F.col("in_domain_recall") >= 0.98) & (F.col("contextual_recall") >= 0.98) & (F.col("repair_recall") >= 0.99)
    order = F.struct(ok.alias("ok"), "ood_specificity", "in_domain_recall", "contextual_recall", "repair_recall", "ood_boundary", (-F.col("rescue_boundary")).alias("earlier"))
    return grid.agg(F.max_by(F.struct(*grid.columns), order).alias("r")).select("r.*")


def gates(metrics: DataFrame, limits: list[tuple[str, str, float]]) -> DataFrame:
    """metric, value and passed for each limit (metric, 'min' or 'max', bound); a missing metric fails."""
    spark = metrics.sparkSession
    wanted = spark.createDataFrame(limits, "metric string, side string, bound double")
    low = F.col("value") >= F.col("bound") - 1e-12
    high = F.col("value") <= F.col("bound") + 1e-12
    passed = F.coalesce(F.when(F.col("side") == "min", low).otherwise(high), F.lit(False))
    return wanted.join(metrics, "metric", "left").select("metric", "value", passed.alias("passed"))


def positive_weights(df: DataFrame, labels: list[str], most: float) -> DataFrame:
    n = F.count(F.lit(1))
    cols = [F.greatest(F.lit(1.0), F.least(F.lit(most), (n - F.sum(c)) / F.greatest(F.sum(c), F.lit(1)))).alias(c) for c in labels]
    return df.agg(*cols).unpivot([], labels, "label", "weight")


def two_pass(alone: Column, with_previous: Column, points_back: Column, threshold: float) -> list[Column]:
    """score, accepted and used_context: the turn by itself, then with the one before it where that fails and the turn points back."""
    again = (alone < threshold) & points_back
    score = F.when(again, with_previous).otherwise(alone)
    return [score.alias("score"), (score >= threshold).alias("accepted"), again.alias("used_context")]

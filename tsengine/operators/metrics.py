"""Metrics as aggregate expressions: any grouping gives all of them in one pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsengine.operators import monitor


def regression(y: Column, p: Column) -> dict[str, Column]:
    """Metrics that can't be computed for a group (logs of negatives, constant labels) are null."""
    e = y - p
    ratio = lambda a, b: F.try_divide(a, b)
    all_ok = lambda ok: F.min(F.when(ok, 1).otherwise(0)) == 1
    msle = F.avg(F.pow(F.log1p(F.when(y > -1, y)) - F.log1p(F.when(p > -1, p)), 2))
    poisson = F.avg(2 * (F.when(y > 0, y * F.log(F.when((y > 0) & (p > 0), y / p))).otherwise(0.0) - y + p))
    gamma = F.avg(2 * (F.log(F.when((y > 0) & (p > 0), p / y)) + F.try_divide(y, p) - 1))
    return {
        "explained_variance": 1 - ratio(F.var_pop(e), F.var_pop(y)),
        "max_error": F.max(F.abs(e)),
        "mean_absolute_error": F.avg(F.abs(e)),
        "mean_squared_error": F.avg(e * e),
        "root_mean_squared_error": F.sqrt(F.avg(e * e)),
        "mean_squared_log_error": F.when(all_ok((y >= 0) & (p >= 0)), msle),
        "median_absolute_error": F.median(F.abs(e)),
        "mean_absolute_percentage_error": F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(2.220446049250313e-16))),
        "r2": 1 - ratio(F.sum(e * e), F.var_pop(y) * F.count(e)),
        "mean_poisson_deviance": F.when(all_ok((y >= 0) & (p > 0)), poisson),
        "mean_gamma_deviance": F.when(all_ok((y > 0) & (p > 0)), gamma),
        "mean_tweedie_deviance": F.avg(e * e),
    }


def scored(df: DataFrame, true: str = "true", predicted: str = "predicted", by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Rows without a label or a prediction are left out.

    The median holds a group's different errors in one task; with ``ranges`` it is taken by ranges (monitor.grouped_quantiles).
    """
    rows, by = df.filter(F.col(true).isNotNull() & F.col(predicted).isNotNull()), list(by or [])
    named = regression(F.col(true), F.col(predicted))
    if not ranges:
        return rows.groupBy(*by).agg(F.count("*").alias("n"), *(c.alias(n) for n, c in named.items()))
    median = "median_absolute_error"
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), *(c.alias(n) for n, c in named.items() if n != median))
    found = monitor.grouped_quantiles(rows.withColumn("__e", F.abs(F.col(true) - F.col(predicted))), "__e", by, [0.5], ranges).withColumnRenamed("q_0_5", median)
    found = found.withColumnsRenamed({c: f"__of_{i}" for i, c in enumerate(by)})
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{i}"))
    return out.join(found if by else F.broadcast(found), same, "left").select(*by, "n", *named)  # one row without groups


def by_month(df: DataFrame, true: str = "true", predicted: str = "predicted", keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """One pass over all months and models."""
    return scored(df.withColumn("month", F.trunc(F.col("date_time").cast("date"), "MM")), true, predicted, [*keys, "month"])


def confusion(df: DataFrame, true: str = "true", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), true, predicted).agg(F.count("*").alias("n"))


def binary(df: DataFrame, true: str = "true", predicted: str = "predicted", probability: str | None = None) -> DataFrame:
    """Classifier metrics of 0/1 labels in one aggregate; ratios without a denominator are null."""
    y, p = F.col(true).cast("int"), F.col(predicted).cast("int")
    n = lambda a, b: F.count_if((y == a) & (p == b)).cast("double")
    tp, tn, fp, fn = n(1, 1), n(0, 0), n(0, 1), n(1, 0)
    d, all_ = F.try_divide, F.count("*").cast("double")
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (all_ * all_)
    out = {
        "accuracy": d(tp + tn, all_), "precision": d(tp, tp + fp), "recall": d(tp, tp + fn), "f1": d(2 * tp, 2 * tp + fp + fn), "jaccard": d(tp, tp + fp + fn), "hamming": d(fp + fn, all_),
        "balanced_accuracy": (d(tp, tp + fn) + d(tn, tn + fp)) / 2, "kappa": d((tp + tn) / all_ - chance, 1 - chance), "mcc": d(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    }
    if probability:
        q = F.col(probability)
        c = F.least(F.greatest(q, F.lit(1e-15)), F.lit(1 - 1e-15))
        out |= {"brier": F.avg((q - y) * (q - y)), "log_loss": -F.avg(y * F.log(c) + (1 - y) * F.log(1 - c)), "hinge": F.avg(F.greatest(F.lit(0.0), 1 - (2 * y - 1) * (2 * q - 1)))}
    return df.filter(y.isNotNull() & p.isNotNull()).agg(*(c.alias(k) for k, c in out.items()))


def classes(df: DataFrame, true: str = "true", predicted: str = "predicted") -> DataFrame:
    """(label, precision, recall, f1, support) of every class, from one count of pairs; ratios without a denominator are null."""
    pairs = confusion(df.filter(F.col(true).isNotNull() & F.col(predicted).isNotNull()), true, predicted)
    sides = pairs.select(F.explode(F.array(*[F.struct(F.col(c).alias("label"), F.lit(s).alias("side")) for s, c in (("true", true), ("predicted", predicted))])).alias("x"), (F.col(true) == F.col(predicted)).alias("right"), "n")
    total = lambda s: F.sum(F.when(F.col("x.side") == s, F.col("n")).otherwise(0))
    right = F.sum(F.when(F.col("right") & (F.col("x.side") == "true"), F.col("n")).otherwise(0))
    return sides.groupBy(F.col("x.label").alias("label")).agg(
        F.try_divide(right, total("predicted")).alias("precision"), F.try_divide(right, total("true")).alias("recall"), F.try_divide(2 * right, total("true") + total("predicted")).alias("f1"), total("true").alias("support")
    )


def trade_off(df: DataFrame, true: str, score: str, ranges: int | None = None) -> DataFrame:
    """(score, hits, n, tp, fp, fn, before) by falling score: one row per different score, the counts at or above it, and the rows above it.

    Scores are counted first and dealt into ranges by cut points, so that each range is a window of its own; what lies in
    the ranges above (one row a range) is added.
    """
    per = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(F.col(true).cast("long")).alias("hits"), F.count("*").alias("n"))
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.approxQuantile(score, [i / n for i in range(1, n)], 0.5 / n))) if n > 1 else []
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("score"))) if cuts else F.lit(0)
    dealt = per.withColumn("range", place)
    sums = dealt.groupBy("range").agg(F.sum("hits").alias("all_hits"), F.sum("n").alias("all_n"))
    above = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as ranges
    offsets = sums.select("range", F.coalesce(F.sum("all_hits").over(above), F.lit(0)).alias("hits_above"), F.coalesce(F.sum("all_n").over(above), F.lit(0)).alias("n_above"), F.sum("all_hits").over(Window.partitionBy()).alias("positives"))
    w = Window.partitionBy("range").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tp, flagged = F.sum("hits").over(w) + F.col("hits_above"), F.sum("n").over(w) + F.col("n_above")
    walked = dealt.join(F.broadcast(offsets), "range").select("score", "hits", "n", tp.alias("tp"), flagged.alias("flagged"), "positives")
    return walked.select("score", "hits", "n", "tp", (F.col("flagged") - F.col("tp")).alias("fp"), (F.col("positives") - F.col("tp")).alias("fn"), (F.col("flagged") - F.col("n")).alias("before"))


#: Places of a tie whose discounts are added one by one; beyond, by the Euler-Maclaurin formula.
EXACT_PLACES = 64


def log_integral(x: Column) -> Column:
    """The logarithmic integral for x > 1, by its series in log(x), whose terms are all positive."""
    t = F.log(x)
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("power")), lambda a, k: F.struct((a["sum"] + a["power"] * t / k / k).alias("sum"), (a["power"] * t / k).alias("power")), lambda a: a["sum"])
    return F.lit(0.57721566490153286) + F.log(t) + terms


def integral_of_gain(low: Column, high: Column) -> Column:
    """The integral of 1 / log(x): by ten points where the ends are near each other, which the difference of two large values would blur."""
    middle, half = (low + high) / 2, (high - low) / 2
    near = sum((float(w) / F.log(middle + half * float(x)) for x, w in zip(*np.polynomial.legendre.leggauss(10), strict=True)), F.lit(0.0)) * half
    return F.when(high <= 2 * low, near).otherwise(log_integral(high) - log_integral(low))


def discounts(before: Column, n: Column) -> Column:
    """The sum of 1 / log2(place + 1) over n places after so many: bounded work, however many places there are."""
    gain = lambda x: 1 / F.log2(x)
    few = F.aggregate(F.sequence(before + 1, before + F.least(n, F.lit(EXACT_PLACES))), F.lit(0.0), lambda a, i: a + gain(i.cast("double") + 1))
    low, high = (before + EXACT_PLACES + 2).cast("double"), (before + n + 1).cast("double")
    log2 = F.log(F.lit(2.0))
    first = lambda x: -log2 / (x * F.pow(F.log(x), 2))
    third = lambda x: -log2 * (2 * F.pow(F.log(x), 2) + 6 * F.log(x) + 6) / (F.pow(x, 3) * F.pow(F.log(x), 4))
    rest = log2 * integral_of_gain(low, high) + (gain(low) + gain(high)) / 2 + (first(high) - first(low)) / 12 - (third(high) - third(low)) / 720
    return F.when(n > EXACT_PLACES, few + rest).otherwise(few)


def ranking(df: DataFrame, true: str, score: str, ranges: int | None = None) -> DataFrame:
    """One row (average_precision, dcg) of 0/1 labels under a score; rows of equal scores share their mean discount.

    Null scores are left out; without a positive label both are null. A tie may have any number of rows.
    """
    rows = trade_off(df, true, score, ranges)
    dcg = F.sum(F.when(F.col("hits") > 0, F.col("hits") / F.col("n") * discounts(F.col("before"), F.col("n"))).otherwise(0.0))
    positives = F.sum("hits")
    return rows.agg(F.when(positives > 0, F.sum(F.col("hits") * F.col("tp") / (F.col("tp") + F.col("fp"))) / positives).alias("average_precision"), F.when(positives > 0, dcg).alias("dcg"))


def wide_predictions(df: DataFrame, locations: list[str], value: str = "predicted") -> DataFrame:
    """Predictions as a row per time and a column per location."""
    return df.groupBy("date_time").pivot("location", locations).agg(F.first(value))


def peaks(df: DataFrame, value: str, k: int, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), "date_time")
    return df.filter(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def match_peaks(df: DataFrame, true: str, predicted: str, k: int, keys: list[str]) -> DataFrame:
    """Actual and predicted top-k times as correct, missing or incorrect."""
    a = peaks(df, true, k, keys).select(*keys, "date_time", F.lit(True).alias("is_actual"))
    b = peaks(df, predicted, k, keys).select(*keys, "date_time", F.lit(True).alias("is_predicted"))
    both = a.join(b, [*keys, "date_time"], "full")
    kind = F.when(F.col("is_actual") & F.col("is_predicted"), "correct").when(F.col("is_actual"), "missing").otherwise("incorrect")
    return both.select(*keys, "date_time", kind.alias("kind"))


def peak_confusion(df: DataFrame, true: str, predicted: str, k: int, keys: list[str]) -> DataFrame:
    """Counts of (actual class, predicted class): peak for the k largest of a group, else offpeak."""
    rank = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(c).desc_nulls_last(), "date_time"))
    label = lambda c: F.when(rank(c) <= k, "peak").otherwise("offpeak")
    return df.select(label(true).alias("actual_class"), label(predicted).alias("predicted_class")).groupBy("actual_class", "predicted_class").agg(F.count("*").alias("n"))


def residuals(df: DataFrame, true: str = "true", predicted: str = "predicted") -> DataFrame:
    return df.withColumn("residual", F.col(predicted) - F.col(true))

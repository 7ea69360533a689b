"""Rolling-origin back-tests, random search and greedy feature selection. Folds are small; the rows never leave Spark."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.operators import metrics
from tsengine.operators.domain import Domain


@dataclass(frozen=True)
class Fold:
    fold: int
    train_start: str
    train_end: str
    test_start: str
    test_end: str


def rolling_folds(domain: Domain, n_splits: int = 5, max_train: int | None = None, test_size: int | None = None) -> list[Fold]:
    """Contiguous test windows tiled back from the end; each trains on what lies before it, at most max_train steps."""
    import datetime as dt

    start, end, step = dt.datetime.fromisoformat(domain.start), dt.datetime.fromisoformat(domain.end), dt.timedelta(seconds=domain.seconds)
    n = int((end - start) / step) + 1
    test = test_size or n // (n_splits + 1)
    if test < 1 or n - n_splits * test < 1:
        raise ValueError("too few steps for the folds")
    at = lambda i: (start + i * step).isoformat(sep=" ")
    out = []
    for i in range(n_splits):
        first = n - (n_splits - i) * test
        out.append(Fold(i, at(max(0, first - max_train) if max_train else 0), at(first - 1), at(first), at(first + test - 1)))
    return out


def fold_table(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    rows = spark.createDataFrame([(f.fold, f.train_start, f.train_end, f.test_start, f.test_end) for f in folds], "fold int, train_start string, train_end string, test_start string, test_end string")
    return rows.select("fold", *(F.col(c).cast("timestamp_ntz").alias(c) for c in rows.columns[1:]))


def in_folds(df: DataFrame, folds: list[Fold], which: str = "test") -> DataFrame:
    """Each row once for each fold whose window it lies in: an explode of matching folds, no join."""
    kinds = [F.when(F.col("date_time").between(F.lit(getattr(f, f"{which}_start")).cast("timestamp_ntz"), F.lit(getattr(f, f"{which}_end")).cast("timestamp_ntz")), f.fold) for f in folds]
    return df.withColumn("fold", F.explode(F.array_compact(F.array(*kinds))))


def run(df: DataFrame, folds: list[Fold], make: Callable[[], object], train_scores: bool = False, report: list[dict] | None = None) -> DataFrame:
    """(fold, which, location, date_time, true, predicted): a fresh model per fold. While models are fitted, the features are held, so that they are computed once.

    A list given as report gets each fold's windows, their numbers of rows and the seconds that fitting took. Linear models of many
    folds are fitted in one pass by ``moments.run``.
    """
    was_held = df.is_cached
    if not was_held:
        df.persist()
    out, models = None, []
    for f in folds:
        within = lambda a, b: F.col("date_time").between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"))
        train, test = df.filter(within(f.train_start, f.train_end)), df.filter(within(f.test_start, f.test_end))
        began = time.perf_counter()
        models.append((f, train, test, make().fit(train)))
        if report is not None:
            seconds = time.perf_counter() - began
            sizes = df.agg(F.count_if(within(f.train_start, f.train_end)).alias("train"), F.count_if(within(f.test_start, f.test_end)).alias("test")).first()
            report.append(vars(f) | {"n_train": sizes.train, "n_test": sizes.test, "fit_seconds": seconds})
    if not was_held:
        df.unpersist()
    for f, train, test, model in models:
        for which, part in (("test", test), *((("train", train),) if train_scores else ())):
            p = model.predict(part).select(F.lit(f.fold).alias("fold"), F.lit(which).alias("which"), "location", "date_time", F.col(model.label).alias("true"), "predicted")
            out = p if out is None else out.unionByName(p)
    return out


def report_table(spark: SparkSession, report: list[dict]) -> DataFrame:
    """What run reported, a row by fold."""
    return spark.createDataFrame([tuple(r.values()) for r in report], "fold int, train_start string, train_end string, test_start string, test_end string, n_train long, n_test long, fit_seconds double")


def save(predictions: DataFrame, folds: list[Fold], path: str) -> None:
    """A back-test's predictions and folds as Parquet, so that metrics can be taken later without fitting again."""
    predictions.write.mode("overwrite").parquet(f"{path}/predictions")
    fold_table(predictions.sparkSession, folds).coalesce(1).write.mode("overwrite").parquet(f"{path}/folds")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, list[Fold]]:
    rows = spark.read.parquet(f"{path}/folds").orderBy("fold").collect()
    return spark.read.parquet(f"{path}/predictions"), [Fold(r.fold, *(str(r[c]) for c in ("train_start", "train_end", "test_start", "test_end"))) for r in rows]


def grouped_metrics(predictions: DataFrame, how: str = "fold") -> DataFrame:
    """Metrics by fold, location or location-fold. The percentage error of a group with a zero label is null.

    Rows without a label are dropped; groups with a missing prediction have null metrics and count them in n_unpredicted.
    """
    keys = {"fold": ["fold"], "location": ["location"], "location-fold": ["location", "fold"]}[how]
    rows = predictions.filter(F.col("true").isNotNull())
    y, p = F.col("true"), F.col("predicted")
    named = metrics.regression(y, p)
    whole = F.count_if(p.isNull()) == 0
    wanted = {"mae": "mean_absolute_error", "median_abs_error": "median_absolute_error", "mse": "mean_squared_error", "rmse": "root_mean_squared_error", "r2": "r2", "explained_variance": "explained_variance"}
    mape = F.when(F.count_if(y == 0) == 0, F.avg(F.abs(F.try_divide(y - p, y))))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(p.isNull()).alias("n_unpredicted"), F.when(whole, mape).alias("mape"), *(F.when(whole, named[c]).alias(k) for k, c in wanted.items()))


def all_metrics(predictions: DataFrame) -> DataFrame:
    """By fold, by location and by both in one query."""
    y, p = F.col("true"), F.col("predicted")
    named = metrics.regression(y, p)
    return predictions.filter(y.isNotNull() & p.isNotNull()).groupingSets([["fold"], ["location"], ["location", "fold"]], "location", "fold").agg(F.count("*").alias("n"), named["mean_absolute_error"].alias("mae"), named["root_mean_squared_error"].alias("rmse"), named["r2"].alias("r2"))


def random_search(df: DataFrame, folds: list[Fold], make: Callable[[dict], object], grid: dict[str, list], draws: int = 10, seed: int = 32) -> list[tuple[dict, float]]:
    """(parameters, mean of the folds' R2), best first; draws are distinct."""
    rng, tried = random.Random(seed), []
    every = 1
    for v in grid.values():
        every *= len(v)
    while len(tried) < min(draws, every):
        params = {k: rng.choice(v) for k, v in grid.items()}
        if params not in tried:
            tried.append(params)
    results = []
    for params in tried:
        r = grouped_metrics(run(df, folds, lambda: make(params)), "fold").agg(F.avg("r2")).first()[0]  # noqa: B023
        results.append((params, r if r is not None else float("-inf")))
    return sorted(results, key=lambda x: -x[1])


def select_features(df: DataFrame, folds: list[Fold], make: Callable[[list[str]], object], features: list[str], wanted: int) -> tuple[list[str], list[str]]:
    """Greedy forward selection by the folds' mean R2: (selected, rejected)."""
    chosen, left = [], list(features)
    while left and len(chosen) < wanted:
        scored = [(grouped_metrics(run(df, folds, lambda: make([*chosen, f])), "fold").agg(F.avg("r2")).first()[0], f) for f in left]  # noqa: B023
        best = max(scored, key=lambda x: x[0] if x[0] is not None else float("-inf"))[1]
        chosen.append(best)
        left.remove(best)
    return chosen, left

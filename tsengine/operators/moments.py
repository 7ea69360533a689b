"""Many linear fits from one pass: means and covariances of time blocks, added up to folds, searches and selections.

Folds overlap, so their ends cut time into blocks. One aggregation gives each block's number of rows, means and
covariances of all features and the label, apart for each pattern of missing features: a fit leaves out rows where one of its own
features is missing, so it takes the patterns in which they are all present. Means and covariances of two
groups of rows give those of both together, without going back to the rows. What reaches the driver is a matrix of the number of features
for each block and pattern that occurs; every fold, penalty and choice of features is then a small solve.

Scores need no rows either: the squared error of a line over a test window follows from the window's means and covariances. Predictions, where
wanted, are one pass over the rows with each fold's coefficients in the expression.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.operators.backtest import Fold


@dataclass
class Moments:
    """Number of rows, means, and sums of products of deviations from them."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not self.n or not other.n:
            return self if self.n else other
        apart = other.mean - self.mean
        return Moments(n, self.mean + apart * other.n / n, self.products + other.products + np.outer(apart, apart) * self.n * other.n / n)

    def of(self, columns: Sequence[int]) -> Moments:
        return Moments(self.n, self.mean[columns], self.products[np.ix_(columns, columns)])


def total(parts: Iterable[Moments], width: int) -> Moments:
    out = Moments(0, np.zeros(width), np.zeros((width, width)))
    for p in parts:
        out = out + p
    return out


@dataclass(frozen=True)
class Line:
    """intercept + coefficients * features; without rows to learn from, both are None."""

    intercept: float | None
    coefficients: tuple[float, ...] | None
    n: int


def stamp(x: str) -> Column:
    return F.lit(x).cast("timestamp_ntz")


class FoldMoments:
    """What all folds need to know of the rows."""

    def __init__(self, df: DataFrame, folds: list[Fold], features: list[str], label: str = "value"):
        self.folds, self.features, self.label = folds, list(features), label
        starts = {x for f in folds for x in (f.train_start, f.test_start)}
        ends = {x for f in folds for x in (f.train_end, f.test_end)}
        # A block's place: how many windows have begun, and how many have ended, before a row's time.
        t = F.col("date_time")
        begun = sum((F.when(t >= stamp(x), 1).otherwise(0) for x in sorted(starts)), F.lit(0))
        ended = sum((F.when(t > stamp(x), 1).otherwise(0) for x in sorted(ends)), F.lit(0))
        self.starts, self.ends = sorted(starts), sorted(ends)
        named = [*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.features)), F.col(label).cast("double").alias(f"x{len(features)}")]
        rows = df.filter(F.col(label).isNotNull()).select(begun.alias("begun"), ended.alias("ended"), *named)
        width = len(features) + 1
        pattern = F.concat(*(F.when(F.col(f"x{i}").isNull() | F.isnan(f"x{i}"), "0").otherwise("1") for i in range(width - 1)), F.lit(""))
        pairs = list(itertools.combinations_with_replacement(range(width), 2))
        aggs = [F.count("*").alias("n"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(width)), *(F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs)]
        self.parts: list[tuple[int, int, str, Moments]] = []
        for r in rows.withColumn("pattern", pattern).groupBy("begun", "ended", "pattern").agg(*aggs).collect():  # at most windows' ends times patterns
            products = np.zeros((width, width))
            for i, j in pairs:
                products[i, j] = products[j, i] = r.n * (np.nan if r[f"c{i}_{j}"] is None else r[f"c{i}_{j}"])
            self.parts.append((r.begun, r.ended, r.pattern, Moments(r.n, np.array([np.nan if r[f"m{i}"] is None else r[f"m{i}"] for i in range(width)]), products)))
        self.parts.sort(key=lambda p: p[:3])

    def window(self, start: str, end: str, features: Sequence[str]) -> tuple[Moments, int]:
        """Of the rows within a closed range of times where all these features are present, with the label last; and how many lack one."""
        columns = [self.features.index(f) for f in features]
        first, last = self.starts.index(start) + 1, self.ends.index(end)
        inside = [(p, m) for begun, ended, p, m in self.parts if begun >= first and ended <= last]
        whole = [m.of([*columns, len(self.features)]) for p, m in inside if all(p[c] == "1" for c in columns)]
        found = total(whole, len(columns) + 1)
        return found, sum(m.n for _, m in inside) - found.n

    def fit(self, fold: Fold, features: Sequence[str], alpha: float = 0.0) -> Line:
        """Least squares with the penalty alpha * |coefficients|^2; of several solutions the shortest. A feature that is constant up to rounding has the coefficient zero."""
        m, _ = self.window(fold.train_start, fold.train_end, features)
        if not m.n:
            return Line(None, None, 0)
        xx, xy = m.products[:-1, :-1] + alpha * np.eye(len(features)), m.products[:-1, -1]
        varies = np.diag(m.products)[:-1] > m.n * (1e-12 * np.abs(m.mean[:-1])) ** 2
        size = np.where(varies, np.sqrt(np.maximum(np.diag(xx), 0.0)), np.inf)
        beta = np.linalg.lstsq(xx / np.outer(size, size), xy / size, rcond=1e-13)[0] / size
        return Line(float(m.mean[-1] - beta @ m.mean[:-1]), tuple(beta.tolist()), m.n)

    def score(self, fold: Fold, features: Sequence[str], alpha: float = 0.0) -> dict:
        """Metrics of the fold's test window. As for single fits, they are null where a row with a label has no prediction, and r2 where the label is constant."""
        line = self.fit(fold, features, alpha)
        m, lost = self.window(fold.test_start, fold.test_end, features)
        out = {"fold": fold.fold, "n_train": line.n, "n": m.n + lost, "n_unpredicted": lost if line.coefficients is not None else m.n + lost, "mse": None, "rmse": None, "r2": None, "explained_variance": None}
        if line.coefficients is None or lost or not m.n:
            return out
        to_error = np.r_[-np.array(line.coefficients), 1.0]  # the error is the label less the line
        spread = float(to_error @ m.products @ to_error)
        bias = float(to_error @ m.mean) - line.intercept
        squared = max(spread, 0.0) + m.n * bias * bias
        about = float(m.products[-1, -1])
        out |= {"mse": squared / m.n, "rmse": float(np.sqrt(squared / m.n))}
        return out | ({"r2": 1 - squared / about, "explained_variance": 1 - spread / about} if about > 0 else {})

    def mean_r2(self, features: Sequence[str], alpha: float = 0.0) -> float | None:
        found = [s["r2"] for f in self.folds if (s := self.score(f, features, alpha))["r2"] is not None]
        return sum(found) / len(found) if found else None

    def search(self, candidates: Iterable[tuple[Sequence[str], float]]) -> list[tuple[tuple[str, ...], float, float | None]]:
        """(features, alpha, mean of the folds' r2) of each candidate, best first; those without a score come last."""
        found = [(tuple(f), a, self.mean_r2(f, a)) for f, a in candidates]
        return sorted(found, key=lambda x: -np.inf if x[2] is None else x[2], reverse=True)

    def select(self, wanted: int, alpha: float = 0.0) -> tuple[list[str], list[str]]:
        """Greedy forward selection by the folds' mean r2: (selected, rejected)."""
        chosen, left = [], list(self.features)
        while left and len(chosen) < wanted:
            best = max(left, key=lambda f: -np.inf if (r := self.mean_r2([*chosen, f], alpha)) is None else r)
            chosen.append(best)
            left.remove(best)
        return chosen, left


SCORES = "fold int, n_train long, n long, n_unpredicted long, mse double, rmse double, r2 double, explained_variance double"


def scores(df: DataFrame, folds: list[Fold], features: list[str], label: str = "value", alpha: float = 0.0) -> DataFrame:
    """A row by fold: sizes and metrics of its test window."""
    held = FoldMoments(df, folds, features, label)
    return df.sparkSession.createDataFrame([tuple(held.score(f, features, alpha).values()) for f in folds], SCORES)


def run(df: DataFrame, folds: list[Fold], features: list[str], label: str = "value", alpha: float = 0.0) -> DataFrame:
    """(fold, which, location, date_time, true, predicted) of all folds' test windows: one pass to fit, and one that predicts, whatever the number of folds."""
    held = FoldMoments(df, folds, features, label)
    windows = []
    for f in folds:
        line = held.fit(f, features, alpha)
        value = F.lit(None).cast("double") if line.coefficients is None else sum((F.lit(w) * F.col(c).cast("double") for w, c in zip(line.coefficients, features, strict=True)), F.lit(line.intercept))
        windows.append(F.when(F.col("date_time").between(stamp(f.test_start), stamp(f.test_end)), F.struct(F.lit(f.fold).alias("fold"), F.nanvl(value, F.lit(None).cast("double")).alias("predicted"))))
    rows = df.withColumn("__x", F.explode(F.array_compact(F.array(*windows))))
    return rows.select(F.col("__x.fold").alias("fold"), F.lit("test").alias("which"), "location", "date_time", F.col(label).alias("true"), F.col("__x.predicted").alias("predicted"))


def leaderboard(spark: SparkSession, found: list[tuple[tuple[str, ...], float, float | None]]) -> DataFrame:
    """(features, alpha, r2) of a search."""
    return spark.createDataFrame([(", ".join(f), float(a), r) for f, a, r in found], "features string, alpha double, r2 double")

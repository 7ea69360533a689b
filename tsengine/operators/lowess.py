"""Locally weighted regression over range partitions: a smooth trend of one column along another.

For each point a line is fitted to its nearest ``neighbours`` points, with tricube weights by distance, and read off at the point. In
further rounds points far from the trend count less (bisquare weights by six median residuals). Points in order of x are numbered, by ranges
whose counts are added up, and dealt into segments of consecutive numbers, each with as many points of the next
ones on both sides as a fit may reach: segments are tasks of their own, and no task holds a group. The number of
neighbours is given as such, not as a share of the rows, since with a share every segment would need that share of all of them.

Of points that are as near, those before are taken; the window always holds the point itself. Points with equal x are ordered by y. Where
all neighbours have the same x the trend is their weighted mean; where none of them has a robustness weight, tricube weights count alone.
Rows without x or y have no trend.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsengine.operators.monitor import grouped_quantiles
from tsengine.session import cut

#: Points of a segment at least.
SEGMENT = 4096


def starts(x: np.ndarray, k: int) -> np.ndarray:
    """Where the window of the k nearest points of each point begins; x is in order."""
    n = len(x)
    ends = x[: n - k] + x[k:]  # a window moves on while the point after it is nearer than its first one
    at = np.searchsorted(ends, 2 * x, "left")
    here = np.arange(n)
    return np.clip(at, np.maximum(here - k + 1, 0), np.minimum(here, n - k))


def local_lines(x: np.ndarray, y: np.ndarray, weight: np.ndarray, k: int, first: int, stop: int) -> np.ndarray:
    """The trend at the points first to stop (exclusive) of points in order."""
    k = min(k, len(x))
    begin, out = starts(x, k)[first:stop], np.empty(stop - first)
    for a in range(0, stop - first, max(1, 200_000 // k)):
        b = min(stop - first, a + max(1, 200_000 // k))
        at = begin[a:b, None] + np.arange(k)
        apart = x[at] - x[first + a : first + b, None]
        reach = np.abs(apart).max(axis=1, keepdims=True)
        near = (1 - (np.abs(apart) / np.where(reach > 0, reach, 1)) ** 3) ** 3
        w = near * weight[at]
        w = np.where(w.sum(axis=1, keepdims=True) > 0, w, near)
        w /= w.sum(axis=1, keepdims=True)
        mean, level = (w * apart).sum(axis=1), (w * y[at]).sum(axis=1)
        off = apart - mean[:, None]
        spread = (w * off * off).sum(axis=1)
        slope = np.where(spread > 1e-14 * reach[:, 0] ** 2, (w * off * y[at]).sum(axis=1) / np.where(spread > 0, spread, 1), 0.0)
        out[a:b] = level - slope * mean
    return out


def numbered(df: DataFrame, by: list[str], ranges: int) -> DataFrame:
    """The frame with __i, the place of each row in its group by __x, then __y, counted by ranges of __x."""
    cuts = sorted(set(df.approxQuantile("__x", [i / ranges for i in range(1, ranges)], 0.5 / ranges))) if ranges > 1 else []
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("__x"))) if cuts else F.lit(0)
    dealt = df.withColumn("__range", place)
    group = Window.partitionBy(*(by or [F.lit(0)]))
    before = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*by, "__range").agg(F.count("*").alias("__n")).select(*(F.col(c).alias(f"__of_{i}") for i, c in enumerate(by)), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    same = F.col("__range") == F.col("__r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{i}"))
    inside = F.row_number().over(Window.partitionBy(*by, "__range").orderBy("__x", "__y", "__id"))
    return dealt.withColumn("__i", inside - 1).join(sizes, same).withColumn("__i", F.col("__i") + F.col("__offset")).drop("__range", "__r", "__offset", *(f"__of_{i}" for i in range(len(by))))


def lowess(df: DataFrame, x: str, y: str, neighbours: int, robust: int = 3, by: list[str] | None = None, name: str = "trend", ranges: int | None = None) -> DataFrame:
    """The frame with the trend of y along x (numbers or times) beside each row, for each group of ``by``; robust is the number of further rounds."""
    if neighbours < 2:
        raise ValueError("a line needs at least two neighbours")
    by, n = list(by or []), ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    along = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(x)) / 1e6 if df.schema[x].dataType.typeName().startswith(("timestamp", "date")) else F.col(x).cast("double")
    held = cut(df.withColumn("__x", F.nanvl(along, F.lit(None).cast("double"))).withColumn("__y", F.nanvl(F.col(y).cast("double"), F.lit(None).cast("double"))).withColumn("__id", F.monotonically_increasing_id()))
    there = F.col("__x").isNotNull() & F.col("__y").isNotNull()
    state = cut(numbered(held.filter(there).select(*by, "__x", "__y", "__id"), by, n).withColumn("__w", F.lit(1.0)))
    size = max(SEGMENT, 4 * neighbours)
    schema = state.select(*by, "__x", "__y", "__id", "__i", "__w").withColumn("__t", F.lit(0.0)).schema

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__i", kind="stable").reset_index(drop=True)
        own = np.flatnonzero((part["__i"] // size == part["__s"]).to_numpy())
        found = part.iloc[own].copy()
        found["__t"] = local_lines(part["__x"].to_numpy(), part["__y"].to_numpy(), part["__w"].to_numpy(), neighbours, int(own[0]), int(own[-1]) + 1) if len(own) else []
        return found[schema.names]

    for number in range(robust + 1):
        segments = F.array_distinct(F.array(*(F.floor((F.col("__i") + d) / size) for d in (0, -neighbours, neighbours))))
        fitted = cut(state.withColumn("__s", F.explode(segments)).groupBy(*by, "__s").applyInPandas(fit, schema))
        if number == robust:
            break
        lost = fitted.withColumn("__e", F.abs(F.col("__y") - F.col("__t")))
        middle = grouped_quantiles(lost, "__e", by, [0.5], n).withColumnsRenamed({c: f"__of_{i}" for i, c in enumerate(by)})
        same = F.lit(True)
        for i, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"__of_{i}"))
        share = F.when(F.col("q_0_5") > 0, F.col("__e") / (6 * F.col("q_0_5"))).otherwise(F.when(F.col("__e") > 0, 1.0).otherwise(0.0))
        joined = lost.join(middle, same) if by else lost.join(F.broadcast(middle))  # one row without groups
        state = joined.withColumn("__w", F.when(share < 1, F.pow(1 - share * share, F.lit(2))).otherwise(0.0)).select(*by, "__x", "__y", "__id", "__i", "__w")
    trend = fitted.select(F.col("__id").alias("__of"), F.col("__t").alias(name))
    return held.join(trend, F.col("__id") == F.col("__of"), "left").select(*(c for c in df.columns if c != name), name)

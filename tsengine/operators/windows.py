"""Sequence operations along each location's time axis: windows by location, or by blocks of a location where one is long; keyed results need no order."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsengine.operators.domain import Domain, parse_step, UNITS

BY = "location"


def over(by: str | list[str] = BY):
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy("date_time")


def lag_columns(value: str, lags: list[str] | None, domain: Domain, prefix: str = "lag") -> list[Column]:
    """One column per lag such as '24 hours'; the frame must hold the extended domain. No lags at all is one null column."""
    if lags is None:
        return [F.lit(None).cast("double").alias(f"{prefix}_none")]
    if not lags:
        raise ValueError("no lags given")
    out = []
    for lag in lags:
        n, unit = parse_step(lag) if not lag.startswith("0") else (0, "hour")
        steps, left = divmod(n * UNITS[unit], domain.seconds)
        if left:
            raise ValueError(f"{lag} is no multiple of the step {domain.step}")
        out.append(F.lag(value, steps).over(over()).alias(f"{prefix}_{n}_{unit}"))
    return out


def lag_rows(source: DataFrame, value: str, lags: list[str], domain: Domain) -> DataFrame:
    """(location, date_time, value, a column per lag): each reading is counted at its own time and at those where it is a lag.

    One aggregation by place and time, without a window: a place with most of the rows is no task of its own. Readings
    must be one per place and time. Rows outside the domain come along; a join to its grid leaves them out.
    """
    steps = [(n * UNITS[unit], f"lag_{n}_{unit}") for n, unit in ((parse_step(x) if not x.startswith("0") else (0, "hour")) for x in lags)]
    for seconds, name in steps:
        if seconds % domain.seconds:
            raise ValueError(f"{name} is no multiple of the step {domain.step}")
    places = [F.struct(F.lit(i).alias("i"), (F.col("date_time") + F.make_dt_interval(secs=F.lit(s))).alias("at")) for i, (s, _) in enumerate([(0, value), *steps])]
    moved = source.select("location", F.col(value).cast("double").alias("v"), F.explode(F.array(*places)).alias("x"))
    return moved.groupBy("location", F.col("x.at").alias("date_time")).agg(*(F.max(F.when(F.col("x.i") == i, F.col("v"))).alias(name) for i, name in enumerate([value, *(n for _, n in steps)])))


def neighbours(df: DataFrame, value: str, by=BY, block: str | None = None) -> DataFrame:
    """The frame with structs __here, __before and __after, (i, v): the row's place and value, and the nearest observations at or before and at or after it.

    By windows over each location as a whole; with a block such as '30 days', over each block of a location, so that a
    long series is many tasks: only a block's count and its first and last observation are put in order by location.
    """
    keys = [by] if isinstance(by, str) else list(by)
    here = lambda offset: F.struct((F.col("__i") + offset).alias("i"), F.col(value).cast("double").alias("v"))
    if not block:
        w, zero = over(by), F.lit(0)
        numbered = df.withColumn("__i", F.row_number().over(w)).withColumn("__here", here(zero))
    else:
        n, unit = parse_step(block)
        elapsed = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("date_time"))
        w = Window.partitionBy(*keys, "__block").orderBy("date_time")
        numbered = df.withColumn("__block", F.floor(elapsed / (n * UNITS[unit]))).withColumn("__i", F.row_number().over(w))
        seen = F.when(F.col(value).isNotNull(), here(F.lit(0)))
        per = numbered.groupBy(*keys, "__block").agg(F.count("*").alias("n"), F.min(seen).alias("first"), F.max(seen).alias("last"))
        blocks = Window.partitionBy(*keys).orderBy("__block")
        earlier, later = blocks.rowsBetween(Window.unboundedPreceding, -1), blocks.rowsBetween(1, Window.unboundedFollowing)
        per = per.withColumn("__offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        moved = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.i") + F.col("__offset")).alias("i"), F.col(f"{c}.v").alias("v")))
        per = per.select(*keys, "__block", "__offset", F.last(moved("last"), ignorenulls=True).over(earlier).alias("__earlier"), F.first(moved("first"), ignorenulls=True).over(later).alias("__later"))
        named = [*keys, "__block"]
        per = per.withColumnsRenamed({k: f"__of_{i}" for i, k in enumerate(named)})
        same = [F.col(k).eqNullSafe(F.col(f"__of_{i}")) for i, k in enumerate(named)]
        numbered = numbered.join(per, same).drop(*(f"__of_{i}" for i in range(len(named)))).withColumn("__here", here(F.col("__offset")))
    seen = F.when(F.col(value).isNotNull(), F.col("__here"))
    before = F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(seen, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    if block:
        before, after = F.coalesce(before, "__earlier"), F.coalesce(after, "__later")
    return numbered.withColumn("__before", before).withColumn("__after", after).drop("__i", "__block", "__offset", "__earlier", "__later")


def interpolate(df: DataFrame, value: str, name: str | None = None, trailing: bool = False, leading: bool = False, by=BY, block: str | None = None) -> DataFrame:
    """Linear by row position between observations; trailing and leading gaps are filled with the nearest one on request. block: see neighbours."""
    both = neighbours(df, value, by, block)
    line = F.col("__before.v") + (F.col("__after.v") - F.col("__before.v")) * (F.col("__here.i") - F.col("__before.i")) / (F.col("__after.i") - F.col("__before.i"))
    found = F.coalesce(F.col(value).cast("double"), line, *([F.col("__before.v")] if trailing else []), *([F.when(F.col("__before").isNull(), F.col("__after.v"))] if leading else []))
    return both.withColumn(name or value, found).drop("__here", "__before", "__after")


def backfill_singleton(df: DataFrame, value: str, name: str | None = None, by=BY, block: str | None = None) -> DataFrame:
    """Fill gaps of exactly one row: the mean of both neighbours, or the next value at the start. A last row stays. block: see neighbours."""
    if block:
        both, i = neighbours(df, value, by, block), F.col("__here.i")
        next_to = F.col("__after.i") == i + 1
        fill = F.when((i == 1) & next_to, F.col("__after.v")).when((F.col("__before.i") == i - 1) & next_to, (F.col("__before.v") + F.col("__after.v")) / 2)
        return both.withColumn(name or value, F.coalesce(F.col(value), fill)).drop("__here", "__before", "__after")
    w = over(by)
    prev, after, first = F.lag(value).over(w), F.lead(value).over(w), F.row_number().over(w) == 1
    fill = F.when(first, after).when(prev.isNotNull() & after.isNotNull(), (prev + after) / 2)
    return df.withColumn(name or value, F.coalesce(F.col(value), fill))


def persist_last(df: DataFrame, value: str, name: str | None = None, by=BY, block: str | None = None) -> DataFrame:
    """The last observation carried forward. block: see neighbours."""
    if block:
        return neighbours(df, value, by, block).withColumn(name or value, F.col("__before.v")).drop("__here", "__before", "__after")
    return df.withColumn(name or value, F.last(value, ignorenulls=True).over(over(by).rowsBetween(Window.unboundedPreceding, 0)))


def fill_rolling(df: DataFrame, value: str, method: Callable[[pd.Series], float], fit_len: int, name: str | None = None, by: str = BY, block: str | None = "30 days") -> DataFrame:
    """Fill gaps in time order by any function of the fit_len + 1 values before, earlier fills included.

    A fill depends on those before it only until fit_len + 1 observed rows stand together: what follows them sees nothing
    older. So a series is cut into pieces after such rows, each piece being filled by itself with those rows in front of it;
    rows after which nothing is missing in a piece aren't in one. Pieces are found in blocks of time (see neighbours), so
    a long series, or a place with most of the rows, is many tasks; only a stretch without so many observed rows together stays one.
    """
    name, k = name or value, fit_len + 1
    kept = [c for c in df.columns if c != name]
    there = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    lost = neighbours(df.withColumn("__lost", F.when(~there, 1.0)), "__lost", by, block)
    known = lost.withColumn("__n", F.col("__here.i")).withColumn("__next_lost", F.col("__after.i")).withColumn("__since", F.col("__here.i") - F.coalesce("__before.i", F.lit(0))).drop("__here", "__before", "__after", "__lost")
    last_of_run = there & (F.col("__next_lost") == F.col("__n") + 1) & (F.col("__since") >= k)
    cut = neighbours(known.withColumn("__safe", F.when(last_of_run, 1.0)), "__safe", by, block)
    safe, before, after = F.col("__safe").isNotNull(), F.col("__before.i"), F.col("__after.i")
    inside = ~safe & (~there | F.col("__next_lost").isNotNull() & (after.isNull() | (F.col("__next_lost") < after)))
    # Rows outside of pieces come along in parcels of their own, with numbers below zero.
    piece = lambda at, context: F.struct(at.alias("at"), F.lit(context).alias("context"))
    own = piece(F.when(inside, F.coalesce(before, F.lit(0))).otherwise(-1 - F.floor(F.col("__n") / 4096)), False)
    ahead = F.when(after.isNotNull() & (after - F.col("__n") < k), piece(after, True))
    dealt = cut.withColumn("__piece", F.explode(F.array_compact(F.array(own, ahead)))).select(*dict.fromkeys([*kept, value, by]), F.col("__piece.at").alias("__at"), F.col("__piece.context").alias("__context"))
    filled = df.select(*kept).schema.add(name, "double") if name != value else df.select(*kept).schema.add(value, "double")

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["date_time"], kind="stable")
        v = part[value].astype("float64").to_numpy().copy()
        if part["__at"].iloc[0] >= 0:
            for i in range(1, len(v)):
                if v[i] != v[i]:
                    v[i] = method(pd.Series(v[max(0, i - k) : i]))
        part[name] = pd.Series(v, index=part.index).astype(object).where(v == v, None)
        return part.loc[~part["__context"], filled.names]

    return dealt.groupBy(by, "__at").applyInPandas(fill, filled).select(*(c for c in df.columns), *([name] if name not in df.columns else []))


def convolve(df: DataFrame, value: str, kernel: list[float], name: str = "convolved", by=BY, block: str | None = None) -> DataFrame:
    """The valid part of a convolution along time: a location of n rows gives n - k + 1; null where a term is.

    With a block (see neighbours) rows are numbered by blocks, and each adds its terms to the places that they belong to:
    one aggregation, without a window over a location.
    """
    k = len(kernel)
    if block:
        keys = [by] if isinstance(by, str) else list(by)
        row = F.struct(*(F.col(f"`{c}`").alias(c) for c in df.columns)).alias("row")
        numbered = neighbours(df, value, by, block).select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)), F.col("__here.i").alias("i"), F.col("__here.v").alias("v"), row)
        terms = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(float(w)).alias("w")) for j, w in enumerate(kernel)))
        moved = numbered.withColumn("x", F.explode(terms)).withColumn("i", F.col("i") + F.col("x.j"))
        total = F.when(F.count("v") == k, F.sum(F.col("v") * F.col("x.w"))).alias("total")
        found = moved.groupBy(*(f"__k{i}" for i in range(len(keys))), "i").agg(F.max_by("row", F.when(F.col("x.j") == 0, 1).otherwise(0)).alias("row"), F.max(F.when(F.col("x.j") == 0, True)).alias("there"), total)
        return found.filter(F.col("there") & (F.col("i") >= k)).select("row.*", "total").withColumnRenamed("total", name)
    w = over(by)
    terms = [F.lag(value, i).over(w) * float(kernel[i]) for i in range(k)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.withColumn("__i", F.row_number().over(w)).withColumn(name, total).filter(F.col("__i") >= k).drop("__i")


def rank_labels(df: DataFrame, value: str, labels: list, keys: list, name: str = "label") -> DataFrame:
    """Label the i-th largest value of each group with labels[i]; nulls come last, ties go to the earlier time."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), "date_time", "location")
    return df.withColumn(name, F.element_at(F.array(*map(F.lit, labels)), F.row_number().over(w)))


def top_k(df: DataFrame, value: str, k: int, keys: list, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), "date_time")
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def step_changes(df: DataFrame, by=BY) -> DataFrame:
    """(location, seconds, n): the steps between neighbours; one row per location if it is regular."""
    gap = F.timestamp_diff("SECOND", F.lag("date_time").over(over(by)), F.col("date_time"))
    return df.withColumn("seconds", gap).filter("seconds IS NOT NULL").groupBy(by, "seconds").agg(F.count("*").alias("n"))


def from_first(df: DataFrame, name: str = "delta_seconds", zero: str | None = None, by=BY) -> DataFrame:
    start = F.lit(zero).cast("timestamp_ntz") if zero else F.first("date_time").over(over(by).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, F.timestamp_diff("SECOND", start, F.col("date_time")))

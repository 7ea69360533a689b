"""Scalar expressions on values. Missing is NULL throughout; NaN is turned into it at the sources."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def let(use, **values: Column) -> Column:
    """use(row), where row holds the values: each is computed once however often it is used."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), use)[0]


def zeros_to_null(v: Column) -> Column:
    return F.nullif(v, F.lit(0.0))


def shift_longitude(lon: Column) -> Column:
    return F.when(lon < 0, lon + 360).otherwise(lon)


def total(*columns: Column) -> Column:
    """Row-wise sum; null if any is."""
    return reduce(add, columns)


def difference(first: Column, *rest: Column) -> Column:
    """The first less all others; null if any is. With no others, the first."""
    return first - total(*rest) if rest else first


def clamp(v: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null, unlike with plain least and greatest."""
    out = v
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return F.when(v.isNotNull(), out)


def kelvin_to_celsius(v: Column) -> Column:
    return v - 273.15


def tidy(v: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    r = F.round(v, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def horizon_from_lags(hours: list[int]) -> str:
    """The forecast horizon that a set of lags allows: its smallest lag as two digits, or the six-hour range it lies in."""
    least = min(hours)
    if least > 48 or least < 1:
        raise ValueError("lags must be between 1 and 48 hours")
    if least <= 18:
        return f"{least:02d}"
    first = (least - 1) // 6 * 6 + 1
    return f"{first:02d}-{first + 5:02d}"


def flatten_distinct(lists: Column) -> Column:
    return F.array_distinct(F.flatten(lists))


def ordered_distinct(df: DataFrame, column: str, order: str) -> DataFrame:
    """The different values of a column with their first appearance, in the order of it."""
    firsts = df.groupBy(column).agg(F.min(order).alias("first"))
    return firsts.orderBy("first", column).select(column, "first")

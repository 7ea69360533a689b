"""Time-bucket aggregates, group-wise transforms and the hour functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsengine.operators.domain import KEYS

NAMED = {"min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum, "median": F.median, "count": F.count, "std": F.stddev_samp, "var": F.var_samp}


class ConfigurationError(ValueError):
    """Arguments that contradict each other."""


def bucket(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def _named(spec: dict[str, list], variables=None) -> list[Column]:
    if variables:
        raise ConfigurationError("give either variables or aggregates by variable, not both")
    out = []
    for variable, wanted in spec.items():
        for how in wanted:
            f = NAMED[how] if isinstance(how, str) else how
            out.append(f(F.col(variable)).alias(f"{variable}_{how if isinstance(how, str) else how.__name__}"))
    return out


def aggregate(df: DataFrame, unit: str, spec: dict[str, list], variables=None, keys: tuple[str, ...] = ("location",)) -> DataFrame:
    """One row per key and bucket; spec: variable -> names or functions of a column. Columns are named variable_aggregate."""
    return df.groupBy(*keys, bucket(F.col("date_time"), unit).alias("date_time")).agg(*_named(spec, variables))


def transform(df: DataFrame, unit: str, spec: dict[str, list], keys: tuple[str, ...] = ("location",)) -> DataFrame:
    """Every row with its bucket's aggregates."""
    w = Window.partitionBy(*keys, bucket(F.col("date_time"), unit))
    out = df
    for variable, wanted in spec.items():
        for how in wanted:
            f = NAMED[how] if isinstance(how, str) else how
            out = out.withColumn(f"{variable}_{how if isinstance(how, str) else how.__name__}", f(F.col(variable)).over(w))
    return out


def max_index_difference(df: DataFrame, value: str, unit: str, name: str, absolute: bool = False) -> DataFrame:
    """The bucket's maximum less the row's place in the bucket."""
    w = Window.partitionBy("location", bucket(F.col("date_time"), unit))
    out = F.max(value).over(w) - (F.row_number().over(w.orderBy("date_time")) - 1)
    return df.withColumn(name, F.abs(out) if absolute else out)


def resample_mean(df: DataFrame, domain: DataFrame, unit: str, value: str) -> DataFrame:
    """Bucket means at the domain's buckets, null where nothing was read."""
    means = df.groupBy("location", bucket(F.col("date_time"), unit).alias("date_time")).agg(F.avg(value).alias(value))
    return domain.join(means, KEYS, "left").select(*KEYS, value)


def impute_sum(v: Column, expected: int | None = None, fill: float | None = None) -> Column:
    """The mean of what is there times the number expected (or the group's size); fill where nothing is."""
    out = F.avg(v) * (F.lit(expected) if expected is not None else F.count(F.lit(1)))
    return F.coalesce(out, F.lit(fill)) if fill is not None else out


def first_mode(df: DataFrame, value: str, keys: list[str], order: str = "date_time", name: str = "mode") -> DataFrame:
    """The most frequent value per group; of equally frequent ones the first seen, of those seen at once the smallest. Two levels, so that no group is collected."""
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("__n"), F.min(order).alias("__first"))
    best = F.min_by(value, F.struct(-F.col("__n"), F.col("__first"), F.col(value)))
    return counts.groupBy(*keys).agg(best.alias(name))


def group_hours(hours: list[int], v: Column, how) -> Column:
    """An aggregate over the rows of some hours of the day."""
    f = NAMED[how] if isinstance(how, str) else how
    return f(F.when(F.hour("date_time").isin(list(hours)), v))


def hour_change(first: int, second: int, v: Column) -> Column:
    """Value at the second hour less that at the first."""
    at = lambda h: F.max(F.when(F.hour("date_time") == h, v))
    return at(second) - at(first)


def _day(v: str) -> Column:
    """A day's values in order: at most a day of rows."""
    return F.transform(F.array_sort(F.collect_list(F.struct("date_time", v))), lambda x: x[v])


def _at(values: Column, hour: int) -> Column:
    """Days of 23, 24 or 25 hours shift by -1, 0 or 1; any other number of values is null, and so is a place before the first."""
    offset = F.when(F.size(values).between(23, 25), F.size(values) - 24)
    return F.when(hour + offset >= 0, F.get(values, (hour + offset).cast("int")))


def hour_pick(v: str, hour: int) -> Column:
    return _at(_day(v), hour)


def hour_difference(v: str, start: int, end: int) -> Column:
    return _at(_day(v), start) - _at(_day(v), end)


def hour_sum(v: str, start: int, end: int) -> Column:
    """Sum of the closed range of hours, nulls counting as zero; null on days without 23 to 25 values."""
    values = _day(v)
    known = F.size(values).between(23, 25)
    low = start + F.size(values) - 24
    part = F.filter(values, lambda x, i: i.between(F.greatest(low, F.lit(0)), end + F.size(values) - 24))
    return F.when(known, F.aggregate(part, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))))

"""Calendar and harmonic columns. All are plain column expressions."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ("Friday", "Monday", "Saturday", "Sunday", "Thursday", "Tuesday", "Wednesday")


def part(unit: str, ts: Column) -> Column:
    """A calendar component as a whole number: year ... microsecond, or weekday with Monday as 0."""
    named = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": lambda c: F.second(c), "weekday": F.weekday}
    if unit == "microsecond":
        return (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long") % 1_000_000
    if unit not in named:
        raise ValueError(f"unknown calendar unit {unit!r}")
    return named[unit](ts).cast("long")


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def observed(day: dt.date) -> dt.date:
    return day + dt.timedelta({5: -1, 6: 1}.get(day.weekday(), 0))


def nth_weekday(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th weekday of a month; n = -1 is the last one."""
    if n < 0:
        after = dt.date(year + month // 12, month % 12 + 1, 1)
        return after - dt.timedelta((after.weekday() - weekday - 1) % 7 + 1)
    first = dt.date(year, month, 1)
    return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))


def us_holidays(first_year: int, last_year: int) -> list[dt.date]:
    """US federal holidays with their observed days, by the public rules; Juneteenth from 2021."""
    days = set()
    for y in range(first_year, last_year + 2):
        fixed = [dt.date(y, 1, 1), dt.date(y, 7, 4), dt.date(y, 11, 11), dt.date(y, 12, 25)] + ([dt.date(y, 6, 19)] if y >= 2021 else [])
        floating = [nth_weekday(y, 1, 0, 3), nth_weekday(y, 2, 0, 3), nth_weekday(y, 5, 0, -1), nth_weekday(y, 9, 0, 1), nth_weekday(y, 10, 0, 2), nth_weekday(y, 11, 3, 4)]
        days |= {*fixed, *map(observed, fixed), *floating}
    return sorted(d for d in days if first_year <= d.year <= last_year)


def is_business_day(ts: Column, holidays: list[dt.date]) -> Column:
    """1 from Monday to Friday outside holidays, else 0; a null time is null."""
    day = ts.cast("date")
    return F.when(ts.isNull(), None).when((F.weekday(day) < 5) & ~day.isin(holidays or [dt.date(1, 1, 1)]), 1).otherwise(0).cast("int")


def one_hot(value: Column, categories: list[str], prefix: str) -> list[Column]:
    """One 0/1 column per category, in the given order; a value outside them raises when it is computed."""
    known = value.isin(list(categories))
    bad = F.raise_error(F.concat(F.lit(f"{prefix}: unknown category "), F.coalesce(value.cast("string"), F.lit("null")))).cast("int")
    return [F.when(known, (value == c).cast("int")).otherwise(bad).alias(f"{prefix}__x0_{c}") for c in categories]


def elapsed(ts: Column, zero: str, step_seconds: int) -> Column:
    """Whole steps since zero."""
    return F.floor(F.timestamp_diff("SECOND", F.lit(zero).cast("timestamp_ntz"), ts) / step_seconds).cast("double")


def harmonics(ts: Column, period: float, zero: str = "1970-01-01", step_seconds: int = 3600, compat_truncate: bool = False) -> tuple[Column, Column]:
    """(sin, cos) of the time since zero at a period in steps; compat_truncate rounds the angle's numerator down to whole steps."""
    turned = elapsed(ts, zero, step_seconds) * 2 * math.pi
    if compat_truncate:
        turned = turned.cast("long").cast("double")
    return F.sin(turned / period), F.cos(turned / period)


def month_starts(start: str, end: str, pad_days: int = 2) -> Column:
    """First days of the months that [start - pad, end + pad] touches, as an array."""
    low = F.trunc(F.date_sub(F.lit(start).cast("date"), pad_days), "MM")
    return F.sequence(low, F.date_add(F.lit(end).cast("date"), pad_days), F.expr("INTERVAL 1 MONTH"))

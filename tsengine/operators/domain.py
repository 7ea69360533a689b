"""The regular grid of locations and times that every query is aligned to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
KEYS = ["location", "date_time"]
LONGEST = 36


class DomainError(ValueError):
    """A frame that is not a regular grid, or arguments that can't make one."""


def parse_step(step: str) -> tuple[int, str]:
    """'2 hours' -> (2, 'hour')."""
    words = step.split()
    n, unit = (int(words[0]), words[1]) if len(words) == 2 else (1, words[0])
    unit = unit.lower().rstrip("s")
    if n < 1 or unit not in UNITS:
        raise DomainError(f"no step: {step!r}")
    return n, unit


@dataclass(frozen=True)
class Domain:
    """A closed range of times at a uniform step. Locations come as a list or as a DataFrame with one column."""

    start: str
    end: str
    step: str = "1 hour"

    @property
    def seconds(self) -> int:
        n, unit = parse_step(self.step)
        return n * UNITS[unit]

    def times(self) -> Column:
        n, unit = parse_step(self.step)
        stamp = lambda x: F.lit(x).cast("timestamp_ntz")
        return F.sequence(stamp(self.start), stamp(self.end), F.expr(f"INTERVAL {n} {unit.upper()}"))

    def grid(self, spark: SparkSession, locations) -> DataFrame:
        """(location, date_time): no join, each location is exploded into its times."""
        if not isinstance(locations, DataFrame):
            locations = list(locations)
            if len(set(locations)) != len(locations):
                raise DomainError("a location is given twice")
            if any(len(x) > LONGEST for x in locations):
                raise DomainError(f"a location is longer than {LONGEST} characters")
            locations = spark.createDataFrame([(x,) for x in locations], "location string")
        named = locations.select(F.col(locations.columns[0]).alias("location"))
        return named.select("location", F.explode(self.times()).alias("date_time"))

    def _moved(self, which: str, seconds: int) -> str:
        import datetime as dt

        at = dt.datetime.fromisoformat(getattr(self, which)) + dt.timedelta(seconds=seconds)
        return at.isoformat(sep=" ")

    def shift(self, delta: str | None, extend: bool = False) -> Domain:
        """Both ends back by delta; with extend only the start."""
        if not delta:
            return self
        n, unit = parse_step(delta)
        back = -n * UNITS[unit]
        moved = replace(self, start=self._moved("start", back))
        return moved if extend else replace(moved, end=self._moved("end", back))

    def pad(self, steps: int) -> Domain:
        """Both ends further out, for operations that look at their neighbours."""
        return replace(self, start=self._moved("start", -steps * self.seconds), end=self._moved("end", steps * self.seconds))

    def within(self, ts: Column | str = "date_time") -> Column:
        """Rows inside the closed range; reaches the scan."""
        c = F.col(ts) if isinstance(ts, str) else ts
        return c.between(F.lit(self.start).cast("timestamp_ntz"), F.lit(self.end).cast("timestamp_ntz"))


def with_padding(domain: Domain, steps: int, compute: Callable[[Domain], DataFrame]) -> DataFrame:
    """What compute gives for the domain with room for so many steps on both sides, less the rows of that room.

    Group and rolling operations see their neighbours that way; the padded bounds reach the scan like any others.
    """
    if steps < 0:
        raise DomainError("padding can't be negative")
    return compute(domain.pad(steps)).filter(domain.within())


def months(df: DataFrame, chosen: list[int]) -> DataFrame:
    return df.filter(F.month("date_time").isin(chosen))


def faults(df: DataFrame, step: str) -> DataFrame:
    """(location, fault): what keeps a frame from being a regular grid; no rows if it is one.

    A location's times must be as many as its span has steps, and all at the same distance from the step's multiples.
    """
    n, unit = parse_step(step)
    micros = n * UNITS[unit] * 1_000_000
    elapsed = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("date_time"))
    phase = F.pmod(elapsed, F.lit(micros))
    per = df.groupBy("location").agg(
        F.count("*").alias("n"), F.count_distinct("date_time").alias("kinds"), F.min("date_time").alias("low"), F.max("date_time").alias("high"), (F.max(elapsed) - F.min(elapsed)).alias("span"),
        (F.max(phase) - F.min(phase)).alias("off"), F.count_if(F.col("date_time").isNull()).alias("nulls"),
    )
    whole = per.agg(F.min("low").alias("all_low"), F.max("high").alias("all_high"))
    fault = (
        F.when(F.col("location").isNull(), "null location")
        .when(F.length("location") > LONGEST, "location too long")
        .when(F.col("nulls") > 0, "null time")
        .when(F.col("n") != F.col("kinds"), "repeated time")
        .when((F.col("span") != (F.col("n") - 1) * micros) | (F.col("off") != 0), "irregular step")
        .when((F.col("low") != F.col("all_low")) | (F.col("high") != F.col("all_high")), "other range than the rest")
    )
    return per.join(F.broadcast(whole)).select("location", fault.alias("fault")).filter("fault IS NOT NULL")  # whole is one row


def validate(df: DataFrame, step: str) -> DataFrame:
    found = faults(df, step).limit(5).collect()
    if found:
        raise DomainError("; ".join(f"{r.location}: {r.fault}" for r in found))
    return df

"""Feature blocks of a forecast, as one pass over the extended domain."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.functions import calendar as cal
from tsengine.operators import align, windows
from tsengine.operators.domain import KEYS, Domain, parse_step, UNITS


@dataclass(frozen=True)
class FeatureSpec:
    """What to compute; names of the features follow from it."""

    label: str = "value"
    lags: tuple[str, ...] = ()
    weather: tuple[str, ...] = ()
    day_of_week: bool = False
    business_day: bool = False
    harmonics: tuple[float, ...] = ()
    locations: tuple[str, ...] = ()
    zero: str = "1970-01-01"
    compat_truncate: bool = False
    first_year: int = 1990
    last_year: int = 2050

    def names(self) -> list[str]:
        lags = [f"lag_{n}_{u}" for n, u in map(parse_step, self.lags)]
        days = [f"day_of_week__x0_{d}" for d in cal.DAYS] if self.day_of_week else []
        waves = [f"harmonic_{p:g}_{f}" for p in self.harmonics for f in ("sin", "cos")]
        return [*lags, *self.weather, *days, *(["is_business_day"] if self.business_day else []), *waves, *(f"location__x0_{x}" for x in self.locations)]

    def extended(self, domain: Domain) -> Domain:
        """The domain with room for the longest lag in front."""
        if not self.lags:
            return domain
        longest = max((parse_step(x) for x in self.lags), key=lambda s: s[0] * UNITS[s[1]])
        return domain.shift(f"{longest[0]} {longest[1]}", extend=True)

    def build(self, spark: SparkSession, domain: Domain, locations, source: DataFrame, weather: DataFrame | None = None) -> DataFrame:
        """(location, date_time, features ..., label) on the domain: label and lags share one read of the source and one aggregation by place and time."""
        read, lags = source.filter(self.extended(domain).within()), self.names()[: len(self.lags)]
        if self.lags:
            read = windows.lag_rows(read, self.label, list(self.lags), domain)
        df = align.select(domain.grid(spark, locations), read, [self.label, *lags])
        if self.weather:
            df = df.join(weather.filter(domain.within()).select(*KEYS, *self.weather), KEYS, "left")
        ts = F.col("date_time")
        out = [*KEYS, *lags, *self.weather]
        if self.day_of_week:
            out += cal.one_hot(cal.day_name(ts), list(cal.DAYS), "day_of_week")
        if self.business_day:
            out.append(cal.is_business_day(ts, cal.us_holidays(self.first_year, self.last_year)).alias("is_business_day"))
        unit = min(domain.seconds, 3600)  # periods are hours, whatever the step
        for p in self.harmonics:
            s, c = cal.harmonics(ts, p * 3600 / unit, self.zero, unit, self.compat_truncate)
            out += [s.alias(f"harmonic_{p:g}_sin"), c.alias(f"harmonic_{p:g}_cos")]
        if self.locations:
            out += cal.one_hot(F.col("location"), list(self.locations), "location")
        return df.select(*out, self.label)


def meter_hourly(lags: tuple[str, ...] = ("24 hours", "168 hours"), **more) -> FeatureSpec:
    return FeatureSpec(**({"lags": lags, "day_of_week": True, "harmonics": (24.0, 168.0, 8760.0)} | more))


def area_hourly(lags: tuple[str, ...] = ("24 hours", "168 hours"), **more) -> FeatureSpec:
    return FeatureSpec(**({"lags": lags, "business_day": True, "day_of_week": True, "harmonics": (24.0, 168.0, 8760.0)} | more))


def example(locations: tuple[str, ...]) -> FeatureSpec:
    return FeatureSpec(locations=locations, harmonics=(24.0, 168.0), zero="2000-01-01")


REGISTRY = {"meter_hourly": meter_hourly, "area_hourly": area_hourly, "example": example}

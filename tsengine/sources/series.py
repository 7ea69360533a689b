"""Sources of series: everything becomes (location, date_time, variables ...) with NULL for missing."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.functions.values import nan_to_null, zeros_to_null
from tsengine.operators.domain import KEYS, Domain


def _clean(df: DataFrame, variables: Iterable[str]) -> DataFrame:
    return df.select(*KEYS, *(nan_to_null(F.col(v).cast("double")).alias(v) for v in variables))


def from_table(df: DataFrame, location: str, date_time: str, variables: dict[str, str], domain: Domain | None = None) -> DataFrame:
    """variables: source column -> name. The time bounds are a plain filter, so they reach the scan."""
    if domain:
        df = df.filter(domain.within(date_time))
    named = df.select(F.col(location).cast("string").alias("location"), F.col(date_time).cast("timestamp_ntz").alias("date_time"), *(F.col(c).alias(n) for c, n in variables.items()))
    return _clean(named, variables.values())


def parquet(spark: SparkSession, *paths: str, location: str = "location", date_time: str = "date_time", variables: dict[str, str], domain: Domain | None = None) -> DataFrame:
    return from_table(spark.read.parquet(*paths), location, date_time, variables, domain)


def utc_naive(text: Column) -> Column:
    """A time with an offset as a naive time in UTC (the session's time zone must be UTC)."""
    return F.to_timestamp(text).cast("timestamp_ntz")


def meter_csv(spark: SparkSession, root: str, meters: dict[str, list[str]], units: str = "power (W)", domain: Domain | None = None) -> DataFrame:
    """Meters' gzip CSV files ``root/{meter}_{units}.csv.gz``: first column the time with offset, then values.

    meters: location -> its meters. Result in long form: (location, meter, date_time, value). A missing file gives no rows.
    """
    pairs = [(loc, m) for loc, found in meters.items() for m in found]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = {m: f"{root}/{m}_{units}.csv.gz" for _, m in pairs}
    there = [p for p in path.values() if (q := hadoop.Path(p)).getFileSystem(conf).exists(q)]
    schema = "stamp string, value double"
    rows = spark.read.schema(schema).csv(there, header=True, enforceSchema=True).withColumn("file", F.input_file_name()) if there else spark.createDataFrame([], schema + ", file string")
    meter = F.regexp_extract(F.url_decode(F.regexp_replace("file", r"\+", "%2B")), r"([^/]*)_[^/_]*\.csv\.gz$", 1)
    of = spark.createDataFrame(pairs or [("", "")], "location string, meter string")
    out = rows.select(meter.alias("meter"), utc_naive(F.col("stamp")).alias("date_time"), nan_to_null(F.col("value")).alias("value")).join(of, "meter").select("location", "meter", "date_time", "value")
    return out.filter(domain.within()) if domain else out


def side_by_side(df: DataFrame, meters: list[str]) -> DataFrame:
    """Long meters as columns: the full outer join on time, by one shuffle."""
    return df.groupBy(*KEYS).pivot("meter", meters).agg(F.first("value"))


def balancing_area(df: DataFrame, area: str, variables: list[str], zeros_missing: bool = True, domain: Domain | None = None) -> DataFrame:
    """Hourly published loads (utc_time, variables ...); zeros stand for missing. Workbooks are read by an ingest step to Parquet."""
    named = from_table(df.withColumn("__area", F.lit(area)), "__area", "utc_time", {v: v for v in variables}, domain)
    return named.select(*KEYS, *(zeros_to_null(F.col(v)).alias(v) for v in variables)) if zeros_missing else named


def published_forecast(df: DataFrame, area: str, actual: str = "Adjusted D", forecast: str = "DF") -> DataFrame:
    """(location, date_time, actual, predicted) of a published forecast; rows with an actual of zero are null in both."""
    rows = balancing_area(df, area, [actual, forecast], zeros_missing=False)
    there = F.col(actual) != 0
    return rows.select(*KEYS, F.when(there, F.col(actual)).alias("actual"), F.when(there, F.col(forecast)).alias("predicted"))


def missing(domain: DataFrame, name: str = "value") -> DataFrame:
    return domain.select(*KEYS, F.lit(None).cast("double").alias(name))


def synthetic(domain: DataFrame, scales: dict[str, float], daily: float = 1.0, weekly: float = 1.0, noise: float = 1.0, seed: int = 0) -> DataFrame:
    """A daily and a weekly wave with noise that depends on location, time and seed alone, whatever the partitions."""
    scale = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in scales.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("location")), F.lit(1.0))
    hours = F.timestamp_diff("SECOND", F.lit("2000-01-01").cast("timestamp_ntz"), F.col("date_time")) / 3600
    drawn = lambda i: F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(i)), "location", F.date_format("date_time", "yyyy-MM-dd HH:mm:ss")).cast("binary"))
    uniform = lambda i: (F.conv(F.substring(drawn(i), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    normal = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))
    return domain.select(*KEYS, (scale * (daily * F.sin(2 * math.pi * hours / 24 + math.pi / 3) + weekly * F.cos(2 * math.pi * hours / 168) + noise * normal)).alias("value"))


def months_between(start: str, end: str, pattern: str, pad_days: int = 2) -> list[str]:
    """Paths of the monthly partitions that [start - pad, end + pad] touches; pattern has %Y and %m."""
    import datetime as dt

    day = (dt.datetime.fromisoformat(start) - dt.timedelta(pad_days)).replace(day=1)
    last, out = dt.datetime.fromisoformat(end) + dt.timedelta(pad_days), []
    while day <= last:
        out.append(day.strftime(pattern))
        day = (day + dt.timedelta(32)).replace(day=1)
    return out

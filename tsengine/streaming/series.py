"""Streams of readings: bucket aggregates with late data, and the last observation of each place. Both run on batches too."""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tsengine.operators.domain import UNITS, parse_step


def bucket_stream(df: DataFrame, value: str, bucket: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(location, date_time, n, mean, min, max, sum) per window; rows later than ``late`` are dropped by the watermark."""
    if df.isStreaming:
        df = df.withWatermark("date_time", late)
    window = F.window("date_time", bucket, slide) if slide else F.window("date_time", bucket)
    v = F.col(value)
    return df.groupBy("location", window.alias("w")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum")).select("location", F.col("w.start").alias("date_time"), "n", "mean", "min", "max", "sum")


def sessions(df: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    if df.isStreaming:
        df = df.withWatermark("date_time", late)
    return df.groupBy("location", F.session_window("date_time", gap).alias("w")).agg(F.count("*").alias("n")).select("location", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest(df: DataFrame, value: str) -> DataFrame:
    """The newest observation of each location; as a stream, write it with outputMode('update') or 'complete'."""
    return df.filter(F.col(value).isNotNull()).groupBy("location").agg(F.max(F.struct("date_time", value)).alias("x")).select("location", "x.*")


FILL_STATE = "held binary"


def fill_last(df: DataFrame, value: str, late: str = "2 hours", expire: str = "7 days", name: str = "filled") -> DataFrame:
    """Each row with the last observation of its place at or before its time, as persist_last gives it on a batch.

    Rows wait until the watermark has passed them, since an earlier one may still come; then they are filled in the order of their times and
    leave (outputMode 'append'). Rows that come later than ``late`` are dropped. Of a place the state holds the rows that
    wait and one observation; it is forgotten when no row has come for ``expire`` of event time, so an observation fills no row that is
    further behind it than that. Rows without a place or a time are left out. On a batch it is a window with the same expiry.
    """
    rows = df.filter(F.col("location").isNotNull() & F.col("date_time").isNotNull()).select("location", "date_time", F.col(value).cast("double").alias(value))
    n, unit = parse_step(expire)
    reach = n * UNITS[unit] * 1_000_000
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(df.schema["date_time"].dataType), F.col("date_time"))
    if not df.isStreaming:
        order = Window.partitionBy("location").orderBy("date_time")
        seen = F.last(F.when(F.col(value).isNotNull(), F.struct(micros.alias("at"), F.col(value).alias("v"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn("__seen", seen).withColumn(name, F.when(micros - F.col("__seen.at") <= reach, F.col("__seen.v"))).drop("__seen")

    def step(key, parts, state: GroupState):
        waiting, last = pickle.loads(state.get[0]) if state.exists else ([], None)  # rows (time, value) by time, and the last observation
        for part in parts:
            waiting += [(int(t), None if v != v else float(v)) for t, v in zip(part["__at"], part[value], strict=True)]
        waiting.sort(key=lambda r: r[0])
        mark, out = state.getCurrentWatermarkMs() * 1000, []
        while waiting and waiting[0][0] <= mark:
            t, v = waiting.pop(0)
            last = (t, v) if v is not None else last
            out.append((key[0], t, v, last[1] if last and t - last[0] <= reach else None))
        newest = waiting[-1][0] if waiting else last[0] if last else mark
        if not waiting and (last is None or mark > last[0] + reach):
            state.remove()
        else:
            state.update((pickle.dumps((waiting, last)),))
            state.setTimeoutTimestamp(max((waiting[0][0] if waiting else newest + reach) // 1000 + 1, mark // 1000 + 1))
        yield pd.DataFrame(out, columns=["location", "__at", value, name]).astype({value: "float64", name: "float64"})

    marked = rows.withColumn("__at", micros).withWatermark("date_time", late)
    schema = f"location string, __at long, `{value}` double, `{name}` double"
    filled = marked.groupBy("location").applyInPandasWithState(step, schema, FILL_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    back = (F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("__at").cast("decimal(24,6)") / 1_000_000)).cast(df.schema["date_time"].dataType)
    return filled.select("location", back.alias("date_time"), *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in (value, name)))

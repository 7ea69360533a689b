"""The stateful filler over files that come one after the other, with rows out of order and too late."""

import datetime as dt
import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tsengine.operators import windows
from tsengine.streaming import series

SCHEMA = "location string, date_time timestamp, value double"
START = dt.datetime(2024, 1, 1)


def write(folder, number, rows):
    places, times, values = zip(*rows, strict=True)
    pq.write_table(pa.table({"location": pa.array(places, pa.string()), "date_time": pa.array(times, pa.timestamp("us", tz="UTC")), "value": pa.array(values, pa.float64())}), folder / f"part-{number:03d}.parquet")


def read_stream(spark, folder, tmp_path, **how):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out, at = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    query = series.fill_last(stream, "value", **how).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.read.parquet(out)


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(p, START + dt.timedelta(minutes=10 * i), None if rng.random() < 0.5 else float(i)) for i in range(60) for p in ("a", "b")]
    folder = tmp_path / "in"
    folder.mkdir()
    # Each file holds an hour and a half; some rows come a file later, which is not too late.
    files = [[] for _ in range(8)]
    for i, r in enumerate(rows):
        files[min(7, i // 18 + (rng.random() < 0.3))].append(r)
    for i, some in enumerate(files):
        rng.shuffle(some)
        write(folder, i, some + ([(None, START, 1.0)] if i == 2 else []))
    write(folder, 8, [("late", START, 5.0), ("end", START + dt.timedelta(days=2), None)])  # the first is too late, the second moves the watermark
    got = {(r.location, r.date_time): (r.value, r.filled) for r in read_stream(spark, folder, tmp_path, late="4 hours").collect()}
    batch = spark.createDataFrame(rows, SCHEMA)
    want = {(r.location, r.date_time): (r.value, r.filled) for r in windows.persist_last(batch, "value", "filled").collect()}
    assert got == want
    assert {(r.location, r.date_time): (r.value, r.filled) for r in series.fill_last(batch, "value").collect()} == want


def test_observations_expire(spark, tmp_path):
    hour = lambda h: START + dt.timedelta(hours=h)
    rows = [("a", hour(0), 1.0), ("a", hour(3), None), ("a", hour(30), None), ("a", hour(31), 2.0), ("a", hour(32), None)]
    folder = tmp_path / "in"
    folder.mkdir()
    for i, r in enumerate(rows):
        write(folder, i, [r])
    write(folder, 9, [("end", hour(500), None)])
    got = {r.date_time: r.filled for r in read_stream(spark, folder, tmp_path, late="1 hour", expire="24 hours").filter("location = 'a'").collect()}
    assert got == dict(zip((r[1] for r in rows), (1.0, 1.0, None, 2.0, 2.0), strict=True))
    batch = series.fill_last(spark.createDataFrame(rows, SCHEMA), "value", expire="24 hours")
    assert {r.date_time: r.filled for r in batch.collect()} == got and batch.filter(F.col("filled").isNull()).count() == 1

"""Local regression and grouped quantiles against plain versions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsengine.operators import lowess, monitor


def plain_lowess(x, y, k, robust):
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    n, k = len(x), min(k, len(x))
    b, t = np.ones(n), np.zeros(n)
    for r in range(robust + 1):
        for i in range(n):
            a = 0
            while a + k < n and x[a + k] - x[i] < x[i] - x[a]:
                a += 1
            a = min(max(a, i - k + 1), i)
            d = x[a : a + k] - x[i]
            h = np.abs(d).max()
            near = (1 - (np.abs(d) / (h or 1)) ** 3) ** 3
            w = near * b[a : a + k]
            w = w if w.sum() > 0 else near
            if h == 0 or (w > 0).sum() == 1:
                t[i] = np.average(y[a : a + k], weights=w)
            else:
                m, l = np.average(d, weights=w), np.average(y[a : a + k], weights=w)
                s = (w * (d - m) ** 2).sum()
                t[i] = l - m * ((w * (d - m) * y[a : a + k]).sum() / s if s > 0 else 0)
        e = np.abs(y - t)
        s = np.median(e)
        share = e / (6 * s) if s > 0 else (e > 0).astype(float)
        b = np.where(share < 1, (1 - share**2) ** 2, 0)
    out = np.empty(n)
    out[order] = t
    return out


@pytest.mark.parametrize("k, robust, ties", [(7, 0, False), (12, 2, False), (9, 1, True), (2, 1, False), (1000, 1, False)])
def test_lowess(spark, monkeypatch, k, robust, ties):
    monkeypatch.setattr(lowess, "SEGMENT", 50)
    rng = np.random.default_rng(k)
    rows, want = [], {}
    for place, n in (("hot", 400), ("b", 30), (None, 12), ("one", 1)):
        x = rng.integers(0, 12, n).astype(float) if ties else np.round(rng.normal(0, 5, n), 6)
        y = np.sin(x) + rng.normal(0, 0.2, n) + 5 * (rng.random(n) < 0.05)
        want |= {(place, i): t for i, t in enumerate(plain_lowess(x, y, k, robust))}
        rows += [(place, i, float(a), float(v), "keep") for i, (a, v) in enumerate(zip(x, y, strict=True))]
    rows += [("hot", -1, None, 1.0, "keep"), ("hot", -2, 1.0, None, "keep"), ("hot", -3, float("nan"), 1.0, "keep")]
    df = spark.createDataFrame(rows, "location string, i int, x double, y double, trend string").repartition(5)
    got = {(r.location, r.i): r.smooth for r in lowess.lowess(df, "x", "y", k, robust, ["location"], "smooth", ranges=6).collect()}
    assert len(got) == len(rows) and all(got["hot", i] is None for i in (-1, -2, -3))
    assert all(got[key] == pytest.approx(t, abs=1e-7) for key, t in want.items())


def test_lowess_along_times_without_groups(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 2.0 * i + 1) for i in range(60)]
    df = spark.createDataFrame(rows, "date_time timestamp_ntz, value double")
    assert all(r.trend == pytest.approx(r.value) for r in lowess.lowess(df, "date_time", "value", 10, 1).collect())
    assert lowess.lowess(df.limit(0), "date_time", "value", 10, 1).collect() == []


def test_no_task_holds_a_group(spark, monkeypatch):
    monkeypatch.setattr(lowess, "SEGMENT", 100)
    largest = spark.sparkContext.accumulator(0)
    inner = lowess.local_lines

    def seen(x, *rest):
        largest.add(int(len(x) > 200))
        return inner(x, *rest)

    monkeypatch.setattr(lowess, "local_lines", seen)
    df = spark.range(3000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("x"), F.rand(3).alias("y"))
    assert lowess.lowess(df, "x", "y", 20, 1, ["g"]).count() == 3000 and largest.value == 0


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_grouped_quantiles(spark, ranges):
    rng = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in np.round(rng.exponential(3, 700), 1)] + [("b", float(v)) for v in rng.normal(50, 1, 9)] + [("c", 1.0), (None, 2.0), (None, 4.0), ("void", None), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r[1:] for r in monitor.grouped_quantiles(df, "v", ["g"], wanted, ranges).collect()}
    assert set(got) == {"hot", "b", "c", None}
    for g, found in got.items():
        assert list(found) == pytest.approx(list(np.quantile([v for k, v in rows if k == g and v == v], wanted)))
    assert list(monitor.grouped_quantiles(df, "v", [], [0.5], ranges).first()) == pytest.approx([np.median([v for _, v in rows if v is not None and v == v])])


def test_range_stats_by_ranges(spark):
    rows = [("a", dt.datetime(2024, 1, 1, h), None if h == 3 else float(h * h)) for h in range(20)] + [("b", dt.datetime(2024, 1, 2), None), (None, dt.datetime(2024, 1, 2), 5.0)]
    df = spark.createDataFrame(rows, "location string, date_time timestamp_ntz, value double")
    plain, spread = (sorted(map(str, monitor.range_stats(df, "value", "2024-02-01 00:00:00", r).select("location", "n_stats", "mean", "q_25", "q_75", "freshness").collect())) for r in (None, 5))
    assert plain == spread


def test_medians_of_metrics_by_ranges(spark):
    from tsengine.operators import metrics

    rng = np.random.default_rng(6)
    rows = [(g, float(a), float(b)) for g, n in (("hot", 300), (None, 7), ("one", 1)) for a, b in rng.normal(5, 2, (n, 2))] + [("hot", None, 1.0), ("hot", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, true double, predicted double")
    for by in (["g"], None):
        plain, spread = (sorted((str({k: v for k, v in r.asDict().items() if k != "median_absolute_error"}), r.median_absolute_error) for r in metrics.scored(df, by=by, ranges=n).collect()) for n in (None, 5))
        assert [p[0] for p in plain] == [s[0] for s in spread] and [p[1] for p in plain] == pytest.approx([s[1] for s in spread])

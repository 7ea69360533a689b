"""Expected values of small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tsengine import config
from tsengine.functions import calendar as cal
from tsengine.functions import values
from tsengine.operators import aggregates as agg
from tsengine.operators import align, backtest, gaps, metrics, models, monitor, windows
from tsengine.operators.domain import Domain, DomainError, validate
from tsengine.operators.pv import System

GAPS = {
    "a": (1, 2, None, None), "b": (2, None, None, 8), "c": (None, None, 10, 20), "d": (None, 4, 3, 2),
    "e": (2, 4, None, 8), "f": (3, 5, 7, None), "g": (None, 2, None, 4), "h": (0, None, 2, None),
}


def frame(spark, columns):
    rows = [(k, dt.datetime(2021, 5, 17, i), None if x is None else float(x)) for k, v in columns.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "location string, date_time timestamp_ntz, value double")


def read(df, column="value"):
    out = {}
    for r in df.orderBy("location", "date_time").collect():
        out.setdefault(r.location, []).append(r[column])
    return {k: tuple(v) for k, v in out.items()}


def test_domain(spark):
    d = Domain("2021-05-17", "2021-05-28", "6 hours")
    assert d.grid(spark, ["x", "y"]).count() == 90
    validate(d.grid(spark, ["x", "y"]), "6 hours")
    with pytest.raises(DomainError):
        d.grid(spark, ["x", "x"])
    with pytest.raises(DomainError):
        d.grid(spark, ["x" * 37])
    with pytest.raises(DomainError):
        validate(d.grid(spark, ["x"]).filter("hour(date_time) <> 6"), "6 hours")
    back = d.shift("2 days")
    assert back.start.startswith("2021-05-15") and back.end.startswith("2021-05-26")
    assert d.shift("2 days", extend=True).end == d.end


@pytest.mark.parametrize(
    "trailing, leading, wanted",
    [
        (False, False, {"a": (1, 2, None, None), "b": (2, 4, 6, 8), "c": (None, None, 10, 20), "g": (None, 2, 3, 4), "h": (0, 1, 2, None)}),
        (True, False, {"a": (1, 2, 2, 2), "c": (None, None, 10, 20), "f": (3, 5, 7, 7), "h": (0, 1, 2, 2)}),
        (True, True, {"c": (10, 10, 10, 20), "d": (4, 4, 3, 2), "g": (2, 2, 3, 4)}),
    ],
)
def test_interpolation(spark, trailing, leading, wanted):
    got = read(windows.interpolate(frame(spark, GAPS), "value", trailing=trailing, leading=leading))
    assert {k: got[k] for k in wanted} == wanted


def test_blocks_are_the_whole_series(spark):
    """Gaps longer than blocks, blocks without an observation, and series that begin or end with nothing."""
    values = {"a": (None, None, 1, None, None, None, None, None, None, 8, None), "b": (4, *(None,) * 10), "c": (None,) * 11, "d": tuple(range(11))}
    df = frame(spark, values)
    for trailing, leading in ((False, False), (True, False), (True, True)):
        whole = read(windows.interpolate(df, "value", trailing=trailing, leading=leading))
        assert whole == read(windows.interpolate(df, "value", trailing=trailing, leading=leading, block="3 hours"))
    assert read(windows.persist_last(df, "value")) == read(windows.persist_last(df, "value", block="2 hours"))


def test_singletons_and_persistence(spark):
    got = read(windows.backfill_singleton(frame(spark, GAPS), "value"))
    assert got["d"] == (4, 4, 3, 2) and got["e"] == (2, 4, 6, 8) and got["b"] == (2, None, None, 8) and got["f"] == (3, 5, 7, None)
    native = read(windows.persist_last(frame(spark, GAPS), "value"))
    last = lambda s: s.dropna().iloc[-1] if s.notna().any() else float("nan")
    assert native == read(windows.fill_rolling(frame(spark, GAPS), "value", last, 2))
    assert native["b"] == (2, 2, 2, 8) and native["c"] == (None, None, 10, 20)


def test_convolution_and_ranks(spark):
    got = read(windows.convolve(frame(spark, {"x": (1, 2, 3, 4)}), "value", [1.0, 0.0, -1.0]), "convolved")
    assert got == {"x": (2.0, 2.0)}
    labels = read(windows.rank_labels(frame(spark, {"x": (1, None, 3, 3)}), "value", ["1", "2", "3", "4"], ["location"]), "label")
    assert labels == {"x": ("3", "4", "1", "2")}


def test_mode_and_impute_sum(spark):
    df = frame(spark, {"ties": (5, 9, None, 7, 3, None), "twice": (2, 6, 6, None, 1, 0), "nothing": (None,) * 6, "late": (None, None, 8, 2, 2, 8)})
    modes = {r.location: r.mode for r in agg.first_mode(df.filter("value IS NOT NULL"), "value", ["location"]).collect()}
    assert modes == {"ties": 5, "twice": 6, "late": 8}  # of equally frequent values the first seen
    sums = {r.location: (r.s, r.f) for r in df.groupBy("location").agg(agg.impute_sum(F.col("value")).alias("s"), agg.impute_sum(F.col("value"), fill=7.5).alias("f")).collect()}
    assert sums["ties"][0] == 36 and sums["twice"][0] == pytest.approx(18) and sums["late"] == (30, 30) and sums["nothing"] == (None, 7.5)


def test_mode_of_values_seen_at_once(spark):
    rows = [(str(i), dt.datetime(2024, 1, 1), float((i + 3 * k) % 7)) for i in range(20) for k in range(5)]
    modes = {r.location: r.mode for r in agg.first_mode(spark.createDataFrame(rows, "location string, date_time timestamp_ntz, value double"), "value", ["location"]).collect()}
    assert modes == {str(i): min(v for p, _, v in rows if p == str(i)) for i in range(20)}


def test_hour_functions_on_short_days(spark):
    df = frame(spark, {"x": range(23)})
    r = df.groupBy("location").agg(agg.hour_pick("value", 5).alias("a"), agg.hour_pick("value", 0).alias("b"), agg.hour_sum("value", 1, 2).alias("c")).first()
    assert (r.a, r.b, r.c) == (4.0, None, 1.0)


def test_lags(spark):
    d = Domain("2021-05-17 00:00:00", "2021-05-17 03:00:00")
    df = frame(spark, {"x": (0, 1, 2, 3), "y": (10, 11, 12, 13)})
    got = df.select("location", "date_time", *windows.lag_columns("value", ["1 hour", "2 hours"], d))
    assert read(got, "lag_1_hour") == {"x": (None, 0, 1, 2), "y": (None, 10, 11, 12)}
    with pytest.raises(ValueError):
        windows.lag_columns("value", [], d)


def test_rollup_keeps_null_only_where_all_are(spark):
    series = frame(spark, {"one": (1, None), "two": (2, None), "three": (5, 6)})
    tree = spark.createDataFrame([("a", "one"), ("a", "two"), ("b", "three")], "parent string, child string")
    assert read(align.rollup(tree, series, ["value"])) == {"a": (3.0, None), "b": (5.0, 6.0)}


def test_nearest_cells_far_away(spark):
    cells = spark.createDataFrame([(0, 0, 10.0, 20.0), (0, 1, 10.0, 21.0)], "y int, x int, latitude double, longitude double")
    sites = spark.createDataFrame([("near", 10.1, 20.9), ("far", 60.0, 100.0), ("none", None, 1.0)], "location string, latitude double, longitude double")
    assert {r.location: (r.y, r.x) for r in align.nearest_cells(sites, cells).collect()} == {"near": (0, 1), "far": (0, 1)}


def test_calendar():
    days = cal.us_holidays(2021, 2021)
    assert dt.date(2021, 7, 5) in days and dt.date(2021, 11, 25) in days and dt.date(2021, 6, 18) in days
    assert cal.nth_weekday(2021, 5, 0, -1) == dt.date(2021, 5, 31)


def test_monitor(spark):
    df = frame(spark, {"x": (1, None, 3, None)})
    r = monitor.feature_stats(df, ["value"]).first()
    assert (r.n_obs, r.n_missing, r.n_trailing_missing, r["min"], r.q_0_25) == (4, 2, 1, 1.0, 1.5)


def test_gaps(spark):
    df = frame(spark, {"x": range(24), "y": range(24)})
    assert gaps.random_gaps(df, "value", n=5).filter("synth_gap").groupBy("location").count().filter("count = 5").count() == 2
    marked = read(gaps.block_gaps(df, "value", 3, n=2), "synth_gap")
    for flags in marked.values():
        runs = "".join("x" if f else "." for f in flags).split(".")
        assert [len(x) for x in runs if x] == [3, 3] and not flags[0] and not flags[-1]
    with pytest.raises(ValueError):
        gaps.random_gaps(df, "value", n=1, fraction=0.5)


def test_folds():
    folds = backtest.rolling_folds(Domain("2021-01-01 00:00:00", "2021-01-10 00:00:00", "1 day"), 3, test_size=2)
    assert [(f.train_end[8:10], f.test_start[8:10], f.test_end[8:10]) for f in folds] == [("04", "05", "06"), ("06", "07", "08"), ("08", "09", "10")]


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (None, 1.0)], "true double, predicted double")
    r = metrics.scored(df).first()
    assert (r.n, r.mean_absolute_error, r.max_error, r.r2) == (2, 0.5, 1.0, 0.5)
    b = metrics.binary(spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "true int, predicted int")).first()
    assert (b.accuracy, b.recall, b.precision) == (0.75, 0.5, 1.0)


def test_feature_score(spark):
    present = {"a": F.lit(0.0), "b": F.lit(1.0), "c": F.lit(1.0)}
    score = models.feature_score(present, {"a": F.lit(12.0), "b": F.lit(2.0), "c": F.lit(5.0)})
    assert spark.range(1).select(score.alias("s")).first().s == pytest.approx(0.368421, abs=1e-6)


def test_model_is_saved_and_read(spark, tmp_path):
    df = spark.createDataFrame([("x", dt.datetime(2021, 1, 1, i), float(i), 2.0 * i + 1) for i in range(12)], "location string, date_time timestamp_ntz, f double, value double")
    model = models.TimeSeriesModel(["f"]).fit(df)
    model.save(str(tmp_path / "m"))
    again = models.TimeSeriesModel.load(spark, str(tmp_path / "m"))
    assert read(again.predict(df), "predicted")["x"][5] == pytest.approx(11.0)


def test_config():
    value = {"a": dt.timedelta(hours=3), "b": System(tilt=10.0), "c": config.hour_function("hour_pick", 6)}
    assert config.decode(config.encode(value)) == value
    with pytest.raises(ValueError):
        config.decode('{"$type": "other"}')


def test_horizon():
    assert values.horizon_from_lags([24, 168]) == "19-24" and values.horizon_from_lags([7]) == "07"

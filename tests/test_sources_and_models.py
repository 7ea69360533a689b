"""Sources from files, streams, saved models and estimators, on small cases with known results."""

import datetime as dt
import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsengine.functions import calendar as cal
from tsengine.functions import values
from tsengine.operators import aggregates as agg
from tsengine.operators import align, backtest, features, filters, gaps, metrics, models, monitor, pv
from tsengine.operators.domain import Domain, DomainError, with_padding
from tsengine.sources import series
from tsengine.streaming import series as streams

START = dt.datetime(2021, 5, 17)


def hourly(spark, columns, start=START):
    rows = [(k, start + dt.timedelta(hours=i), None if x is None else float(x)) for k, v in columns.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "location string, date_time timestamp_ntz, value double")


# ---- sources ---------------------------------------------------------------------------------------------------------
def test_meter_files(spark, tmp_path):
    def put(meter, rows):
        with gzip.open(tmp_path / f"{meter}_power (W).csv.gz", "wt") as f:
            f.write("time,value\n" + "".join(f"{t},{v}\n" for t, v in rows))

    put("m 1", [("2021-05-17T02:00:00+02:00", 1.5), ("2021-05-17T03:00:00+02:00", ""), ("2021-05-17T04:00:00+02:00", "NaN")])
    put("m_2", [("2021-05-16T19:00:00-05:00", 7), ("2021-06-01T00:00:00Z", 8)])
    got = series.meter_csv(spark, str(tmp_path), {"home": ["m 1", "m_2"], "away": ["none"]}, domain=Domain("2021-05-17 00:00:00", "2021-05-18 00:00:00"))
    assert {(r.location, r.meter, r.date_time.hour, r.value) for r in got.collect()} == {("home", "m 1", 0, 1.5), ("home", "m 1", 1, None), ("home", "m 1", 2, None), ("home", "m_2", 0, 7.0)}
    wide = series.side_by_side(got, ["m 1", "m_2"]).orderBy("date_time").collect()
    assert [(r["m 1"], r["m_2"]) for r in wide] == [(1.5, 7.0), (None, None), (None, None)]
    assert series.meter_csv(spark, str(tmp_path), {"away": ["none"]}).count() == 0


def test_monthly_partitions(spark, tmp_path):
    paths = series.months_between("2021-01-31 00:00:00", "2021-03-30 00:00:00", f"{tmp_path}/w_%Y_%m")
    assert [p[-7:] for p in paths] == ["2021_01", "2021_02", "2021_03", "2021_04"]
    for i, p in enumerate(paths):
        spark.createDataFrame([("a", dt.datetime(2021, i + 1, 3), float(i), float("nan"))], "site string, at timestamp_ntz, t double, u double").write.parquet(p)
    got = series.parquet(spark, *paths, location="site", date_time="at", variables={"t": "temperature", "u": "wind"}, domain=Domain("2021-02-01 00:00:00", "2021-04-01 00:00:00"))
    assert [(r.location, r.temperature, r.wind) for r in got.orderBy("date_time").collect()] == [("a", 1.0, None), ("a", 2.0, None)]
    assert "PushedFilters: [IsNotNull(at)" in got._jdf.queryExecution().toString() and [str(x)[:10] for x in spark.range(1).select(cal.month_starts("2021-01-31", "2021-03-30").alias("m")).first().m][-1] == "2021-04-01"


def test_synthetic_noise_depends_on_place_time_and_seed(spark):
    grid = Domain("2021-05-17 00:00:00", "2021-06-17 00:00:00").grid(spark, ["a", "b"])
    one = {(r.location, r.date_time): r.value for r in series.synthetic(grid.repartition(1), {"a": 2.0}, seed=3).collect()}
    again = {(r.location, r.date_time): r.value for r in series.synthetic(grid.repartition(5), {"a": 2.0}, seed=3).collect()}
    other = {(r.location, r.date_time): r.value for r in series.synthetic(grid, {"a": 2.0}, seed=4).collect()}
    assert one == again and one != other
    noise = [v - other[k] for k, v in one.items() if k[0] == "b"]
    assert np.mean(noise) == pytest.approx(0, abs=0.2) and np.std(noise) == pytest.approx(2**0.5, abs=0.15)


# ---- streams ---------------------------------------------------------------------------------------------------------
def test_stream_of_files_with_late_rows(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    batches = [
        [("a", "2021-05-17 00:10:00", 1.0), ("a", "2021-05-17 00:50:00", 3.0), ("b", "2021-05-17 00:20:00", 5.0)],
        [("a", "2021-05-17 06:00:00", 7.0), ("a", "2021-05-17 05:30:00", 2.0)],
        [("a", "2021-05-17 00:30:00", 100.0), ("b", "2021-05-17 12:00:00", 1.0)],  # the first is later than the watermark allows
        [("b", "2021-05-17 20:00:00", 1.0)],
    ]
    stream = spark.readStream.schema("location string, date_time timestamp, value double").option("maxFilesPerTrigger", 1).json(str(source))
    for i, rows in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(json.dumps({"location": a, "date_time": t, "value": v}) for a, t, v in rows))
        buckets = streams.bucket_stream(stream, "value", "1 hour", late="2 hours")
        query = buckets.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(out))
        query.awaitTermination(120)
    got = {(r.location, r.date_time.hour): (r.n, r["sum"]) for r in spark.read.parquet(str(out)).collect()}
    assert got == {("a", 0): (2, 4.0), ("b", 0): (1, 5.0), ("a", 5): (1, 2.0), ("a", 6): (1, 7.0), ("b", 12): (1, 1.0)}


def test_sessions_and_latest(spark):
    rows = [("a", "2021-05-17 00:00:00", 1.0), ("a", "2021-05-17 00:20:00", 2.0), ("a", "2021-05-17 01:30:00", None), ("b", "2021-05-17 00:00:00", 4.0)]
    df = spark.createDataFrame(rows, "location string, t string, value double").select("location", F.col("t").cast("timestamp").alias("date_time"), "value")
    assert sorted((r.location, r.start.hour, r.n) for r in streams.sessions(df).collect()) == [("a", 0, 2), ("a", 1, 1), ("b", 0, 1)]
    assert sorted((r.location, r.value) for r in streams.latest(df, "value").collect()) == [("a", 2.0), ("b", 4.0)]


# ---- alignment -------------------------------------------------------------------------------------------------------
def test_nearest_cells_against_all_cells(spark):
    rng = np.random.default_rng(2)
    cells = [(int(i), int(i % 7), float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-40, 40, 300), rng.uniform(-60, 60, 300), strict=True))]
    sites = [(f"s{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 80), rng.uniform(-180, 180, 80), strict=True))]
    got = align.nearest_cells(spark.createDataFrame(sites, "location string, latitude double, longitude double"), spark.createDataFrame(cells, "y int, x int, latitude double, longitude double"))
    turn = lambda x: x + 360 if x < 0 else x
    want = {s: min(((a - c) ** 2 + (turn(b) - turn(e)) ** 2, y, x) for y, x, c, e in cells)[1:] for s, a, b in sites}
    assert {r.location: (r.y, r.x) for r in got.collect()} == want


def test_padding(spark):
    some = Domain("2021-05-17 02:00:00", "2021-05-17 03:00:00")
    df = with_padding(some, 2, lambda d: d.grid(spark, ["x"]).withColumn("n", F.count("*").over(__import__("pyspark.sql.window", fromlist=["Window"]).Window.partitionBy("location"))))
    assert [(r.date_time.hour, r.n) for r in df.orderBy("date_time").collect()] == [(2, 6), (3, 6)]
    with pytest.raises(DomainError):
        with_padding(some, -1, lambda d: d.grid(spark, ["x"]))


def test_aggregates_take_names_or_functions_but_not_both_kinds_of_variables(spark):
    def top(v):
        return F.max(v)

    df = hourly(spark, {"x": range(24)})
    assert agg.aggregate(df, "day", {"value": ["min", top]}).first().asDict() == {"location": "x", "date_time": START, "value_min": 0.0, "value_top": 23.0}
    with pytest.raises(agg.ConfigurationError):
        agg.aggregate(df, "day", {"value": ["min"]}, variables=["value"])


# ---- features and processes ------------------------------------------------------------------------------------------
def test_processes_and_their_feature_names(spark):
    waves = [f"harmonic_{p}_{f}" for p in ("24", "168", "8760") for f in ("sin", "cos")]
    days = [f"day_of_week__x0_{d}" for d in cal.DAYS]
    assert features.meter_hourly().names() == ["lag_24_hour", "lag_168_hour", *days, *waves]
    assert features.area_hourly(weather=("t",)).names() == ["lag_24_hour", "lag_168_hour", "t", *days, "is_business_day", *waves]
    assert set(features.REGISTRY) == {"meter_hourly", "area_hourly", "example"}
    domain = Domain("2021-05-17 00:00:00", "2021-05-18 00:00:00")
    source = series.synthetic(Domain("2021-05-01 00:00:00", "2021-05-18 00:00:00").grid(spark, ["a"]), {})
    weather = source.withColumnRenamed("value", "t")
    spec = features.area_hourly(weather=("t",))
    df = spec.build(spark, domain, ["a"], source, weather)
    assert df.columns == ["location", "date_time", *spec.names(), "value"] and df.count() == 25 and df.filter("lag_168_hour IS NULL OR t IS NULL").count() == 0


def test_example_process_explains_half_of_a_noisy_signal(spark):
    """A signal of two waves with noise of the same variance: the published R2 is 0.50."""
    places = ("a", "b", "c")
    spec = features.example(places)
    fit, score = Domain("2021-05-17 00:00:00", "2021-06-30 00:00:00", "2 hours"), Domain("2021-07-01 00:00:00", "2021-07-14 00:00:00", "2 hours")
    build = lambda d: spec.build(spark, d, list(places), series.synthetic(d.grid(spark, list(places)), {}, seed=1))
    waves = [n for n in spec.names() if n.startswith("harmonic")]
    model = models.TimeSeriesModel([*waves, *(f"location__x0_{p}" for p in places)]).fit(build(fit))
    assert model.score(build(score)).first().r2 == pytest.approx(0.50, abs=0.05)


# ---- models ----------------------------------------------------------------------------------------------------------
def lined(spark, n=48, gap=()):
    rows = [("x", START + dt.timedelta(hours=i), None if i in gap else float(i % 7), float(i % 5), 2.0 * (i % 7) - (i % 5) + 1) for i in range(n)]
    return spark.createDataFrame(rows, "location string, date_time timestamp_ntz, f double, g double, value double")


def predicted(df):
    return [r.predicted for r in df.orderBy("date_time").collect()]


def test_every_row_comes_back_once(spark):
    df = lined(spark, gap=(3,))
    twice = df.union(df)
    got = models.TimeSeriesModel(["f", "g"]).fit(df).predict(twice)
    assert got.count() == 96 and got.filter("predicted IS NULL").count() == 2
    assert predicted(models.TimeSeriesModel(["f", "g"], before=[filters.interpolate_linear(["f"])]).fit(df).predict(df))[4] == pytest.approx(2 * 4 - 4 + 1, abs=0.3)


def test_models_are_saved_with_their_filters(spark, tmp_path):
    df = lined(spark, gap=(3,))
    model = models.TimeSeriesModel(["f", "g"], before=[filters.interpolate_extrapolate(["f"]), filters.fill_zero(["g"])], scale_target=True, scale_features=True).fit(df)
    model.save(str(tmp_path / "m"))
    again = models.TimeSeriesModel.load(spark, str(tmp_path / "m"))
    assert again.before == model.before and predicted(again.predict(df)) == pytest.approx(predicted(model.predict(df)))
    with pytest.raises(ValueError):
        models.TimeSeriesModel(["f"], before=[lambda x: x]).fit(df).save(str(tmp_path / "n"))
    tree = spark.createDataFrame([("up", "x")], "parent string, child string")
    models.HierarchyModel(model, tree).save(str(tmp_path / "h"))
    loaded = models.HierarchyModel.load(spark, str(tmp_path / "h"))
    assert [r.location for r in loaded.predict(df).select("location").distinct().collect()] == ["up"] and loaded.metrics(df).first().r2 > 0.9
    assert loaded.predict(df, parents=["none"]).count() == 0 and loaded.features_frame(df).count() == 48


def test_penalised_estimators_against_closed_forms(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    y = 3 * x + rng.normal(size=60)
    df = spark.createDataFrame([("x", START + dt.timedelta(hours=i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "location string, date_time timestamp_ntz, f double, value double")
    cov, var, n = np.cov(x, y, ddof=0)[0, 1], x.var(), len(x)
    slope = lambda e, p: float(models.TimeSeriesModel(["f"], estimator=e, params=p).fit(df).fitted.stages[-1].coefficients[0])
    assert slope("linear", {}) == pytest.approx(cov / var, rel=1e-6)
    assert slope("ridge", {"alpha": 30.0}) == pytest.approx(cov / (var + 30 / n), rel=1e-3)
    assert slope("lasso", {"alpha": 0.5}) == pytest.approx((cov - 0.5) / var, rel=1e-3)
    assert slope("elastic_net", {"alpha": 0.5, "l1_ratio": 0.4}) == pytest.approx((cov - 0.2) / (var + 0.3), rel=1e-3)


def test_trees_and_classifiers(spark):
    df = lined(spark, 240)
    trees = models.TimeSeriesModel(["f", "g"], estimator="boosted_trees", params={"maxIter": 15}, impute=0.0, validation=0.3).fit(df)
    assert trees.score(df).first().r2 > 0.9
    scores = {r.feature_score for r in trees.predict(lined(spark, 12, gap=(3,)), feature_score=True).collect()}
    assert 1.0 in scores and any(0 < s < 1 for s in scores)
    kinds = df.withColumn("value", (F.col("f") > 3).cast("double"))
    for name, params in (("logistic", {}), ("boosted_tree_classifier", {"maxIter": 5}), ("perceptron_classifier", {"layers": [2, 4, 2], "maxIter": 200})):
        got = models.TimeSeriesModel(["f", "g"], estimator=name, params=params).fit(kinds).predict(kinds)
        assert got.filter("predicted = value").count() > 220, name


def test_feature_score_by_coefficients(spark):
    df = lined(spark, 48)
    got = models.TimeSeriesModel(["f", "g"], before=[filters.fill_zero(["f"])]).fit(df).predict(lined(spark, 12, gap=(6,)), feature_score=True).orderBy("date_time").collect()
    # The mean of f is about 2.9, that of g about 2; f is missing before the filter fills it.
    f, g = 2 * abs(0 - got_mean(df, "f")), abs(1 - got_mean(df, "g"))
    assert got[6].feature_score == pytest.approx(g / (f + g), rel=1e-3) and got[5].feature_score == 1.0


def got_mean(df, column):
    return df.agg(F.avg(column)).first()[0]


def test_watched_models_and_ranges(spark):
    df = lined(spark, 24, gap=(3, 23))
    model = models.TimeSeriesModel(["f", "g"], before=[filters.interpolate_extrapolate(["f"])], watch=True).fit(df)
    stats = {k: {r.feature: r for r in v.collect()} for k, v in model.fit_stats.items()}
    assert stats["unfiltered"]["f"].n_missing == 2 and stats["unfiltered"]["f"].n_trailing_missing == 1 and stats["filtered"]["f"].n_missing == 0
    assert model.range(df, "2021-05-18 01:00:00").filter("location = 'all'").first().freshness == 7200
    assert model.features_frame(df, False).filter("f IS NULL").count() == 2 and model.features_frame(df).filter("f IS NULL").count() == 0
    assert model.fit_span == (START, START + dt.timedelta(hours=23))
    watched, seen = monitor.observed(df, ["f"], "seen")
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get["f_present"] == 22 and seen.get["n_obs"] == 24


def test_spread_quantiles_are_quantiles(spark):
    rng = np.random.default_rng(4)
    rows = [("x", START + dt.timedelta(hours=i), float(a), float(b) if i % 3 else None) for i, (a, b) in enumerate(zip(rng.normal(size=301), rng.integers(0, 4, 301), strict=True))]
    df = spark.createDataFrame(rows, "location string, date_time timestamp_ntz, a double, b double").repartition(3)
    names = [f"q_{q}" for q in ("0_05", "0_25", "0_75", "0_95")]
    plain, spread = ({r.feature: [r[n] for n in names] for r in monitor.feature_stats(df, ["a", "b"], ranges=k).collect()} for k in (None, 9))
    assert plain["a"] == pytest.approx(np.quantile([r[2] for r in rows], [0.05, 0.25, 0.75, 0.95]).tolist())
    assert spread == {k: pytest.approx(v) for k, v in plain.items()}
    assert monitor.feature_stats(df.limit(0), ["a"], ranges=4).count() == 0


def test_search_and_selection(spark, tmp_path):
    df = lined(spark, 96).withColumn("noise", F.pmod(F.xxhash64("date_time"), F.lit(7)).cast("double"))
    folds = backtest.rolling_folds(Domain("2021-05-17 00:00:00", "2021-05-20 23:00:00"), 2, test_size=24)
    best = backtest.random_search(df, folds, lambda p: models.TimeSeriesModel(["f", "g"], **p), {"estimator": ["linear"], "impute": [None, 0.0]}, draws=5)
    assert len(best) == 2 and best[0][1] == pytest.approx(1.0)
    assert backtest.select_features(df, folds, lambda f: models.TimeSeriesModel(f), ["noise", "g", "f"], 2) == (["f", "g"], ["noise"])
    trained = backtest.run(df, folds, lambda: models.TimeSeriesModel(["f", "g"]), train_scores=True)
    assert {r.which: r["count"] for r in trained.groupBy("which").count().collect()} == {"test": 48, "train": 48 + 72}
    backtest.save(trained, folds, str(tmp_path / "run"))
    again, same = backtest.load(spark, str(tmp_path / "run"))
    assert same == folds and again.count() == trained.count()
    by_fold = {r.fold: r for r in backtest.grouped_metrics(again.filter("which = 'test'"), "fold").collect()}
    assert by_fold[0].n == 24 and by_fold[0].mae == pytest.approx(0, abs=1e-6) and by_fold[0].mape is None  # some labels are zero


# ---- metrics, gaps, values -------------------------------------------------------------------------------------------
def test_grouped_metrics_of_twelve_rows(spark):
    rows = [(f, p, float(10 + i), float(10 + i + (1 if p == "a" else -2))) for f in (0, 1) for p in ("a", "b") for i in range(3)]
    df = spark.createDataFrame(rows, "fold int, location string, true double, predicted double")
    assert {r.location: (r.n, r.mae, r.rmse, r.median_abs_error) for r in backtest.grouped_metrics(df, "location").collect()} == {"a": (6, 1.0, 1.0, 1.0), "b": (6, 2.0, 2.0, 2.0)}
    assert {(r.location, r.fold): r.mse for r in backtest.grouped_metrics(df, "location-fold").collect()} == {(p, f): x for f in (0, 1) for p, x in (("a", 1.0), ("b", 4.0))}
    r = backtest.grouped_metrics(df.withColumn("predicted", F.when(F.col("fold") == 0, F.col("predicted"))), "fold").filter("fold = 1").first()
    assert (r.n_unpredicted, r.mae) == (6, None)


def test_ranking_by_ranges_is_ranking(spark):
    rng = np.random.default_rng(6)
    q, y = np.round(rng.random(500), 2), rng.random(500) < 0.3
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, q, strict=True)] + [(1, None)], "y int, q double")
    for ranges in (1, 7):
        r = metrics.ranking(df, "y", "q", ranges).first()
        points = {p.score: (p.tp, p.fp, p.fn) for p in metrics.trade_off(df, "y", "q", ranges).collect()}
        assert points == {t: (int(y[q >= t].sum()), int((~y)[q >= t].sum()), int(y[q < t].sum())) for t in set(q.tolist())}
        precision = sum(y[q == t].sum() * y[q >= t].mean() for t in set(q.tolist())) / y.sum()
        order = np.argsort(-q, kind="stable")
        gains = {t: np.mean([1 / np.log2(i + 2) for i in range(500) if q[order[i]] == t]) for t in set(q.tolist())}
        assert r.average_precision == pytest.approx(precision) and r.dcg == pytest.approx(sum(gains[t] for t in q[y].tolist()))
    assert metrics.ranking(df.limit(0), "y", "q").first().dcg is None


def test_gaps_of_several_columns(spark):
    df = hourly(spark, {"x": range(48), "y": range(48)}).withColumn("other", F.col("value") * 2)
    got = gaps.gaps_by_column(df, {"value": {"n": 6}, "other": {"n": 2, "size": 3}})
    rows = got.collect()
    assert sum(r.synth_gap_value for r in rows) == 12 and sum(r.synth_gap_other for r in rows) == 12
    again = gaps.gaps_by_column(df, {"value": {"n": 6}, "other": {"n": 6}})
    assert again.filter("synth_gap_value <> synth_gap_other").count() > 0  # each column draws by itself


def test_pv_systems_from_files_and_another_solver(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"tilt": 10.0, "capacity_kw": 3.0}))
    systems = pv.read_systems(spark, {"home": [str(tmp_path / "a.json")]})
    assert systems == {"home": [pv.System(tilt=10.0, capacity_kw=3.0)]}
    grid = Domain("2021-06-01 12:00:00", "2021-06-01 12:00:00").grid(spark, ["home", "away"])
    weather = grid.select("location", "date_time", *(F.lit(x).alias(n) for n, x in (("dswrf", 700.0), ("vbdsf", 2000.0), ("vddsf", -5.0), ("t", 293.15), ("gust", 2.0))))
    prepared = pv.prepare(weather).first()
    assert (prepared.ghi, prepared.dni, prepared.dhi) == (700.0, 1200.0, 0.0) and prepared.temp_air == pytest.approx(20.0)
    sites = spark.createDataFrame([("home", 45.0, 0.0), ("away", 45.0, 0.0)], "location string, latitude double, longitude double")
    flat = pv.forecast(weather, sites, systems, solver=lambda at, system: at["ghi"] * system["capacity_kw"])
    assert {r.location: r.pv_physics for r in flat.collect()} == {"home": 2100.0, "away": None}
    assert -3000 / 1.15 <= pv.forecast(weather, sites, systems).filter("location = 'home'").first().pv_physics < -1000


def test_small_values(spark):
    df = spark.createDataFrame([(1.0, [["a", "b"], ["b"]]), (0.0, []), (None, None)], "v double, lists array<array<string>>")
    got = df.select(values.zeros_to_null(F.col("v")).alias("z"), values.flatten_distinct(F.col("lists")).alias("f"), values.clamp(F.col("v"), 0.2, 0.5).alias("c")).collect()
    assert [(r.z, r.f, r.c) for r in got] == [(1.0, ["a", "b"], 0.5), (None, [], 0.2), (None, None, None)]
    order = spark.createDataFrame([("b", 2), ("a", 1), ("b", 0), ("c", 3)], "k string, at int")
    assert [r.k for r in values.ordered_distinct(order, "k", "at").collect()] == ["b", "a", "c"]
    bad = spark.createDataFrame([("z",)], "location string").select(*cal.one_hot(F.col("location"), ["a"], "location"))
    with pytest.raises(Exception, match="unknown category z"):
        bad.collect()

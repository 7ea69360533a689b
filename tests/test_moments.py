"""Folds, searches and selections from one pass equal single fits."""

import datetime as dt
import random

import numpy as np
import pytest

from tsengine.operators import backtest, models, moments
from tsengine.operators.domain import Domain

FEATURES = ["a", "b", "c"]
DOMAIN = Domain("2024-01-01 00:00:00", "2024-01-10 23:00:00", "1 hour")


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(3), []
    for place in "pq":
        for i in range(240):
            x = [rng.gauss(1000, 3), rng.gauss(0, 1), rng.gauss(5, 2)]
            y = 0.5 * (x[0] - 1000) + 2 * x[1] + rng.gauss(0, 1) + (i > 150) * 0.3 * x[2]
            if i < 150 and rng.random() < 0.2:
                x[rng.randrange(3)] = None
            out.append((place, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), *x, None if rng.random() < 0.1 else y))
    return spark.createDataFrame(out, "location string, date_time timestamp_ntz, a double, b double, c double, value double").cache()


def plain_fit(held, f, features, alpha):
    some = [r for r in held if f.train_start <= str(r.date_time) <= f.train_end and r.value is not None and all(r[c] is not None for c in features)]
    x, y = np.array([[r[c] for c in features] for r in some]), np.array([r.value for r in some])
    xc = x - x.mean(axis=0)
    beta = np.linalg.solve(xc.T @ xc + alpha * np.eye(len(features)), xc.T @ (y - y.mean()))
    return beta, y.mean() - beta @ x.mean(axis=0), len(some)


@pytest.mark.parametrize("features, alpha", [(["a"], 0.0), (["b", "c"], 0.0), (FEATURES, 0.0), (FEATURES, 25.0)])
def test_folds_equal_single_fits(rows, features, alpha):
    folds = backtest.rolling_folds(DOMAIN, 3, max_train=120, test_size=24)
    held, found = rows.collect(), moments.FoldMoments(rows, folds, FEATURES)
    for f in folds:
        beta, intercept, n = plain_fit(held, f, features, alpha)
        line, score = found.fit(f, features, alpha), found.score(f, features, alpha)
        assert line.n == n and np.allclose(line.coefficients, beta, rtol=1e-9) and line.intercept == pytest.approx(intercept, rel=1e-9)
        test = [r for r in held if f.test_start <= str(r.date_time) <= f.test_end and r.value is not None]
        lost = sum(any(r[c] is None for c in features) for r in test)
        assert (score["n"], score["n_unpredicted"], score["n_train"]) == (len(test), lost, n)
        if lost:
            assert score["r2"] is None
            continue
        e = np.array([r.value - intercept - beta @ [r[c] for c in features] for r in test])
        y = np.array([r.value for r in test])
        assert score["mse"] == pytest.approx((e * e).mean(), rel=1e-8) and score["rmse"] == pytest.approx(np.sqrt((e * e).mean()), rel=1e-8)
        assert score["r2"] == pytest.approx(1 - (e * e).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-9) and score["explained_variance"] == pytest.approx(1 - e.var() / y.var(), abs=1e-9)


def test_run_search_and_selection_equal_a_fit_for_each(rows):
    folds = backtest.rolling_folds(DOMAIN, 2, test_size=30)
    make = lambda some: models.TimeSeriesModel(some)
    single = {(r.fold, r.location, r.date_time): r for r in backtest.run(rows, folds, lambda: make(FEATURES)).collect()}
    several = moments.run(rows, folds, FEATURES).collect()
    assert len(several) == len(single)
    for r in several:
        want = single[r.fold, r.location, r.date_time]
        assert r.true == want.true and (r.predicted is None) == (want.predicted is None) and (r.predicted is None or r.predicted == pytest.approx(want.predicted, rel=1e-6, abs=1e-6))
    found = moments.FoldMoments(rows, folds, FEATURES)
    r2 = {f: backtest.grouped_metrics(backtest.run(rows, folds, lambda f=f: make([f])), "fold").agg({"r2": "avg"}).first()[0] for f in FEATURES}
    assert {f[0]: r for f, _, r in found.search([([f], 0.0) for f in FEATURES])} == {f: pytest.approx(r, abs=1e-6) for f, r in r2.items()}
    assert found.select(2) == backtest.select_features(rows, folds, make, FEATURES, 2)


def test_folds_without_rows_and_constant_features(spark, rows):
    folds = backtest.rolling_folds(DOMAIN, 2, test_size=30)
    empty = moments.scores(rows.limit(0), folds, FEATURES).collect()
    assert [(r.fold, r.n_train, r.n, r.r2) for r in empty] == [(0, 0, 0, None), (1, 0, 0, None)]
    flat = rows.selectExpr("location", "date_time", "1.0 AS a", "b", "b AS c", "value")
    found = moments.FoldMoments(flat, folds, FEATURES)
    line = found.fit(folds[0], FEATURES)
    assert line.coefficients[0] == 0 and line.coefficients[1] == pytest.approx(line.coefficients[2])
    assert found.score(folds[0], FEATURES)["mse"] is None or found.score(folds[0], ["b"])["mse"] == pytest.approx(found.score(folds[0], FEATURES)["mse"])


def test_overlapping_windows(spark, rows):
    """Training windows that end inside of other folds' test windows."""
    folds = [backtest.Fold(0, "2024-01-02 00:00:00", "2024-01-06 00:00:00", "2024-01-07 00:00:00", "2024-01-09 00:00:00"), backtest.Fold(1, "2024-01-02 00:00:00", "2024-01-08 12:00:00", "2024-01-07 12:00:00", "2024-01-10 00:00:00")]
    held, found = rows.collect(), moments.FoldMoments(rows, folds, FEATURES)
    for f in folds:
        beta, _, n = plain_fit(held, f, FEATURES, 0)
        assert found.fit(f, FEATURES).n == n and np.allclose(found.fit(f, FEATURES).coefficients, beta, rtol=1e-9)
        assert found.score(f, FEATURES)["n"] == sum(f.test_start <= str(r.date_time) <= f.test_end and r.value is not None for r in held)

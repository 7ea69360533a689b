"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tsengine.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    return f"{float(x):.4f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    wanted = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in wanted.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_modes_of_halves_and_ties_are_those_of_sql(spark, tmp_path):
    """By day: a half that decides the mode, by either rounding another; then equally frequent values at one time, in either order."""
    days = [(h, h + 0.4, h - 0.3) for h in (0.5, 1.5, 2.5, -2.5, 6.5, 1e9 + 0.5, 0.49999999999999994)] + [[float((i + 3 * k) % 7) for k in range(5)] for i in range(20)]
    made = [f"('a', TIMESTAMP '2024-01-01' + to_days({day}), {v!r}::DOUBLE)" for day, x in enumerate(days) for v in x]
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {', '.join(made)}) x(event_type, ts, value)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = sorted((r.location, r.day, r.mode) for r in catalogue.QUERIES["nanmode"](spark, str(tmp_path)).collect())
    assert len(got) == 27 and got == sorted(con.execute(catalogue.ORACLE_SQL["nanmode"]).fetchall())


def test_model_forecast_is_least_squares_over_its_features(spark):
    import numpy as np

    from tsengine.operators import windows

    spec, df = catalogue._ml_frame(spark, FOLDER)
    names = spec.names()
    read = lambda x: windows.interpolate(x, "lag_24_hour").select("location", "date_time", "value", *names).toPandas()
    rows, some = read(df), read(df.filter("date_time < TIMESTAMP_NTZ '2024-01-25'"))  # the filters see what is fitted on
    matrix = lambda r: np.column_stack([np.ones(len(r)), r[names].astype(float)])
    learned = some[names].notna().all(axis=1) & some["value"].notna()
    beta = np.linalg.lstsq(matrix(some)[learned], some["value"][learned].astype(float), rcond=None)[0]
    whole, x = rows[names].notna().all(axis=1), matrix(rows)
    want = {(p, t): v if ok else None for p, t, v, ok in zip(rows["location"], rows["date_time"], x @ beta, whole, strict=True)}
    got = catalogue.model_forecast(spark, FOLDER).collect()
    assert len(got) == len(want)
    for r in got:
        expected = want[r.location, r.date_time]
        assert (r.predicted is None) == (expected is None) and (expected is None or r.predicted == pytest.approx(expected, rel=1e-4, abs=1e-3))


def test_attributions_of_the_query_add_up(spark):
    for r in catalogue.tree_attributions(spark, FOLDER).limit(500).collect():
        assert r.expected + r.by_hour + r.by_day + r.by_lag_24_hour == pytest.approx(r.predicted, abs=1e-9)

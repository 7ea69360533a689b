"""Recursive fills in pieces, and exclusive draws round by round, against one row after the other."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tsengine.operators import gaps, windows

START = dt.datetime(2024, 1, 1)


def series(seed, n, lost, place="a", runs=True):
    rng, out = random.Random(seed), []
    while len(out) < n:
        out += [None] * rng.randrange(1, 6) if rng.random() < lost else [round(rng.gauss(0, 9), 3) for _ in range(rng.randrange(1, 9) if runs else 1)]
    return [(place, START + dt.timedelta(hours=i), v, i) for i, v in enumerate(out[:n])]


SCHEMA = "location string, date_time timestamp_ntz, value double, extra long"


def plain_fill(rows, method, fit_len):
    import pandas as pd

    v = [float("nan") if r[2] is None else r[2] for r in rows]
    for i in range(1, len(v)):
        if v[i] != v[i]:
            v[i] = method(pd.Series(v[max(0, i - fit_len - 1) : i]))
    return {(r[0], r[1]): None if x != x else x for r, x in zip(rows, v, strict=True)}


@pytest.mark.parametrize("fit_len, lost, block", [(0, 0.3, "1 day"), (2, 0.3, "2 days"), (3, 0.2, "12 hours"), (5, 0.6, "1 day"), (2, 0.3, None), (50, 0.3, "1 day")])
def test_pieces_give_what_whole_series_give(spark, fit_len, lost, block):
    mean = lambda s: float(s.mean() + 0.5 * (s.iloc[-1] if s.iloc[-1] == s.iloc[-1] else 0))
    places = [series(fit_len, 400, lost, "hot"), series(7, 30, lost, "b"), series(8, 5, 1.1, "empty"), [(None, *r[1:]) for r in series(9, 20, lost)]]
    df = spark.createDataFrame([r for p in places for r in p], SCHEMA).repartition(6)
    got = windows.fill_rolling(df, "value", mean, fit_len, "filled", block=block)
    assert got.columns == [*df.columns, "filled"]
    found = {(r.location, r.date_time): r for r in got.collect()}
    want = {k: v for p in places for k, v in plain_fill(p, mean, fit_len).items()}
    assert len(found) == len(want) and {k: r.filled for k, r in found.items()} == {k: pytest.approx(v, nan_ok=True) if v is not None else None for k, v in want.items()}
    assert {(r.location, r.date_time, r.value, r.extra) for r in found.values()} == {r for p in places for r in p}
    same = windows.fill_rolling(df, "value", mean, fit_len, block=block)
    assert same.columns == df.columns and same.filter(F.col("value").isNotNull()).count() == sum(v is not None for v in want.values())


def test_a_long_series_is_many_pieces(spark):
    """One place with all rows: the rows of the largest group that Python sees are few."""
    seen = spark.sparkContext.accumulator(0)
    rows = series(3, 5000, 0.2, "hot")
    df = spark.createDataFrame(rows, SCHEMA)

    def method(s):
        seen.add(1)
        return float(s.mean())

    assert windows.fill_rolling(df, "value", method, 2, block="5 days").count() == 5000
    assert seen.value == sum(r[2] is None for r in rows)


def plain_blocks(rows, size, n, attempts, seed):
    values = [r[2] for r in rows]
    free = [a for a in range(len(rows) - size - 1) if all(v is not None for v in values[a : a + size + 2])]
    for k in range(attempts):
        draw = lambda a: (hashlib.md5(f"{seed + k}|{rows[a][0] or ''}|{rows[a][1]:%Y-%m-%d %H:%M:%S}".encode()).hexdigest(), a)  # noqa: B023, E731
        taken = []
        for a in sorted(free, key=draw):
            if len(taken) < n and all(abs(a - b) > size + 1 for b in taken):
                taken.append(a)
        if len(taken) == n:
            return {a + i for a in taken for i in range(1, size + 1)}
    return None


@pytest.mark.parametrize("size, n, parts", [(1, 5, 1), (3, 4, 5), (3, 4, 1), (6, 2, 3)])
def test_blocks_are_those_drawn_one_after_the_other(spark, monkeypatch, size, n, parts):
    monkeypatch.setattr(gaps, "CHUNK", 32)
    places = [series(1, 400, 0.05, "hot"), series(2, 90, 0.02, "b"), [(None, *r[1:]) for r in series(3, 120, 0.02)]]
    df = spark.createDataFrame([r for p in places for r in p], SCHEMA).repartition(parts)
    got = gaps.block_gaps(df, "value", size, n=n, seed=5, block="4 days")
    assert got.columns == [*df.columns, "synth_gap"]
    marked = {(r.location, r.extra) for r in got.collect() if r.synth_gap}
    assert got.count() == df.count() and marked == {(p[0][0], i) for p in places for i in plain_blocks(p, size, n, 3, 5)}
    for p in places:
        at = sorted(i for loc, i in marked if loc == p[0][0])
        runs = [i for i in at if i - 1 not in at]
        assert len(runs) == n and all(p[i - 1][2] is not None and p[i + size][2] is not None and i + size - 1 in at and i + size not in at for i in runs)


def test_fractions_and_blocks_that_do_not_fit(spark):
    rows = series(4, 200, 0.0, "a")
    df = spark.createDataFrame(rows, SCHEMA)
    marked = gaps.block_gaps(df, "value", 4, fraction=0.1).filter("synth_gap").count()
    assert marked == int(0.1 * 200 / 4) * 4
    assert gaps.block_gaps(df, "value", 4, n=0).filter("synth_gap").count() == 0
    with pytest.raises(Exception, match="don't fit"):
        gaps.block_gaps(df, "value", 4, n=100).collect()
    with pytest.raises(ValueError):
        gaps.block_gaps(df, "value", 4, n=1, fraction=0.1)


def test_long_chains_of_draws(spark, monkeypatch):
    """Orders that rise along the places, which take a round each within reach only."""
    monkeypatch.setattr(gaps, "CHUNK", 16)
    spots = spark.range(60).select(F.lit("k").alias("key"), F.col("id").alias("i"), F.struct(F.format_string("%04d", "id").alias("draw"), F.col("id").alias("i")).alias("order"))
    assert sorted(r.i for r in gaps.independent(spots, 3).collect()) == list(range(0, 60, 3))
    assert gaps.independent(spots.limit(0), 3).count() == 0


@pytest.mark.parametrize("seed, lost", [(1, 0.3), (2, 0.7)])
def test_blocks_give_what_whole_locations_give(spark, seed, lost):
    places = [series(seed, 150, lost, "hot"), series(seed + 5, 40, lost, "b", runs=False), [("lone", START, 1.0, 0)], [("none", START, None, 0)], [(None, *r[1:]) for r in series(seed, 30, lost)]]
    df = spark.createDataFrame([r for p in places for r in p], SCHEMA).repartition(4)
    rows = lambda x: sorted(map(str, x.collect()))
    for block in ("5 hours", "3 days"):
        assert rows(windows.backfill_singleton(df, "value", "v", block=block)) == rows(windows.backfill_singleton(df, "value", "v"))
        assert rows(windows.persist_last(df, "value", "v", block=block)) == rows(windows.persist_last(df, "value", "v"))
        whole, parts = ({(r.location, r.extra): r for r in windows.convolve(df, "value", [0.5, 0.25, 1.0], "v", block=b).collect()} for b in (None, block))
        assert set(whole) == set(parts) and all((r.v is None) == (parts[k].v is None) and (r.v is None or r.v == pytest.approx(parts[k].v)) for k, r in whole.items())


def test_backtests_report_their_folds(spark):
    from tsengine.operators import backtest, models
    from tsengine.operators.domain import Domain

    rows = [("a", START + dt.timedelta(hours=i), float(i % 7), float(i % 7) * 2) for i in range(60)]
    df = spark.createDataFrame(rows, "location string, date_time timestamp_ntz, x double, value double")
    folds, report = backtest.rolling_folds(Domain("2024-01-01 00:00:00", "2024-01-03 11:00:00", "1 hour"), 2, test_size=10), []
    backtest.run(df, folds, lambda: models.TimeSeriesModel(["x"]), report=report)
    got = backtest.report_table(spark, report).collect()
    assert [(r.fold, r.n_train, r.n_test, r.test_start) for r in got] == [(0, 40, 10, folds[0].test_start), (1, 50, 10, folds[1].test_start)] and all(r.fit_seconds > 0 for r in got)

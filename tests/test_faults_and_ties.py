"""Irregular grids, long ties and many intervals."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tsengine.operators import align, domain, metrics


def times(*minutes):
    return [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m) for m in minutes]


@pytest.mark.parametrize(
    "at, fault",
    [
        (times(0, 60, 120), None), (times(0, 30, 120), "irregular step"), (times(0, 60, 90, 180), "irregular step"), (times(0, 60, 240), "irregular step"), (times(0, 60, 60, 120), "repeated time"),
        ([*times(0, 60), None], "null time"), (times(30, 90, 150), "other range than the rest"), (times(0, 60), "other range than the rest"),
    ],
)
def test_faults(spark, at, fault):
    rows = [("good", t) for t in times(0, 60, 120)] + [("looked at", t) for t in at]
    found = {r.location: r.fault for r in domain.faults(spark.createDataFrame(rows, "location string, date_time timestamp_ntz"), "1 hour").collect()}
    assert found.get("looked at") == fault
    if fault:
        with pytest.raises(domain.DomainError):
            domain.validate(spark.createDataFrame(rows, "location string, date_time timestamp_ntz"), "1 hour")


def test_steps_below_a_second_are_seen(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 0, 0, s, us)) for s, us in ((0, 0), (1, 500), (2, 0))]
    assert domain.faults(spark.createDataFrame(rows, "location string, date_time timestamp_ntz"), "1 second").first().fault == "irregular step"


def test_discounts_of_long_ties(spark):
    rows = [(0, 1), (0, 64), (0, 65), (3, 70), (5, 1000), (0, 200_000), (10_000, 200_000), (10**9, 100)]
    for r in spark.createDataFrame(rows, "a long, n long").withColumn("g", metrics.discounts(F.col("a"), F.col("n"))).collect():
        want = math.fsum(1 / math.log2(i + 1) for i in range(r.a + 1, r.a + r.n + 1))
        assert r.g == pytest.approx(want, rel=1e-9)


def test_ranking_of_a_hundred_million_equal_scores(spark):
    """Counts of equal scores come from the rows' number alone, so a range stands for them."""
    n = 100_000_000
    rows = spark.range(0, n, 1, 8).select((F.col("id") % 4 == 0).cast("int").alias("y"), F.lit(0.5).alias("s"))
    got = metrics.ranking(rows, "y", "s").first()
    assert got.average_precision == pytest.approx(0.25)
    x = math.log(n + 1)
    assert got.dcg == pytest.approx(0.25 * n * math.log(2) / x * (1 + 1 / x + 2 / x**2 + 6 / x**3), rel=2e-3)


def test_thousands_of_intervals(spark):
    rng = random.Random(1)
    grid = domain.Domain("2024-01-01 00:00:00", "2024-01-20 00:00:00", "1 hour").grid(spark, ["a", "b"])
    held = []
    for _ in range(3000):
        start = dt.datetime(2023, 12, 28) + dt.timedelta(minutes=rng.choice((0, 0, 30)) + 60 * rng.randrange(30 * 24))
        held.append((rng.choice("abz"), start, start + dt.timedelta(minutes=rng.randrange(-30, 45))))
    held += [("a", None, dt.datetime(2024, 1, 2)), (None, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)), ("b", dt.datetime(2024, 1, 3), None), ("b", dt.datetime(1990, 1, 1, 0, 30), dt.datetime(2050, 1, 1))]
    got = {(r.location, r.date_time): r.masked for r in align.in_intervals(grid, spark.createDataFrame(held, "location string, start timestamp_ntz, end timestamp_ntz"), 3600).collect()}
    on = lambda place, t: any(p == place and s and e and s <= t <= e and (t - s).total_seconds() % 3600 == 0 for p, s, e in held)
    assert len(got) == grid.count() and got == {k: on(*k) for k in got} and 0 < sum(got.values()) < len(got)
    assert align.in_intervals(grid.limit(0), spark.createDataFrame(held, "location string, start timestamp_ntz, end timestamp_ntz"), 3600).count() == 0

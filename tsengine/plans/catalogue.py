"""The queries of the time-series operators over the test tables, and the SQL that gives the same rows.

Series: E, events by type and hour of January 2024; O, orders by priority and day; L, line items by return flag and day.
Doubles are rounded to six digits without a negative zero in both engines; ranks have tie-breakers.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.functions import calendar as cal
from tsengine.functions.values import clamp, difference, flatten_distinct, kelvin_to_celsius, ordered_distinct, tidy, zeros_to_null
from tsengine.operators import aggregates as agg
from tsengine.operators import align, backtest, features, filters, gaps, lowess, metrics, models, moments, monitor, pv, trees, windows
from tsengine.operators.domain import KEYS, Domain, faults, with_padding
from tsengine.operators.domain import months as chosen_months
from tsengine.sources import series
from tsengine.streaming import series as streams

HOURS = Domain("2024-01-01 00:00:00", "2024-01-30 23:00:00", "1 hour")
DAYS = Domain("1995-01-01 00:00:00", "2001-08-01 00:00:00", "1 day")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- series ----------------------------------------------------------------------------------------------------------
def event_source(spark, d) -> DataFrame:
    ev = series.from_table(table(spark, d, "events"), "event_type", "ts", {"value": "value"}).filter(F.col("date_time").between(F.lit("2023-12-01").cast("timestamp_ntz"), F.lit("2024-01-30 23:59:59.999999").cast("timestamp_ntz")))
    return ev.groupBy("location", agg.bucket(F.col("date_time"), "hour").alias("date_time")).agg(F.round(F.sum("value"), 6).alias("value"))


def event_places(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("location")).distinct()


def events(spark, d, domain: Domain = HOURS) -> DataFrame:
    return align.select(domain.grid(spark, event_places(spark, d)), event_source(spark, d), ["value"])


def orders(spark, d) -> DataFrame:
    o = series.from_table(table(spark, d, "orders"), "o_orderpriority", "o_orderdate", {"o_totalprice": "value"}, DAYS)
    days = o.groupBy("location", agg.bucket(F.col("date_time"), "day").alias("date_time")).agg(F.round(F.sum("value"), 4).alias("value"))
    places = table(spark, d, "orders").select(F.col("o_orderpriority").alias("location")).distinct()
    return align.select(DAYS.grid(spark, places), days, ["value"])


def order_forecast(spark, d) -> DataFrame:
    """The value of a week before as the prediction."""
    o = orders(spark, d)
    return o.select(*KEYS, F.col("value").alias("true"), windows.lag_columns("value", ["7 days"], DAYS)[0].alias("predicted"))


E_SQL = """
dom AS (SELECT location, CAST(date_time AS TIMESTAMP) AS date_time FROM (SELECT DISTINCT event_type AS location FROM events), generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR) g(date_time)),
src AS (SELECT event_type AS location, date_trunc('hour', ts) AS date_time, round(sum(value), 6) AS value FROM events WHERE ts BETWEEN TIMESTAMP '2023-12-01' AND TIMESTAMP '2024-01-30 23:59:59.999999' GROUP BY 1, 2),
e AS (SELECT dom.location, dom.date_time, src.value FROM dom LEFT JOIN src USING (location, date_time))"""
O_SQL = """
odom AS (SELECT location, CAST(date_time AS TIMESTAMP) AS date_time FROM (SELECT DISTINCT o_orderpriority AS location FROM orders), generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-01', INTERVAL 1 DAY) g(date_time)),
osrc AS (SELECT o_orderpriority AS location, date_trunc('day', o_orderdate)::TIMESTAMP AS date_time, round(sum(o_totalprice), 4) AS value FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2001-08-01' GROUP BY 1, 2),
o AS (SELECT odom.location, odom.date_time, osrc.value FROM odom LEFT JOIN osrc USING (location, date_time)),
f AS (SELECT location, date_time, value AS "true", lag(value, 7) OVER (PARTITION BY location ORDER BY date_time) AS predicted FROM o)"""


def r(x: str) -> str:
    return f"CASE WHEN round({x}, 6) = 0 THEN 0.0 ELSE round({x}, 6) END"


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return put


# ---- domain and alignment --------------------------------------------------------------------------------------------
@query(f"WITH {E_SQL} SELECT location, date_time FROM dom")
def domain_grid(spark, d):
    return HOURS.grid(spark, event_places(spark, d))


@query(f"WITH {E_SQL} SELECT location, date_time, value FROM e")
def fetch_select(spark, d):
    return events(spark, d)


#: Frames with a fault each, made from the grid: 'click' keeps it, 'error' has its readings' own times, the others are changed.
FAULTY_SQL = f"""WITH {E_SQL}, x AS (SELECT * FROM dom WHERE location <> 'error' UNION ALL SELECT location, date_time FROM src WHERE location = 'error'
UNION ALL SELECT 'twice', date_time FROM dom WHERE location = 'click' UNION ALL SELECT 'twice', date_time FROM dom WHERE location = 'click' AND hour(date_time) = 5
UNION ALL SELECT 'swapped', CASE WHEN hour(date_time) = 7 THEN date_time + INTERVAL 30 MINUTE ELSE date_time END FROM dom WHERE location = 'click'
UNION ALL SELECT 'short', date_time FROM dom WHERE location = 'click' AND date_time < TIMESTAMP '2024-01-20' UNION ALL SELECT 'timeless', CASE WHEN hour(date_time) <> 9 THEN date_time END FROM dom WHERE location = 'click'
UNION ALL SELECT repeat('long', 10), date_time FROM dom WHERE location = 'click' UNION ALL SELECT NULL, date_time FROM dom WHERE location = 'click')"""


def _faulty(spark, d):
    t, whole = F.col("date_time"), HOURS.grid(spark, event_places(spark, d))
    one = whole.filter("location = 'click'")
    out = whole.filter("location <> 'error'").unionByName(event_source(spark, d).filter("location = 'error'").filter(HOURS.within()).select(*KEYS))
    parts = {
        "twice": t, "swapped": F.when(F.hour(t) == 7, t + F.expr("INTERVAL 30 MINUTE")).otherwise(t), "timeless": F.when(F.hour(t) != 9, t), "long" * 10: t, None: t,
    }
    for name, time in parts.items():
        out = out.unionByName(one.select(F.lit(name).cast("string").alias("location"), time.alias("date_time")))
    again = one.filter(F.hour(t) == 5).select(F.lit("twice").alias("location"), t)
    return out.unionByName(again).unionByName(one.filter("date_time < TIMESTAMP_NTZ '2024-01-20'").select(F.lit("short").alias("location"), t))


@query(f"""{FAULTY_SQL.replace("FROM src WHERE location = 'error'", "FROM src WHERE location = 'error' AND date_time >= TIMESTAMP '2024-01-01'")}, l AS (SELECT *, date_diff('second', lag(date_time) OVER (PARTITION BY location ORDER BY date_time), date_time) AS step FROM x),
p AS (SELECT location, count(*) FILTER (date_time IS NULL) AS nulls, count(*) FILTER (step = 0) AS same, count(*) FILTER (step <> 0 AND step <> 3600) AS odd, min(date_time) AS low, max(date_time) AS high FROM l GROUP BY 1)
SELECT location, fault FROM (SELECT location, CASE WHEN location IS NULL THEN 'null location' WHEN length(location) > 36 THEN 'location too long' WHEN nulls > 0 THEN 'null time' WHEN same > 0 THEN 'repeated time' WHEN odd > 0 THEN 'irregular step' WHEN low <> (SELECT min(low) FROM p) OR high <> (SELECT max(high) FROM p) THEN 'other range than the rest' END AS fault FROM p) WHERE fault IS NOT NULL""")
def domain_faults(spark, d):
    return faults(_faulty(spark, d), "1 hour")


@query(f"""WITH {E_SQL}, a AS (SELECT event_type AS location, date_trunc('day', ts)::TIMESTAMP AS date_time, min(value) AS value_min, max(value) AS value_max, {r("avg(value)")} AS value_mean, {r("sum(value)")} AS value_sum, {r("median(value)")} AS value_median FROM events GROUP BY 1, 2)
SELECT g.location, g.date_time, value_min, value_max, value_mean, value_sum, value_median FROM (SELECT location, date_time FROM dom WHERE hour(date_time) = 0) g LEFT JOIN a USING (location, date_time)""")
def fetch_group_daily(spark, d):
    raw = series.from_table(table(spark, d, "events"), "event_type", "ts", {"value": "value"}, Domain(HOURS.start, "2024-01-30 23:59:59.999999"))
    days = agg.aggregate(raw, "day", {"value": ["min", "max", "mean", "sum", "median"]})
    grid = Domain(HOURS.start, HOURS.end, "1 day").grid(spark, event_places(spark, d))
    out = align.select(grid, days, [f"value_{a}" for a in ("min", "max", "mean", "sum", "median")])
    return out.withColumns({c: tidy(F.col(c)) for c in ("value_mean", "value_sum", "value_median")})


@query(f"WITH {E_SQL} SELECT location, date_time, value, max(value) OVER w AS value_max, {r('max(value) OVER w - (row_number() OVER (PARTITION BY location, date_trunc($$day$$, date_time) ORDER BY date_time) - 1)').replace('$$', chr(39))} AS index_difference FROM e WINDOW w AS (PARTITION BY location, date_trunc('day', date_time))")
def group_transform(spark, d):
    df = agg.transform(events(spark, d), "day", {"value": ["max"]})
    return agg.max_index_difference(df, "value", "day", "index_difference").withColumn("index_difference", tidy(F.col("index_difference")))


@query(f"""WITH {E_SQL}, days AS (SELECT location, date_trunc('day', date_time)::TIMESTAMP AS date_time, avg(value) AS v FROM src GROUP BY 1, 2)
SELECT g.location, g.date_time, {r("days.v")} AS value FROM (SELECT location, date_time FROM dom WHERE hour(date_time) = 0) g LEFT JOIN days USING (location, date_time)""")
def resample_mean(spark, d):
    grid = Domain(HOURS.start, HOURS.end, "1 day").grid(spark, event_places(spark, d))
    return agg.resample_mean(event_source(spark, d), grid, "day", "value").withColumn("value", tidy(F.col("value")))


@query("""WITH l AS (SELECT n.n_name AS mapped_location, date_trunc('month', l_shipdate)::TIMESTAMP AS date_time, round(sum(l_quantity), 4) AS quantity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation n ON n_nationkey = s_nationkey GROUP BY 1, 2),
dom AS (SELECT s_name AS location, s_nationkey, CAST(date_time AS TIMESTAMP) AS date_time FROM supplier, (SELECT unnest(generate_series(low, high, INTERVAL 1 MONTH)) AS date_time FROM (SELECT date_trunc('month', min(l_shipdate))::TIMESTAMP AS low, date_trunc('month', max(l_shipdate))::TIMESTAMP AS high FROM lineitem)))
SELECT location, dom.date_time, CASE WHEN n_regionkey <> 0 THEN n_name END AS mapped_location, CASE WHEN n_regionkey <> 0 THEN quantity END AS quantity FROM dom JOIN nation ON n_nationkey = s_nationkey LEFT JOIN l ON l.mapped_location = n_name AND l.date_time = dom.date_time""")
def mapped_fetch(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    named = s.join(n, s.s_nationkey == n.n_nationkey)
    # Line items are added up by supplier and month before they meet the suppliers.
    li = table(spark, d, "lineitem").groupBy("l_suppkey", agg.bucket(F.col("l_shipdate"), "month").alias("date_time")).agg(F.sum("l_quantity").alias("quantity")).join(named, F.col("l_suppkey") == F.col("s_suppkey"))
    source = li.groupBy(F.col("n_name").alias("location"), "date_time").agg(F.round(F.sum("quantity"), 4).alias("quantity"))
    mapping = named.filter("n_regionkey <> 0").select(F.col("s_name").alias("location"), F.col("n_name").alias("mapped_location"))
    span = table(spark, d, "lineitem").agg(agg.bucket(F.min("l_shipdate"), "month").alias("low"), agg.bucket(F.max("l_shipdate"), "month").alias("high"))  # one row
    months = span.select(F.explode(F.sequence(F.col("low").cast("timestamp_ntz"), F.col("high").cast("timestamp_ntz"), F.expr("INTERVAL 1 MONTH"))).alias("date_time"))
    return align.mapped(s.select(F.col("s_name").alias("location")).join(F.broadcast(months)), mapping, source, ["quantity"])


@query("""WITH s AS (SELECT n_name, r_name, date_trunc('month', o_orderdate)::TIMESTAMP AS date_time, sum(o_totalprice) AS v FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3)
SELECT r_name AS location, date_time, round(sum(v), 2) AS value FROM s GROUP BY 1, 2""")
def hierarchy_rollup(spark, d):
    c, n, g, o = (table(spark, d, t) for t in ("customer", "nation", "region", "orders"))
    nations = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    children = nations.groupBy(F.col("n_name").alias("location"), agg.bucket(F.col("o_orderdate"), "month").alias("date_time")).agg(F.sum("o_totalprice").alias("value"))
    hierarchy = n.join(g, n.n_regionkey == g.r_regionkey).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    return align.rollup(hierarchy, children, ["value"]).withColumn("value", F.round("value", 2))


@query("SELECT c_name AS location FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)")
def unmapped_locations(spark, d):
    """Customers that a mapping, made from urgent orders, doesn't know."""
    customers, o = table(spark, d, "customer"), table(spark, d, "orders")
    mapping = o.filter("o_orderpriority = '1-URGENT'").join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_name").alias("location")).agg(F.max("o_orderstatus").alias("mapped_location"))
    return align.unmapped(customers.select(F.col("c_name").alias("location")), mapping)


@query("""WITH a AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS date_time, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1), b AS (SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS date_time, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)
SELECT coalesce(a.date_time, b.date_time) AS date_time, price, quantity FROM a FULL JOIN b ON a.date_time = b.date_time""")
def outer_concat(spark, d):
    day = lambda c: agg.bucket(F.col(c), "day").alias("date_time")
    a = table(spark, d, "orders").groupBy(day("o_orderdate")).agg(F.round(F.sum("o_totalprice"), 2).alias("price"))
    b = table(spark, d, "lineitem").groupBy(day("l_shipdate")).agg(F.sum("l_quantity").alias("quantity"))
    return align.outer(a, b, ["date_time"])


SITES = "SELECT n_name AS location, 24.0 + n_nationkey * 0.83 AS latitude, -120.0 + n_nationkey * 2.21 AS longitude FROM nation"


@query(f"""WITH sites AS ({SITES}), cells AS (SELECT y, x, 21.0 + y AS latitude, 237.0 + x AS longitude FROM range(26) a(y), range(62) b(x)),
d AS (SELECT location, y, x, row_number() OVER (PARTITION BY location ORDER BY (s.latitude - c.latitude) ** 2 + (s.longitude + 360 - c.longitude) ** 2, y, x) AS i FROM sites s, cells c)
SELECT location, y, x FROM d WHERE i = 1""")
def nearest_cell(spark, d):
    return align.nearest_cells(_sites(spark, d), _cells(spark))


def _sites(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("location"), (F.lit(24.0) + F.col("n_nationkey") * 0.83).alias("latitude"), (F.lit(-120.0) + F.col("n_nationkey") * 2.21).alias("longitude"))


def _cells(spark):
    ids = spark.range(26 * 62).select(F.expr("id div 62").alias("y"), (F.col("id") % 62).alias("x"))
    return ids.select("y", "x", (F.lit(21.0) + F.col("y")).alias("latitude"), (F.lit(237.0) + F.col("x")).alias("longitude"))


@query(f"WITH {E_SQL} SELECT location, date_time, (location = 'click' AND date_time BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-04 12:00:00') OR (location = 'view' AND date_time BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12') AS masked FROM dom")
def mask_flags(spark, d):
    return align.in_intervals(HOURS.grid(spark, event_places(spark, d)), _intervals(spark), HOURS.seconds)


def _intervals(spark):
    rows = [("click", "2024-01-03 00:00:00", "2024-01-04 12:00:00"), ("click", "2024-01-04 00:00:00", "2024-01-04 06:00:00"), ("view", "2024-01-10 06:00:00", "2024-01-12 00:00:00")]
    return spark.createDataFrame(rows, "location string, start string, end string").select("location", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"))


@query(f"WITH {E_SQL} SELECT location, date_time, CASE WHEN (location = 'click' AND date_time BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-04 12:00:00') OR (location = 'view' AND date_time BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12') THEN value ELSE -1.0 END AS value FROM e")
def squash_mask(spark, d):
    flagged = align.in_intervals(events(spark, d), _intervals(spark), HOURS.seconds)
    return align.squash_mask(flagged, "value", "masked", -1.0).drop("masked")


@query(f"WITH {O_SQL} SELECT location, date_time, value FROM o WHERE month(date_time) IN (1, 2, 12)")
def winter_months(spark, d):
    """Chosen months of a series."""
    return chosen_months(orders(spark, d), [12, 1, 2])


@query(f"""WITH {E_SQL}, wide AS (SELECT location, CAST(date_time AS TIMESTAMP) AS date_time FROM (SELECT DISTINCT event_type AS location FROM events), generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR) g(date_time)),
back AS (SELECT location, CAST(date_time AS TIMESTAMP) AS date_time FROM (SELECT DISTINCT event_type AS location FROM events), generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-01-28 23:00:00', INTERVAL 1 HOUR) g(date_time))
SELECT 'extended' AS domain, location, date_time, value FROM wide LEFT JOIN src USING (location, date_time) UNION ALL SELECT 'shifted', location, date_time, value FROM back LEFT JOIN src USING (location, date_time)""")
def shifted_fetch(spark, d):
    """A source at a domain that starts two days earlier, and at one that is moved by two days."""
    parts = [align.select(HOURS.shift("2 days", e).grid(spark, event_places(spark, d)), event_source(spark, d), ["value"]).select(F.lit(n).alias("domain"), *KEYS, "value") for n, e in (("extended", True), ("shifted", False))]
    return parts[0].unionByName(parts[1])


# ---- features --------------------------------------------------------------------------------------------------------
LAGS = ("1 hour", "24 hours", "168 hours")


@query(f"WITH {E_SQL} SELECT location, date_time, lag(value, 1) OVER w AS lag_1_hour, lag(value, 24) OVER w AS lag_24_hour, lag(value, 168) OVER w AS lag_168_hour, value FROM e WINDOW w AS (PARTITION BY location ORDER BY date_time)")
def ar_features(spark, d):
    return features.FeatureSpec(lags=LAGS).build(spark, HOURS, event_places(spark, d), event_source(spark, d))


@query(f"WITH {O_SQL} SELECT a.location, a.date_time, a.value, b.value AS lag_7_day FROM o a LEFT JOIN o b ON b.location = a.location AND b.date_time = a.date_time - INTERVAL 7 DAY")
def lag_window(spark, d):
    return orders(spark, d).select(*KEYS, "value", windows.lag_columns("value", ["7 days"], DAYS)[0])


FIXED = "strftime({d}, '%m-%d') IN ('01-01', '07-04', '11-11', '12-25') OR strftime({d}, '%m-%d') = '06-19' AND year({d}) >= 2021"
FLOATING = "isodow(x) = 1 AND (month(x) IN (1, 2) AND day(x) BETWEEN 15 AND 21 OR month(x) = 5 AND day(x) > 24 OR month(x) = 9 AND day(x) < 8 OR month(x) = 10 AND day(x) BETWEEN 8 AND 14) OR isodow(x) = 4 AND month(x) = 11 AND day(x) BETWEEN 22 AND 28"
#: Federal holidays by their rules: a fixed day on a Saturday is observed on Friday, one on a Sunday on Monday.
HOLIDAYS = f"SELECT x FROM (SELECT CAST(g AS DATE) AS x FROM generate_series(DATE '1994-12-01', DATE '2002-02-01', INTERVAL 1 DAY) t(g)) WHERE {FIXED.format(d='x')} OR {FLOATING} OR isodow(x) = 5 AND ({FIXED.format(d='(x + 1)')}) OR isodow(x) = 1 AND ({FIXED.format(d='(x - 1)')})"


@query(f"""WITH {O_SQL} SELECT location, date_time, year(date_time) AS year, month(date_time) AS month, day(date_time) AS day, isodow(date_time) - 1 AS weekday, dayname(date_time) AS day_name,
CAST(isodow(date_time) < 6 AND CAST(date_time AS DATE) NOT IN ({HOLIDAYS}) AS INT) AS is_business_day, CAST(dayname(date_time) = 'Friday' AS INT) AS friday FROM odom""")
def calendar_features(spark, d):
    o, t = orders(spark, d), F.col("date_time")
    friday = cal.one_hot(cal.day_name(t), list(cal.DAYS), "day_of_week")[0].alias("friday")
    return o.select(*KEYS, *(cal.part(u, t).alias(u) for u in ("year", "month", "day", "weekday")), cal.day_name(t).alias("day_name"), cal.is_business_day(t, cal.us_holidays(1995, 2001)).alias("is_business_day"), friday)


def _waves(spark, d, compat):
    out = [*KEYS]
    for p in (24.0, 168.0, 8760.0):
        s, c = cal.harmonics(F.col("date_time"), p, compat_truncate=compat)
        out += [tidy(s).alias(f"sin_{p:g}"), tidy(c).alias(f"cos_{p:g}")]
    return HOURS.grid(spark, event_places(spark, d)).select(*out)


def _wave_sql(angle: str) -> str:
    h = "(date_diff('second', TIMESTAMP '1970-01-01', date_time) / 3600.0)"
    cols = ", ".join(f"{r(f'{f}({angle.format(h=h)} / {p}.0)')} AS {f}_{p}" for p in (24, 168, 8760) for f in ("sin", "cos"))
    return f"WITH {E_SQL} SELECT location, date_time, {cols} FROM dom"


@query(_wave_sql("({h} * 2 * pi())"))
def harmonic_exact(spark, d):
    return _waves(spark, d, False)


@query(_wave_sql("trunc({h} * 2 * pi())"))
def harmonic_trunc(spark, d):
    return _waves(spark, d, True)


@query(f"WITH {E_SQL} SELECT a.date_time, {r('a.value - b.value')} AS components_difference FROM e a JOIN e b USING (date_time) WHERE a.location = 'purchase' AND b.location = 'error'")
def net_value(spark, d):
    e = events(spark, d)
    wide = e.groupBy("date_time").pivot("location", ["purchase", "error"]).agg(F.first("value"))
    return wide.select("date_time", tidy(difference(F.col("purchase"), F.col("error"))).alias("components_difference"))


# ---- windows ---------------------------------------------------------------------------------------------------------
INTERP = f"""WITH {E_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY date_time) AS i FROM e),
s AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, last_value(value IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni, first_value(value IGNORE NULLS) OVER a AS nv FROM n
WINDOW b AS (PARTITION BY location ORDER BY date_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY location ORDER BY date_time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT location, date_time, {{}} AS value FROM s"""
LINE = "CASE WHEN value IS NOT NULL THEN value WHEN ni IS NOT NULL AND pi IS NOT NULL THEN pv + (nv - pv) * (i - pi) / (ni - pi) END"


@query(INTERP.format(r(LINE)))
def interp_interior(spark, d):
    return windows.interpolate(events(spark, d), "value").withColumn("value", tidy(F.col("value")))


@query(INTERP.format(r(f"coalesce({LINE}, pv)")))
def interp_extrap(spark, d):
    return windows.interpolate(events(spark, d), "value", trailing=True, block="7 days").withColumn("value", tidy(F.col("value")))


@query(INTERP.format(r(f"coalesce({LINE}, pv, nv)")))
def interp_both(spark, d):
    return windows.interpolate(events(spark, d), "value", trailing=True, leading=True).withColumn("value", tidy(F.col("value")))


@query(f"""WITH {E_SQL}, n AS (SELECT *, row_number() OVER w AS i, lag(value) OVER w AS p, lead(value) OVER w AS q FROM e WINDOW w AS (PARTITION BY location ORDER BY date_time))
SELECT location, date_time, {r("coalesce(value, CASE WHEN i = 1 THEN q WHEN p IS NOT NULL AND q IS NOT NULL THEN (p + q) / 2 END)")} AS value FROM n""")
def backfill_singleton(spark, d):
    return windows.backfill_singleton(events(spark, d), "value", block="7 days").withColumn("value", tidy(F.col("value")))


@query(f"WITH {E_SQL} SELECT location, date_time, last_value(value IGNORE NULLS) OVER (PARTITION BY location ORDER BY date_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM e")
def persistence_fill(spark, d):
    return windows.persist_last(events(spark, d), "value", block="7 days")


@query(f"WITH {E_SQL} SELECT location, date_time, last_value(value IGNORE NULLS) OVER (PARTITION BY location ORDER BY date_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM e")
def rolling_fill(spark, d):
    last = lambda s: s.dropna().iloc[-1] if s.notna().any() else float("nan")
    return windows.fill_rolling(events(spark, d), "value", last, 24)


@query(f"""WITH {E_SQL}, n AS (SELECT *, row_number() OVER w AS i, lag(value) OVER w AS a, lag(value, 2) OVER w AS b FROM e WINDOW w AS (PARTITION BY location ORDER BY date_time))
SELECT location, date_time, {r("value * 0.5 + a * 0.3 + b * 0.2")} AS convolved FROM n WHERE i >= 3""")
def convolution_valid(spark, d):
    return windows.convolve(events(spark, d), "value", [0.5, 0.3, 0.2]).select(*KEYS, tidy(F.col("convolved")).alias("convolved"))


@query(ORACLE_SQL["convolution_valid"])
def convolution_by_blocks(spark, d):
    """The same without a window over a location."""
    return windows.convolve(events(spark, d), "value", [0.5, 0.3, 0.2], block="7 days").select(*KEYS, tidy(F.col("convolved")).alias("convolved"))


def _lines(source: str, weight: str) -> str:
    """In SQL: lines through the nine nearest days of each day, by tricube times another weight."""
    return f"""SELECT *, CASE WHEN s > 0 THEN l - m * ((sy - m * l) / s) ELSE l END AS t FROM (SELECT location, x, any_value(y) AS y, sum(w * a) / sum(w) AS m, sum(w * v) / sum(w) AS l, sum(w * a * a) / sum(w) - (sum(w * a) / sum(w)) ** 2 AS s, sum(w * a * v) / sum(w) AS sy
FROM (SELECT *, (1 - (abs(a) / max(abs(a)) OVER (PARTITION BY location, x)) ** 3) ** 3 * b AS w FROM (SELECT p.location, p.x, p.y, q.x - p.x AS a, q.y AS v, q.{weight} AS b, row_number() OVER (PARTITION BY p.location, p.x ORDER BY abs(q.x - p.x), q.x) AS i FROM {source} p JOIN {source} q USING (location)) WHERE i <= 9) GROUP BY 1, 2)"""


@query(f"""WITH days AS (SELECT event_type AS location, date_trunc('day', ts)::TIMESTAMP AS date_time, sum(value) AS y FROM events GROUP BY 1, 2), n AS (SELECT location, date_diff('day', TIMESTAMP '1970-01-01', date_time)::DOUBLE AS x, y, 1.0 AS one FROM days),
f AS ({_lines("n", "one")}), c AS (SELECT location, median(abs(y - t)) AS e FROM f GROUP BY 1), r AS (SELECT location, x, y, CASE WHEN abs(y - t) < 6 * e THEN (1 - (abs(y - t) / (6 * e)) ** 2) ** 2 ELSE 0.0 END AS b FROM f JOIN c USING (location)), g AS ({_lines("r", "b")})
SELECT location, date_time, {r("y")} AS value, {r("t")} AS trend FROM days JOIN g USING (location, y) WHERE g.x = date_diff('day', TIMESTAMP '1970-01-01', date_time)""")
def trend_lowess(spark, d):
    """A robust trend of daily sums through the nine nearest days."""
    raw = series.from_table(table(spark, d, "events"), "event_type", "ts", {"value": "value"})
    days = raw.groupBy("location", agg.bucket(F.col("date_time"), "day").alias("date_time")).agg(F.sum("value").alias("value"))
    out = lowess.lowess(days, "date_time", "value", 9, 1, ["location"])
    return out.select(*KEYS, tidy(F.col("value")).alias("value"), tidy(F.col("trend")).alias("trend"))


MONTH = "date_trunc('month', date_time)"


@query(f"WITH {O_SQL} SELECT location, date_time, value, CASE WHEN row_number() OVER (PARTITION BY location, {MONTH} ORDER BY value DESC NULLS LAST, date_time) <= 5 THEN 'peak' ELSE 'offpeak' END AS label FROM o")
def month_rank(spark, d):
    o = orders(spark, d).withColumn("__month", F.trunc(F.col("date_time").cast("date"), "MM"))
    return windows.rank_labels(o, "value", ["peak"] * 5 + ["offpeak"] * 26, ["location", "__month"]).drop("__month")


@query(f"WITH {O_SQL} SELECT * FROM (SELECT location, date_time, value, row_number() OVER (PARTITION BY location, {MONTH} ORDER BY value DESC NULLS LAST, date_time)::INT AS rank FROM o) WHERE rank <= 5")
def peak_topk(spark, d):
    o = orders(spark, d).withColumn("__month", F.trunc(F.col("date_time").cast("date"), "MM"))
    return windows.top_k(o, "value", 5, ["location", "__month"]).drop("__month")


PEAKS = f"""WITH {O_SQL}, a AS (SELECT location, date_time, row_number() OVER (PARTITION BY location, {MONTH} ORDER BY "true" DESC, date_time) AS i FROM f WHERE "true" IS NOT NULL), b AS (SELECT location, date_time, row_number() OVER (PARTITION BY location, {MONTH} ORDER BY predicted DESC, date_time) AS i FROM f WHERE predicted IS NOT NULL)"""


@query(f"""{PEAKS} SELECT coalesce(x.location, y.location) AS location, coalesce(x.date_time, y.date_time) AS date_time, CASE WHEN x.i IS NOT NULL AND y.i IS NOT NULL THEN 'correct' WHEN x.i IS NOT NULL THEN 'missing' ELSE 'incorrect' END AS kind
FROM (SELECT * FROM a WHERE i <= 5) x FULL JOIN (SELECT * FROM b WHERE i <= 5) y ON x.location = y.location AND x.date_time = y.date_time""")
def peak_match(spark, d):
    f = order_forecast(spark, d).withColumn("__month", F.trunc(F.col("date_time").cast("date"), "MM"))
    return metrics.match_peaks(f, "true", "predicted", 5, ["location", "__month"]).drop("__month")


@query(f"""WITH {O_SQL}, c AS (SELECT CASE WHEN row_number() OVER (PARTITION BY location, {MONTH} ORDER BY "true" DESC NULLS LAST, date_time) <= 5 THEN 'peak' ELSE 'offpeak' END AS actual_class, CASE WHEN row_number() OVER (PARTITION BY location, {MONTH} ORDER BY predicted DESC NULLS LAST, date_time) <= 5 THEN 'peak' ELSE 'offpeak' END AS predicted_class FROM f)
SELECT actual_class, predicted_class, count(*) AS n FROM c GROUP BY 1, 2""")
def peak_confusion(spark, d):
    f = order_forecast(spark, d).withColumn("__month", F.trunc(F.col("date_time").cast("date"), "MM"))
    return metrics.peak_confusion(f, "true", "predicted", 5, ["location", "__month"])


# ---- aggregates ------------------------------------------------------------------------------------------------------
@query(f"""WITH {E_SQL} SELECT location, date_trunc('day', date_time)::TIMESTAMP AS day, max(value) FILTER (hour(date_time) = 6) AS pick_6, {r("max(value) FILTER (hour(date_time) = 6) - max(value) FILTER (hour(date_time) = 18)")} AS diff_6_18, {r("coalesce(sum(value) FILTER (hour(date_time) BETWEEN 6 AND 9), 0)")} AS sum_6_9 FROM e GROUP BY 1, 2""")
def hour_functions(spark, d):
    return events(spark, d).groupBy("location", agg.bucket(F.col("date_time"), "day").alias("day")).agg(agg.hour_pick("value", 6).alias("pick_6"), tidy(agg.hour_difference("value", 6, 18)).alias("diff_6_18"), tidy(agg.hour_sum("value", 6, 9)).alias("sum_6_9"))


@query("""WITH v AS (SELECT event_type AS location, date_trunc('day', ts)::TIMESTAMP AS day, round(value) AS value, count(*) AS n, min(ts) AS t FROM events GROUP BY 1, 2, 3)
SELECT location, day, value AS mode FROM (SELECT *, row_number() OVER (PARTITION BY location, day ORDER BY n DESC, t, value) AS i FROM v) WHERE i = 1""")
def nanmode(spark, d):
    raw = series.from_table(table(spark, d, "events"), "event_type", "ts", {"value": "value"})
    days = raw.withColumn("day", agg.bucket(F.col("date_time"), "day")).withColumn("value", F.round("value"))  # halves away from zero, as in the SQL
    return agg.first_mode(days, "value", ["location", "day"])


@query(f"WITH {E_SQL} SELECT location, date_trunc('day', date_time)::TIMESTAMP AS date_time, {r('avg(value) * count(*)')} AS imputed, {r('avg(value) * 24')} AS imputed_24, coalesce({r('max(value) FILTER (hour(date_time) IN (6, 7, 8))')}, -1.0) AS group_hours_max, {r('max(value) FILTER (hour(date_time) = 11) - max(value) FILTER (hour(date_time) = 6)')} AS change_6_11 FROM e GROUP BY 1, 2")
def impute_and_group_hours(spark, d):
    v = F.col("value")
    return events(spark, d).groupBy("location", agg.bucket(F.col("date_time"), "day").alias("date_time")).agg(
        tidy(agg.impute_sum(v)).alias("imputed"), tidy(agg.impute_sum(v, 24)).alias("imputed_24"), F.coalesce(tidy(agg.group_hours([6, 7, 8], v, "max")), F.lit(-1.0)).alias("group_hours_max"), tidy(agg.hour_change(6, 11, v)).alias("change_6_11")
    )


STATS = "count(*) AS n_obs, count(*) - count(value) AS n_missing, {m} AS fraction_missing, count(*) FILTER (last IS NULL OR date_time > last) AS n_trailing_missing, {a} AS mean, min(value) AS min, max(value) AS max, {q}"
STATS = STATS.format(m=r("(count(*) - count(value)) / count(*)"), a=r("avg(value)"), q=", ".join(f"{r(f'quantile_cont(value, {q})')} AS q_{str(q).replace('.', '_')}" for q in (0.05, 0.25, 0.75, 0.95)))
LONG = f"""WITH {E_SQL}, w AS (SELECT location, date_time, value, lag(value) OVER (PARTITION BY location ORDER BY date_time) AS lag_1_hour FROM e),
long AS (SELECT location, date_time, 'value' AS feature, value FROM w UNION ALL SELECT location, date_time, 'lag_1_hour', lag_1_hour FROM w)"""


def _stats(spark, d, by_location):
    df = features.FeatureSpec(lags=("1 hour",)).build(spark, HOURS, event_places(spark, d), event_source(spark, d))
    out = monitor.feature_stats(df, ["value", "lag_1_hour"], by_location)
    return out.withColumns({c: tidy(F.col(c)) for c in ("fraction_missing", "mean", "q_0_05", "q_0_25", "q_0_75", "q_0_95")})


@query(f"{LONG}, k AS (SELECT *, max(date_time) FILTER (value IS NOT NULL) OVER (PARTITION BY feature) AS last FROM long) SELECT feature, {STATS} FROM k GROUP BY 1")
def feature_stats(spark, d):
    return _stats(spark, d, False)


@query(f"{LONG}, k AS (SELECT *, max(date_time) FILTER (value IS NOT NULL) OVER (PARTITION BY feature, location) AS last FROM long) SELECT feature, location, {STATS} FROM k GROUP BY 1, 2")
def feature_stats_by_location(spark, d):
    return _stats(spark, d, True)


@query(f"""WITH {E_SQL} SELECT coalesce(location, 'all') AS location, max(date_time) FILTER (value IS NOT NULL) AS most_recent_non_null, count(*) AS n_stats, count(*) - count(value) AS n_missing, count(value) AS n_present, {r("(count(*) - count(value)) / count(*)")} AS fraction_missing, {r("avg(value)")} AS mean, min(value) AS min, {r("quantile_cont(value, 0.25)")} AS q_25, {r("quantile_cont(value, 0.75)")} AS q_75, max(value) AS max,
date_diff('second', max(date_time) FILTER (value IS NOT NULL), TIMESTAMP '2024-01-30 23:00:00') AS freshness FROM e GROUP BY ROLLUP (location)""")
def range_stats(spark, d):
    out = monitor.range_stats(events(spark, d), "value", HOURS.end)
    return out.withColumns({c: tidy(F.col(c)) for c in ("fraction_missing", "mean", "q_25", "q_75")})


@query(ORACLE_SQL["range_stats"])
def range_stats_by_ranges(spark, d):
    """The same, its quartiles taken by ranges: no task holds a group's values."""
    out = monitor.range_stats(events(spark, d), "value", HOURS.end, ranges=16)
    return out.withColumns({c: tidy(F.col(c)) for c in ("fraction_missing", "mean", "q_25", "q_75")})


# ---- metrics, back-tests, gaps ---------------------------------------------------------------------------------------
METRICS = {
    "explained_variance": "1 - var_pop(y - p) / nullif(var_pop(y), 0)", "max_error": "max(abs(y - p))", "mean_absolute_error": "avg(abs(y - p))", "mean_squared_error": "avg((y - p) * (y - p))", "root_mean_squared_error": "sqrt(avg((y - p) * (y - p)))",
    "mean_squared_log_error": "avg(pow(ln(1 + y) - ln(1 + p), 2))", "median_absolute_error": "median(abs(y - p))", "mean_absolute_percentage_error": "avg(abs(y - p) / abs(y))", "r2": "1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0)",
}


def digits(c: str) -> int:
    return {"mean_squared_error": 1, "mean_absolute_error": 6, "root_mean_squared_error": 4, "max_error": 4, "median_absolute_error": 4}.get(c, 6)


M_SQL = ", ".join(f"round({sql}, {digits(c)}) AS {c}" for c, sql in METRICS.items())


@query(f'WITH {O_SQL}, yp AS (SELECT *, "true" AS y, predicted AS p FROM f WHERE "true" IS NOT NULL AND predicted IS NOT NULL) SELECT location, count(*) AS n, {M_SQL} FROM yp GROUP BY 1')
def metrics_by_location(spark, d):
    return metrics.scored(order_forecast(spark, d), by=["location"]).select("location", "n", *(F.round(c, digits(c)).alias(c) for c in METRICS))


@query(ORACLE_SQL["metrics_by_location"])
def metrics_by_ranges(spark, d):
    """The same, the median taken by ranges: no task holds a place's errors."""
    return metrics.scored(order_forecast(spark, d), by=["location"], ranges=12).select("location", "n", *(F.round(c, digits(c)).alias(c) for c in METRICS))


@query(f"""WITH {O_SQL}, yp AS (SELECT *, date_trunc('month', date_time)::DATE AS month, 'lag_7' AS model, "true" AS y, predicted AS p FROM f WHERE "true" IS NOT NULL AND predicted IS NOT NULL) SELECT model, month, count(*) AS n, {M_SQL} FROM yp GROUP BY 1, 2""")
def metrics_monthly(spark, d):
    out = metrics.by_month(order_forecast(spark, d).withColumn("model", F.lit("lag_7")))
    return out.select("model", "month", "n", *(F.round(c, digits(c)).alias(c) for c in METRICS))


FOLDS = backtest.rolling_folds(DAYS, 5, test_size=28)
FOLD_SQL = ", ".join(f"({f.fold}, TIMESTAMP '{f.train_start}', TIMESTAMP '{f.train_end}', TIMESTAMP '{f.test_start}', TIMESTAMP '{f.test_end}')" for f in FOLDS)


@query("""WITH t AS (SELECT date_trunc('day', min(o_orderdate))::TIMESTAMP AS first, date_diff('day', min(o_orderdate), max(o_orderdate)) + 1 AS n FROM orders), k AS (SELECT i, first, n - (5 - i) * 28 AS begins FROM t, range(5) r(i))
SELECT CAST(i AS INT) AS fold, first + greatest(0, begins - 365) * INTERVAL 1 DAY AS train_start, first + (begins - 1) * INTERVAL 1 DAY AS train_end, first + begins * INTERVAL 1 DAY AS test_start, first + (begins + 27) * INTERVAL 1 DAY AS test_end FROM k""")
def backtest_folds(spark, d):
    """Five folds of 28 days back from the last order, each trained on the year before."""
    span = table(spark, d, "orders").agg(F.min("o_orderdate").cast("date").cast("string"), F.max("o_orderdate").cast("date").cast("string")).first()
    return backtest.fold_table(spark, backtest.rolling_folds(Domain(f"{span[0]} 00:00:00", f"{span[1]} 00:00:00", "1 day"), 5, max_train=365, test_size=28))


@query(f"""WITH {O_SQL}, yp AS (SELECT location, CAST(t.a AS INT) AS fold, "true" AS y, predicted AS p FROM f JOIN (VALUES {FOLD_SQL}) t(a, b, c, d, e) ON f.date_time BETWEEN t.d AND t.e WHERE "true" IS NOT NULL AND predicted IS NOT NULL)
SELECT location, fold, count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0), 6) AS r2 FROM yp GROUP BY GROUPING SETS ((fold), (location), (location, fold))""")
def backtest_metrics(spark, d):
    out = backtest.all_metrics(backtest.in_folds(order_forecast(spark, d), FOLDS))
    return out.select("location", "fold", "n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


GAP_SQL = f"""WITH {E_SQL}, g AS (SELECT *, value IS NOT NULL AND row_number() OVER (PARTITION BY location ORDER BY CASE WHEN value IS NOT NULL THEN 0 ELSE 1 END, md5(concat_ws('|', '32', location, strftime(date_time, '%Y-%m-%d %H:%M:%S'))), date_time) <= 20 AS synth_gap FROM e)"""


@query(f"{GAP_SQL} SELECT location, date_time, value, synth_gap FROM g")
def gap_random_mask(spark, d):
    return gaps.random_gaps(events(spark, d), "value", n=20)


def _gap_mask(column: str, n: int, seed: int) -> str:
    """Which readings of a column a hash of seed, place and time chooses, in SQL."""
    return f"{column} IS NOT NULL AND row_number() OVER (PARTITION BY location ORDER BY CASE WHEN {column} IS NOT NULL THEN 0 ELSE 1 END, md5(concat_ws('|', '{seed}', location, strftime(date_time, '%Y-%m-%d %H:%M:%S'))), date_time) <= {n} AS synth_gap_{column}"


@query(f"WITH {E_SQL}, x AS (SELECT *, lag(value, 24) OVER (PARTITION BY location ORDER BY date_time) AS lag_24_hour FROM e) SELECT location, date_time, {_gap_mask('value', 12, 32)}, {_gap_mask('lag_24_hour', 7, 33)} FROM x")
def gaps_each_column(spark, d):
    """Gaps of each column by a seed of its own."""
    out = gaps.gaps_by_column(_lag_frame(spark, d), {"value": {"n": 12}, "lag_24_hour": {"n": 7}})
    return out.select(*KEYS, "synth_gap_value", "synth_gap_lag_24_hour")


@query(f"""{GAP_SQL}, m AS (SELECT *, CASE WHEN NOT synth_gap THEN value END AS gapped FROM g), h AS (SELECT *, last_value(gapped IGNORE NULLS) OVER (PARTITION BY location ORDER BY date_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM m)
SELECT location, count(filled - value) AS n, {r("sqrt(avg((filled - value) * (filled - value)))")} AS rmse, {r("median(abs(filled - value))")} AS median_abs_error FROM h WHERE synth_gap GROUP BY 1""")
def gap_scores(spark, d):
    df = gaps.with_gaps(gaps.random_gaps(events(spark, d), "value", n=20), "value")
    out = gaps.score(windows.persist_last(df, "gapped", "filled"), "value", "filled", by=["location"])
    return out.withColumns({c: tidy(F.col(c)) for c in ("rmse", "median_abs_error")})


@query(f"""WITH {O_SQL}, x AS (SELECT location, date_time, predicted - "true" AS residual FROM f) SELECT location, date_time, round(residual, 4) AS residual, round((residual - avg(residual) OVER ()) / nullif(stddev_pop(residual) OVER (), 0), 6) AS residual_z FROM x""")
def residuals(spark, d):
    out = monitor.standardize(metrics.residuals(order_forecast(spark, d)).select(*KEYS, "residual"), ["residual"])
    return out.select(*KEYS, F.round("residual", 4).alias("residual"), F.round("residual_z", 6).alias("residual_z"))


@query("""SELECT location, date_trunc('hour', date_time) AS date_time, count(v) AS n, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, round(sum(v), 6) AS sum FROM (SELECT event_type AS location, ts AS date_time, value AS v FROM events) GROUP BY 1, 2""")
def window_buckets(spark, d):
    raw = series.from_table(table(spark, d, "events"), "event_type", "ts", {"value": "value"})
    return streams.bucket_stream(raw, "value").select("location", "date_time", "n", F.round("mean", 6).alias("mean"), "min", "max", F.round("sum", 6).alias("sum"))


@query(f"""WITH {E_SQL}, l AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN date_time END IGNORE NULLS) OVER w AS t, last_value(value IGNORE NULLS) OVER w AS v FROM e WINDOW w AS (PARTITION BY location ORDER BY date_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT location, date_time, value, CASE WHEN date_diff('hour', t, date_time) <= 2 THEN v END AS filled FROM l""")
def stateful_fill(spark, d):
    """The filler of streams on a batch; an observation fills two hours at most."""
    return streams.fill_last(events(spark, d), "value", expire="2 hours")


# ---- models ----------------------------------------------------------------------------------------------------------
@query(f"""WITH {E_SQL}, x AS (SELECT *, lag(value, 24) OVER (PARTITION BY location ORDER BY date_time) AS lag_24_hour FROM e), m AS (SELECT location, regr_slope(value, lag_24_hour) AS a, regr_intercept(value, lag_24_hour) AS b FROM x GROUP BY 1)
SELECT location, date_time, round(a * lag_24_hour + b, 4) AS predicted FROM x JOIN m USING (location)""")
def linear_forecast(spark, d):
    df = features.FeatureSpec(lags=("24 hours",)).build(spark, HOURS, event_places(spark, d), event_source(spark, d))
    line = models.regression_line(df, "lag_24_hour", "value", ["location"])
    return df.join(line, "location").select(*KEYS, F.round(F.col("slope") * F.col("lag_24_hour") + F.col("intercept"), 4).alias("predicted"))


def _ml_frame(spark, d):
    spec = features.FeatureSpec(lags=("24 hours",), day_of_week=True, harmonics=(24.0,))
    return spec, spec.build(spark, HOURS, event_places(spark, d), event_source(spark, d))


@query()
def model_forecast(spark, d):
    spec, df = _ml_frame(spark, d)
    model = models.TimeSeriesModel(spec.names(), before=[filters.interpolate_linear(["lag_24_hour"])])
    return model.fit(df.filter("date_time < TIMESTAMP_NTZ '2024-01-25'")).predict(df, feature_score=True)


@query()
def gbt_forecast(spark, d):
    spec, df = _ml_frame(spark, d)
    model = models.TimeSeriesModel(spec.names(), estimator="boosted_trees", params={"maxIter": 5}, impute=0.0)
    return model.fit(df.filter("date_time < TIMESTAMP_NTZ '2024-01-25'")).predict(df)


@query(f"""WITH RECURSIVE {E_SQL}, p AS (SELECT location, date_time, last_value(value IGNORE NULLS) OVER w AS value, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY location ORDER BY date_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT location, i, md5(concat_ws('|', '32', location, strftime(date_time, '%Y-%m-%d %H:%M:%S'))) AS draw FROM (SELECT *, count(value) OVER (PARTITION BY location ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM p) WHERE n = 8),
t AS (SELECT location, CAST([] AS BIGINT[]) AS taken FROM (SELECT DISTINCT location FROM c) UNION ALL SELECT location, list_append(any_value(taken), arg_min(i, draw)) FROM t JOIN c USING (location) WHERE len(taken) < 3 AND len(list_filter(taken, lambda a: abs(a - i) < 8)) = 0 GROUP BY location),
m AS (SELECT location, unnest(taken) AS a FROM t WHERE len(taken) = 3)
SELECT location, date_time, value, EXISTS (SELECT 1 FROM m WHERE m.location = p.location AND p.i > a AND p.i <= a + 6) AS synth_gap FROM p""")
def block_gaps(spark, d):
    return gaps.block_gaps(windows.persist_last(events(spark, d), "value"), "value", 6, n=3)


@query(f"WITH {E_SQL} SELECT location, date_time, value, lag_24_hour, lag_24_hour AS predicted FROM (SELECT *, lag(value, 24) OVER (PARTITION BY location ORDER BY date_time) AS lag_24_hour FROM e)")
def identity_forecast(spark, d):
    """A feature taken as the prediction."""
    return models.identity_prediction(_lag_frame(spark, d).select(*KEYS, "value", "lag_24_hour"), "lag_24_hour")


#: A stump over the hour and a day of the week that is known only where the day before has a reading: every cut, with missing days on either side.
STUMP_SQL = f"""WITH {E_SQL}, x AS (SELECT location, date_time, value, hour(date_time) AS hour, CASE WHEN lag(value, 24) OVER (PARTITION BY location ORDER BY date_time) IS NOT NULL THEN isodow(date_time) END AS day FROM e),
b AS (SELECT avg(value) AS base FROM x), l AS (SELECT hour, day, value - base AS r FROM x, b WHERE value IS NOT NULL),
cuts AS (SELECT DISTINCT 0 AS f, hour AS t, false AS way FROM l UNION SELECT DISTINCT 1, day, way FROM l, (VALUES (false), (true)) w(way) WHERE day IS NOT NULL),
g AS (SELECT f, t, way, sum(r) FILTER (go) AS a, count(*) FILTER (go) AS n, sum(r) FILTER (NOT go) AS b, count(*) FILTER (NOT go) AS m FROM (SELECT *, CASE WHEN f = 0 THEN hour <= t ELSE coalesce(day <= t, way) END AS go FROM l, cuts) GROUP BY ALL),
best AS (SELECT * FROM g WHERE n >= 20 AND m >= 20 ORDER BY a * a / (n + 1) + b * b / (m + 1) DESC, f, t LIMIT 1)"""


@query(f"{STUMP_SQL} SELECT location, x.date_time, round(base + 0.5 * CASE WHEN CASE WHEN f = 0 THEN hour <= t ELSE coalesce(day <= t, way) END THEN a / (n + 1) ELSE best.b / (m + 1) END, 6) AS predicted FROM x, b, best")
def learned_stump(spark, d):
    df = _known_days(spark, d)
    found = trees.fit(df, ["hour", "day"], "value", trees=1, depth=1, rate=0.5, least=20)
    return df.select(*KEYS, F.round(found.column(), 6).alias("predicted"))


def _known_days(spark, d):
    t = F.col("date_time")
    return _lag_frame(spark, d).select(*KEYS, "value", "lag_24_hour", F.hour(t).alias("hour"), F.when(F.col("lag_24_hour").isNotNull(), F.weekday(t) + 1).alias("day"))


@query()
def network_forecast(spark, d):
    """A neural regressor on the reading of the day before and the time of day."""
    df = _lag_frame(spark, d).withColumns({"sin": F.sin(F.hour("date_time") * math.pi / 12), "cos": F.cos(F.hour("date_time") * math.pi / 12)})
    model = models.TimeSeriesModel(["lag_24_hour", "sin", "cos"], estimator="network", params={"hidden": (8,), "rounds": 20, "rate": 0.1})
    return model.fit(df.filter("date_time < TIMESTAMP_NTZ '2024-01-25'")).predict(df)


@query()
def tree_attributions(spark, d):
    """What each feature adds to a prediction of boosted trees, row by row."""
    df = _known_days(spark, d)
    found = trees.fit(df.filter("date_time < TIMESTAMP_NTZ '2024-01-25'"), ["hour", "day", "lag_24_hour"], "value", trees=8, depth=3)
    a = F.col("a")
    return df.select(*KEYS, found.column().alias("predicted"), found.attribution().alias("a")).select(*KEYS, "predicted", F.lit(found.expected()).alias("expected"), *(a[i].alias(f"by_{f}") for i, f in enumerate(found.features)))


CLEAR = "greatest(0.0, sin((hour(date_time) - 6) * 3.14159265 / 12))"


def _watts(x: str, tilt: str, capacity: str) -> str:
    """The published formulas once more, in SQL: incidence, plane of array, cell temperature, direct and alternating current."""
    t = f"radians({tilt})"
    incidence = f"({x}.cz * cos({t}) + sin(acos({x}.cz)) * sin({t}) * cos({x}.az - radians(180.0)))"
    plane = f"((CASE WHEN {x}.cz > 0 THEN {x}.dni * greatest({incidence}, 0.0) ELSE 0.0 END) + {x}.dhi * (1 + cos({t})) / 2 + {x}.ghi * 0.2 * (1 - cos({t})) / 2)"
    dc = f"({capacity} * {plane} / 1000 * (1 - 0.0047 * ({x}.temp + {plane} * 0.0325 / (1 + 0.1 * {x}.wind) - 25)) * (1 - 14.0757 / 100))"
    return f"(greatest(least({dc} * 0.96, {capacity} / 1.15), 0.0) * -1000)"


PV_SQL = f"""WITH sites AS ({SITES}), g AS (SELECT location, latitude, longitude, CAST(date_time AS TIMESTAMP) AS date_time FROM sites, generate_series(TIMESTAMP '2024-06-01 00:00:00', TIMESTAMP '2024-06-07 23:00:00', INTERVAL 1 HOUR) s(date_time)),
a AS (SELECT *, 2 * pi() * (dayofyear(date_time) - 1 + (hour(date_time) - 12) / 24.0) / 365 AS day FROM g),
b AS (SELECT *, 229.18 * (0.000075 + 0.001868 * cos(day) - 0.032077 * sin(day) - 0.014615 * cos(2 * day) - 0.040849 * sin(2 * day)) AS eot, 0.006918 - 0.399912 * cos(day) + 0.070257 * sin(day) - 0.006758 * cos(2 * day) + 0.000907 * sin(2 * day) - 0.002697 * cos(3 * day) + 0.00148 * sin(3 * day) AS decl FROM a),
c AS (SELECT *, radians((hour(date_time) * 60 + minute(date_time) + eot + 4 * longitude) / 4 - 180) AS angle, radians(latitude) AS lat FROM b),
x AS (SELECT location, date_time, least(greatest(sin(lat) * sin(decl) + cos(lat) * cos(decl) * cos(angle), -1.0), 1.0) AS cz, atan2(sin(angle), cos(angle) * sin(lat) - tan(decl) * cos(lat)) + pi() AS az, {CLEAR} * 700 AS ghi, {CLEAR} * 500 AS dni, {CLEAR} * 120 AS dhi, 293.15 - 273.15 AS temp, 2.0 AS wind FROM c)
SELECT location, date_time, CASE location WHEN 'FRANCE' THEN round({_watts("x", "20.0", "6.4")}, 3) + 0.0 WHEN 'KENYA' THEN round({_watts("x", "10.0", "6.4")} + {_watts("x", "20.0", "3.0")}, 3) + 0.0 END AS pv_physics FROM x"""


@query(PV_SQL)
def pv_forecast(spark, d):
    sites = _sites(spark, d)
    grid = Domain("2024-06-01 00:00:00", "2024-06-07 23:00:00").grid(spark, sites.select("location"))
    day = F.greatest(F.lit(0.0), F.sin((F.hour("date_time") - 6) * 3.14159265 / 12))
    weather = grid.select(*KEYS, (day * 700).alias("dswrf"), (day * 500).alias("vbdsf"), (day * 120).alias("vddsf"), F.lit(293.15).alias("t"), F.lit(2.0).alias("gust"))
    out = pv.forecast(weather, sites, {"FRANCE": [pv.System()], "KENYA": [pv.System(tilt=10.0), pv.System(capacity_kw=3.0)]})
    return out.withColumn("pv_physics", tidy(F.col("pv_physics"), 3))


NOISE = "((('0x' || substr(md5(concat_ws('|', '7', '{i}', location, strftime(date_time, '%Y-%m-%d %H:%M:%S'))), 1, 12))::BIGINT + 0.5) / 281474976710656.0)"
HOURS_SQL = "(date_diff('second', TIMESTAMP '2000-01-01', date_time) / 3600.0)"


@query(f"""WITH {E_SQL} SELECT location, date_time, {r(f"CASE WHEN location = 'click' THEN 2.0 ELSE 1.0 END * (sin(2 * pi() * {HOURS_SQL} / 24 + pi() / 3) + cos(2 * pi() * {HOURS_SQL} / 168) + 0.1 * sqrt(-2 * ln({NOISE.format(i=1)})) * cos(2 * pi() * {NOISE.format(i=2)}))")} AS value FROM dom""")
def synthetic_series(spark, d):
    out = series.synthetic(HOURS.grid(spark, event_places(spark, d)), {"click": 2.0}, noise=0.1, seed=7)
    return out.withColumn("value", tidy(F.col("value")))


LAG_SQL = f"""WITH {E_SQL}, x AS (SELECT *, lag(value, 24) OVER (PARTITION BY location ORDER BY date_time) AS lag_24_hour FROM e), t AS (SELECT * FROM x WHERE value IS NOT NULL AND lag_24_hour IS NOT NULL)"""


def _lag_frame(spark, d):
    return features.FeatureSpec(lags=("24 hours",)).build(spark, HOURS, event_places(spark, d), event_source(spark, d))


@query(f"""{LAG_SQL}, m AS (SELECT regr_slope(value, lag_24_hour) AS a, regr_intercept(value, lag_24_hour) AS b FROM t)
SELECT location, date_time, value, round(a * lag_24_hour + b, 3) AS predicted, CAST(CASE WHEN lag_24_hour IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS feature_score FROM x, m""")
def model_linear(spark, d):
    """A linear model with scaled features and label gives the least-squares line."""
    df = _lag_frame(spark, d)
    out = models.TimeSeriesModel(["lag_24_hour"], scale_features=True, scale_target=True).fit(df).predict(df, feature_score=True)
    return out.withColumn("predicted", F.round("predicted", 3)).withColumn("feature_score", F.coalesce("feature_score", F.lit(0.0)))


@query(f"""{LAG_SQL}, m AS (SELECT covar_pop(value, lag_24_hour) / (var_pop(lag_24_hour) + 1000.0 / count(*)) AS a, avg(value) AS y, avg(lag_24_hour) AS z FROM t)
SELECT location, date_time, value, round(y + a * (lag_24_hour - z), 3) AS predicted FROM x, m""")
def model_ridge(spark, d):
    """With one feature the slope has a closed form."""
    df = _lag_frame(spark, d)
    out = models.TimeSeriesModel(["lag_24_hour"], estimator="ridge", params={"alpha": 1000.0}).fit(df).predict(df)
    return out.withColumn("predicted", F.round("predicted", 3))


TREE = "(VALUES ('sales', 'purchase'), ('sales', 'click'), ('noise', 'error'), ('noise', 'view'), ('noise', 'click')) h(parent, child)"


@query(f"""{LAG_SQL}, m AS (SELECT regr_slope(value, lag_24_hour) AS a, regr_intercept(value, lag_24_hour) AS b FROM t WHERE location IN ('purchase', 'click', 'error', 'view')), p AS (SELECT location, date_time, value, a * lag_24_hour + b AS predicted FROM x, m)
SELECT parent AS location, date_time, round(sum(value), 3) AS value, round(sum(predicted), 3) AS predicted FROM {TREE} JOIN p ON p.location = h.child GROUP BY 1, 2""")
def hierarchy_model(spark, d):
    """Fitted and predicted on the children, added up to their parents."""
    df = _lag_frame(spark, d)
    tree = spark.createDataFrame([("sales", "purchase"), ("sales", "click"), ("noise", "error"), ("noise", "view"), ("noise", "click")], "parent string, child string")
    out = models.HierarchyModel(models.TimeSeriesModel(["lag_24_hour"]), tree).fit(df).predict(df)
    return out.select(*KEYS, F.round("value", 3).alias("value"), F.round("predicted", 3).alias("predicted"))


HOUR_FOLDS = backtest.rolling_folds(HOURS, 3, max_train=240, test_size=48)
HOUR_FOLD_SQL = ", ".join(f"({f.fold}, TIMESTAMP '{f.train_start}', TIMESTAMP '{f.train_end}', TIMESTAMP '{f.test_start}', TIMESTAMP '{f.test_end}')" for f in HOUR_FOLDS)
RUN_SQL = f"""{LAG_SQL}, k AS (SELECT CAST(a AS INT) AS fold, b, c, d, e FROM (VALUES {HOUR_FOLD_SQL}) v(a, b, c, d, e)),
m AS (SELECT fold, regr_slope(value, lag_24_hour) AS a, regr_intercept(value, lag_24_hour) AS i FROM t JOIN k ON date_time BETWEEN b AND c GROUP BY 1),
p AS (SELECT fold, location, date_time, value AS y, m.a * lag_24_hour + m.i AS p FROM x JOIN k ON date_time BETWEEN d AND e JOIN m USING (fold))"""


def _run(spark, d):
    return backtest.run(_lag_frame(spark, d), HOUR_FOLDS, lambda: models.TimeSeriesModel(["lag_24_hour"]))


@query(f"""{RUN_SQL} SELECT fold, 'test' AS which, location, date_time, round(y, 6) AS "true", round(p, 3) AS predicted FROM p""")
def backtest_run(spark, d):
    return _run(spark, d).withColumn("true", F.round("true", 6)).withColumn("predicted", F.round("predicted", 3))


@query(f"""{RUN_SQL}, q AS (SELECT * FROM p WHERE y IS NOT NULL) SELECT location, count(*) AS n, count(*) - count(p) AS n_unpredicted, CASE WHEN count(*) = count(p) THEN round(avg(abs((y - p) / y)), 4) END AS mape, CASE WHEN count(*) = count(p) THEN round(avg(abs(y - p)), 3) END AS mae, CASE WHEN count(*) = count(p) THEN round(median(abs(y - p)), 3) END AS median_abs_error, CASE WHEN count(*) = count(p) THEN round(1 - var_pop(y - p) / var_pop(y), 4) END AS explained_variance, CASE WHEN count(*) = count(p) THEN round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4) END AS r2 FROM q GROUP BY 1""")
def backtest_by_location(spark, d):
    out = backtest.grouped_metrics(_run(spark, d), "location")
    return out.select("location", "n", "n_unpredicted", F.round("mape", 4).alias("mape"), F.round("mae", 3).alias("mae"), F.round("median_abs_error", 3).alias("median_abs_error"), F.round("explained_variance", 4).alias("explained_variance"), F.round("r2", 4).alias("r2"))


WEEK_SQL = f"""WITH {E_SQL}, x AS (SELECT *, lag(value, 24) OVER w AS a, lag(value, 48) OVER w AS b FROM e WINDOW w AS (PARTITION BY location ORDER BY date_time)),
k AS (SELECT CAST(a AS INT) AS fold, b AS train_start, c AS train_end, d AS test_start, e AS test_end FROM (VALUES {HOUR_FOLD_SQL}) v(a, b, c, d, e))"""
#: A line of one feature by fold, its errors on the test window, and the mean of the folds' r2.
ONE_SQL = """SELECT '{name}' AS features, round(avg(r2), 6) AS r2 FROM (SELECT fold, CASE WHEN count(*) = count({x}) THEN 1 - sum((value - m - s * {x}) ** 2) / nullif(var_pop(value) * count(*), 0) END AS r2 FROM x JOIN k ON date_time BETWEEN test_start AND test_end
JOIN (SELECT fold, regr_slope(value, {x}) AS s, regr_intercept(value, {x}) AS m FROM x JOIN k ON date_time BETWEEN train_start AND train_end GROUP BY fold) USING (fold) WHERE value IS NOT NULL GROUP BY fold)"""


def _week(spark, d):
    spec = features.FeatureSpec(lags=("24 hours", "48 hours"))
    return spec.build(spark, HOURS, event_places(spark, d), event_source(spark, d))


@query(f"""{WEEK_SQL}, f AS (SELECT *, coalesce(a, 0.0) AS p, coalesce(b, 0.0) AS q FROM x), m AS (SELECT fold, count(*) AS n_train, avg(value) AS my, avg(p) AS mp, avg(q) AS mq, covar_pop(p, value) AS py, covar_pop(q, value) AS qy, var_pop(p) AS pp, var_pop(q) AS qq, covar_pop(p, q) AS pq FROM f JOIN k ON date_time BETWEEN train_start AND train_end WHERE value IS NOT NULL GROUP BY 1),
w AS (SELECT *, (qq * py - pq * qy) / (pp * qq - pq * pq) AS s, (pp * qy - pq * py) / (pp * qq - pq * pq) AS t FROM m)
SELECT fold, n_train, count(*) AS n, round(sqrt(avg((value - my - s * (p - mp) - t * (q - mq)) ** 2)), 5) AS rmse, round(1 - sum((value - my - s * (p - mp) - t * (q - mq)) ** 2) / (var_pop(value) * count(*)), 6) AS r2 FROM f JOIN k ON date_time BETWEEN test_start AND test_end JOIN w USING (fold) WHERE value IS NOT NULL GROUP BY ALL""")
def onepass_scores(spark, d):
    """All folds of a regression on two lags, from one aggregation."""
    found = moments.scores(_week(spark, d).fillna(0.0, ["lag_24_hour", "lag_48_hour"]), HOUR_FOLDS, ["lag_24_hour", "lag_48_hour"])
    return found.select("fold", "n_train", "n", F.round("rmse", 5).alias("rmse"), F.round("r2", 6).alias("r2"))


@query(f"{WEEK_SQL.replace('lag(value, 24) OVER w AS a, lag(value, 48) OVER w AS b', 'coalesce(lag(value, 24) OVER w, 0.0) AS a, coalesce(lag(value, 48) OVER w, 0.0) AS b, CAST(hour(date_time) AS DOUBLE) AS h')} {' UNION ALL '.join(ONE_SQL.format(name=n, x=x) for n, x in (('lag_24_hour', 'a'), ('lag_48_hour', 'b'), ('hour', 'h')))}")
def onepass_search(spark, d):
    """Which of three features predicts best over the folds: every candidate is a small solve."""
    df = _week(spark, d).fillna(0.0, ["lag_24_hour", "lag_48_hour"]).withColumn("hour", F.hour("date_time").cast("double"))
    held = moments.FoldMoments(df, HOUR_FOLDS, ["lag_24_hour", "lag_48_hour", "hour"])
    return moments.leaderboard(spark, held.search(([f], 0.0) for f in held.features)).select("features", F.round("r2", 6).alias("r2"))


#: A plane of two features by fold, and the mean of the folds' r2.
TWO_SQL = """SELECT '{n}' AS p, '{m}' AS q, avg(r2) AS r2 FROM (SELECT fold, 1 - sum((value - my - s * ({x} - mx) - t * ({z} - mz)) ** 2) / (var_pop(value) * count(*)) AS r2 FROM x JOIN k ON date_time BETWEEN test_start AND test_end
JOIN (SELECT fold, my, mx, mz, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS s, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS t FROM (SELECT fold, avg(value) AS my, avg({x}) AS mx, avg({z}) AS mz, covar_pop({x}, value) AS xy, covar_pop({z}, value) AS zy, var_pop({x}) AS xx, var_pop({z}) AS zz, covar_pop({x}, {z}) AS xz
FROM x JOIN k ON date_time BETWEEN train_start AND train_end WHERE value IS NOT NULL GROUP BY fold)) USING (fold) WHERE value IS NOT NULL GROUP BY fold)"""
FILLED_SQL = WEEK_SQL.replace("lag(value, 24) OVER w AS a, lag(value, 48) OVER w AS b", "coalesce(lag(value, 24) OVER w, 0.0) AS a, coalesce(lag(value, 48) OVER w, 0.0) AS b, CAST(hour(date_time) AS DOUBLE) AS h")
SELECTABLE = (("lag_24_hour", "a"), ("lag_48_hour", "b"), ("hour", "h"))


@query(f"""{FILLED_SQL}, one AS ({' UNION ALL '.join(ONE_SQL.format(name=n, x=x) for n, x in SELECTABLE)}), two AS ({' UNION ALL '.join(TWO_SQL.format(n=n, m=m, x=x, z=z) for i, (n, x) in enumerate(SELECTABLE) for m, z in SELECTABLE[i + 1 :])}),
best AS (SELECT features AS f FROM one ORDER BY r2 DESC LIMIT 1), second AS (SELECT CASE WHEN p = f THEN q ELSE p END AS f FROM two, best WHERE f IN (p, q) ORDER BY r2 DESC LIMIT 1)
SELECT 1 AS place, f AS feature FROM best UNION ALL SELECT 2, f FROM second""")
def onepass_selection(spark, d):
    """The two features that forward selection takes first."""
    df = _week(spark, d).fillna(0.0, ["lag_24_hour", "lag_48_hour"]).withColumn("hour", F.hour("date_time").cast("double"))
    chosen, _ = moments.FoldMoments(df, HOUR_FOLDS, [n for n, _ in SELECTABLE]).select(2)
    return spark.createDataFrame([(i + 1, f) for i, f in enumerate(chosen)], "place int, feature string")


# ---- sources, filters and small parts --------------------------------------------------------------------------------
@query("""WITH old AS (SELECT n_name AS location, r_name AS m FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey < 15), new AS (SELECT n_name AS location, 'other' AS m FROM nation WHERE n_nationkey > 10)
SELECT coalesce(new.location, old.location) AS location, coalesce(new.m, old.m) AS mapped_location FROM old FULL JOIN new ON old.location = new.location""")
def mapping_update(spark, d):
    n, g = table(spark, d, "nation"), table(spark, d, "region")
    old = n.filter("n_nationkey < 15").join(g, n.n_regionkey == g.r_regionkey).select(F.col("n_name").alias("location"), F.col("r_name").alias("mapped_location"))
    return align.merge_mappings(old, n.filter("n_nationkey > 10").select(F.col("n_name").alias("location"), F.lit("other").alias("mapped_location")))


@query(f"""WITH {E_SQL}, m AS (SELECT * FROM (VALUES ('click', 'web'), ('view', 'web'), ('purchase', 'shop')) v(location, mapped_location))
SELECT mapped_location, date_trunc('day', date_time)::TIMESTAMP AS date_time, count(value) AS value_count, {r("sum(value)")} AS value_sum, {r("max(value) - min(value)")} AS value_span FROM e LEFT JOIN m USING (location) GROUP BY 1, 2""")
def mapped_group(spark, d):
    """Aggregates by a mapped location, one of them a function of a column."""

    def span(v):
        return F.max(v) - F.min(v)

    m = spark.createDataFrame([("click", "web"), ("view", "web"), ("purchase", "shop")], "location string, mapped_location string")
    rows = events(spark, d).join(m, "location", "left")
    out = agg.aggregate(rows, "day", {"value": ["count", "sum", span]}, keys=("mapped_location",))
    return out.withColumns({c: tidy(F.col(c)) for c in ("value_sum", "value_span")})


@query(f"""WITH sites AS ({SITES}), cells AS (SELECT y, x, 21.0 + y AS latitude, 237.0 + x AS longitude FROM range(26) a(y), range(62) b(x)),
n AS (SELECT location, y, x, row_number() OVER (PARTITION BY location ORDER BY (s.latitude - c.latitude) ** 2 + (s.longitude + 360 - c.longitude) ** 2, y, x) AS i FROM sites s, cells c WHERE location < 'M'),
g AS (SELECT location, CAST(date_time AS TIMESTAMP) AS date_time FROM sites, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02', INTERVAL 6 HOUR) t(date_time))
SELECT g.location, g.date_time, CAST(CASE WHEN hour(g.date_time) <> 18 THEN n.y * 100 + n.x + hour(g.date_time) / 100.0 END AS DOUBLE) AS t FROM g LEFT JOIN n ON n.location = g.location AND n.i = 1""")
def cube_at_sites(spark, d):
    """A gridded cube at each site's nearest cell; sites without a cell and times without a reading are null."""
    sites = _sites(spark, d)
    times = F.explode(F.array(*[F.lit(f"2024-01-0{a} {h:02d}:00:00").cast("timestamp_ntz") for a, h in ((1, 0), (1, 6), (1, 12), (2, 0))]))
    cube = _cells(spark).select("y", "x", times.alias("valid_time")).withColumn("t", F.col("y") * 100 + F.col("x") + F.hour("valid_time") / 100)
    grid = Domain("2024-01-01 00:00:00", "2024-01-02 00:00:00", "6 hours").grid(spark, sites.select("location"))
    return align.at_cells(grid, align.nearest_cells(sites.filter("location < 'M'"), _cells(spark)), cube, ["t"])


DAY_SQL = "SELECT l_shipdate::TIMESTAMP AS utc_time, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS actual, sum(l_quantity) AS forecast FROM lineitem GROUP BY 1"


def _loads(spark, d):
    day = table(spark, d, "lineitem").groupBy(F.col("l_shipdate").alias("utc_time"))
    return day.agg(F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0.0)).alias("actual"), F.sum("l_quantity").alias("forecast"))


@query(f"SELECT 'area' AS location, utc_time AS date_time, nullif(actual, 0) AS actual, nullif(forecast, 0) AS forecast FROM ({DAY_SQL})")
def area_loads(spark, d):
    return series.balancing_area(_loads(spark, d), "area", ["actual", "forecast"])


@query(f"SELECT 'area' AS location, utc_time AS date_time, CASE WHEN actual <> 0 THEN actual END AS actual, CASE WHEN actual <> 0 THEN forecast END AS predicted FROM ({DAY_SQL})")
def published_forecast(spark, d):
    return series.published_forecast(_loads(spark, d), "area", "actual", "forecast")


@query(f"WITH {O_SQL} SELECT odom.location, odom.date_time, f.\"true\", f.predicted FROM odom LEFT JOIN (SELECT * FROM f WHERE date_time >= TIMESTAMP '1999-01-01') f ON f.location = odom.location AND f.date_time = odom.date_time")
def table_model(spark, d):
    """Predictions read from a table at a domain."""
    late = order_forecast(spark, d).filter("date_time >= TIMESTAMP_NTZ '1999-01-01'")
    return models.TableModel(late).fit().predict(orders(spark, d).select(*KEYS))


@query(f"WITH {E_SQL} SELECT location, date_time, CAST(NULL AS DOUBLE) AS value FROM dom")
def missing_source(spark, d):
    return series.missing(HOURS.grid(spark, event_places(spark, d)))


SPLIT = "max(value) FILTER (location = '{c}')"


@query(f"WITH {E_SQL} SELECT date_time, {SPLIT.format(c='click')} AS click, {SPLIT.format(c='view')} AS view FROM e GROUP BY 1")
def side_by_side(spark, d):
    """Meters of a location as columns."""
    meters = events(spark, d).select(F.lit("site").alias("location"), F.col("location").alias("meter"), "date_time", "value")
    return series.side_by_side(meters, ["click", "view"]).select("date_time", "click", "view")


@query(f"WITH {E_SQL} SELECT date_time, {SPLIT.format(c='click')} AS click, {SPLIT.format(c='error')} AS error FROM e GROUP BY 1")
def predictions_wide(spark, d):
    return metrics.wide_predictions(events(spark, d), ["click", "error"], "value")


@query("SELECT event_id, hour(ts) AS hour, minute(ts) AS minute, CAST(second(ts) AS BIGINT) AS second, CAST(date_part('microsecond', ts) % 1000000 AS BIGINT) AS microsecond FROM events")
def clock_parts(spark, d):
    t = F.col("ts").cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", *(cal.part(u, t).alias(u) for u in ("hour", "minute", "second", "microsecond")))


@query(f"WITH {E_SQL} SELECT location, date_time, {', '.join(f'CAST(location = {chr(39)}{x}{chr(39)} AS INT) AS location__x0_{x}' for x in ('click', 'error', 'purchase', 'signup', 'view'))} FROM dom")
def location_columns(spark, d):
    grid = HOURS.grid(spark, event_places(spark, d))
    return grid.select(*KEYS, *cal.one_hot(F.col("location"), ["click", "error", "purchase", "signup", "view"], "location"))


@query(f"WITH {E_SQL} SELECT location, CAST(seconds AS BIGINT) AS seconds, count(*) AS n FROM (SELECT location, date_diff('second', lag(date_time) OVER (PARTITION BY location ORDER BY date_time), date_time) AS seconds FROM src) WHERE seconds IS NOT NULL GROUP BY 1, 2")
def step_changes(spark, d):
    return windows.step_changes(event_source(spark, d)).withColumn("seconds", F.col("seconds").cast("long"))


@query(f"WITH {E_SQL} SELECT location, date_time, CAST(date_diff('second', min(date_time) OVER (PARTITION BY location), date_time) AS BIGINT) AS delta_seconds, CAST(date_diff('second', TIMESTAMP '2024-01-01', date_time) AS BIGINT) AS since FROM src")
def elapsed_seconds(spark, d):
    out = windows.from_first(windows.from_first(event_source(spark, d)), "since", "2024-01-01")
    return out.select(*KEYS, F.col("delta_seconds").cast("long").alias("delta_seconds"), F.col("since").cast("long").alias("since"))


def _cut(v: str) -> str:
    return f"CASE WHEN {v} < 30 THEN 30.0 WHEN {v} > 60 THEN 60.0 ELSE {v} END"


@query(f"WITH {E_SQL} SELECT location, date_time, {_cut('value')} AS clamped, nullif(round(value / 100), 0) AS halves, {r('value - 273.15')} AS celsius FROM e")
def clamped_values(spark, d):
    v = F.col("value")
    return events(spark, d).select(*KEYS, clamp(v, 30.0, 60.0).alias("clamped"), zeros_to_null(F.round(v / 100)).alias("halves"), tidy(kelvin_to_celsius(v)).alias("celsius"))


@query(f"""WITH {E_SQL}, w AS (SELECT location, date_time, value, lag(value) OVER (PARTITION BY location ORDER BY date_time) AS lag_1_hour FROM e)
SELECT location, date_time, coalesce(value, 0.0) AS value, CAST(NULL AS DOUBLE) AS lag_1_hour FROM w WHERE value IS NOT NULL OR lag_1_hour IS NOT NULL""")
def filter_chain(spark, d):
    """Rows without both values dropped by a plain function, one feature dropped, one made null, one filled."""
    df = features.FeatureSpec(lags=("1 hour", "24 hours")).build(spark, HOURS, event_places(spark, d), event_source(spark, d))
    names = ["lag_1_hour", "lag_24_hour"]
    steps = [lambda x: x.filter("value IS NOT NULL OR lag_1_hour IS NOT NULL"), filters.drop_features([1], names), filters.nullify_features(["lag_1_hour"], names), filters.fill_zero(["value"])]
    return filters.chain(df, steps).select(*KEYS, "value", "lag_1_hour")


@query(INTERP.format(r(f"coalesce({LINE}, pv)")))
def filter_extrapolate(spark, d):
    return filters.chain(events(spark, d), [filters.interpolate_extrapolate(["value"])]).withColumn("value", tidy(F.col("value")))


@query(INTERP.format(r(LINE)))
def filter_interpolate(spark, d):
    return filters.chain(events(spark, d), [filters.interpolate_linear(["value"])]).withColumn("value", tidy(F.col("value")))


@query(f"WITH {E_SQL} SELECT location, date_time, {r('(value - avg(value) OVER ()) / nullif(stddev_pop(value) OVER (), 0)')} AS value FROM e")
def filter_scaler(spark, d):
    return filters.chain(events(spark, d), [filters.standard_scaler(["value"])]).withColumn("value", tidy(F.col("value")))


@query(f"""WITH {E_SQL}, n AS (SELECT *, row_number() OVER w AS i, lag(value) OVER w AS p, lead(value) OVER w AS q FROM e WINDOW w AS (PARTITION BY location ORDER BY date_time)),
k AS (SELECT location, date_time, coalesce(value, CASE WHEN i = 1 THEN q WHEN p IS NOT NULL AND q IS NOT NULL THEN (p + q) / 2 END) AS value FROM n)
SELECT location, date_time, {r("last_value(value IGNORE NULLS) OVER (PARTITION BY location ORDER BY date_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")} AS value FROM k""")
def pre_interpolated(spark, d):
    """Single gaps are filled from their neighbours before the last observation fills the rest."""
    first = windows.backfill_singleton(events(spark, d), "value")
    return windows.persist_last(first, "value").withColumn("value", tidy(F.col("value")))


@query(f"""WITH RECURSIVE {E_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY date_time) AS i FROM e),
f AS (SELECT location, i, value, [value] AS held FROM n WHERE i = 1 UNION ALL SELECT n.location, n.i, coalesce(n.value, list_avg(f.held)), list_append(f.held, coalesce(n.value, list_avg(f.held)))[-4:] FROM f JOIN n ON n.location = f.location AND n.i = f.i + 1)
SELECT n.location, n.date_time, {r("f.value")} AS value FROM n JOIN f USING (location, i)""")
def rolling_mean_fill(spark, d):
    """Gaps take the mean of the four rows before, earlier fills included: the method sees its window."""
    return windows.fill_rolling(events(spark, d), "value", lambda s: s.mean(), 3).withColumn("value", tidy(F.col("value")))


@query(f"""{LONG}, k AS (SELECT feature, count(*) AS n_obs, count(*) - count(value) AS n_missing, min(value) AS min, max(value) AS max, {r("quantile_cont(value, 0.5)")} AS q_0_5, {r("quantile_cont(value, 0.25)")} AS q_0_25, {r("quantile_cont(value, 0.75)")} AS q_0_75 FROM long GROUP BY 1)
SELECT s AS statistic, CAST(max(v) FILTER (feature = 'value') AS DOUBLE) AS value, CAST(max(v) FILTER (feature = 'lag_1_hour') AS DOUBLE) AS lag_1_hour FROM (SELECT feature, unnest(['n_obs', 'n_missing', 'min', 'max', 'q_0_25', 'q_0_5', 'q_0_75']) AS s, unnest([n_obs::DOUBLE, n_missing::DOUBLE, min, max, q_0_25, q_0_5, q_0_75]) AS v FROM k) GROUP BY 1""")
def stats_wide(spark, d):
    """Statistics as a wide frame, with other quantiles asked for."""
    df = features.FeatureSpec(lags=("1 hour",)).build(spark, HOURS, event_places(spark, d), event_source(spark, d))
    stats = monitor.feature_stats(df, ["value", "lag_1_hour"], quantiles=(0.5,)).withColumns({c: tidy(F.col(c)) for c in ("q_0_25", "q_0_5", "q_0_75")})
    return monitor.wide(stats.drop("fraction_missing", "n_trailing_missing", "mean"), ["value", "lag_1_hour"])


@query(f"""{LONG}, k AS (SELECT *, max(date_time) FILTER (value IS NOT NULL) OVER (PARTITION BY feature, location) AS last FROM long)
SELECT feature, location, count(*) AS n_obs, count(*) - count(value) AS n_missing, {r("(count(*) - count(value)) / count(*)")} AS fraction_missing, count(*) FILTER (last IS NULL OR date_time > last) AS n_trailing_missing, min(value) AS min, max(value) AS max FROM k GROUP BY 1, 2""")
def presence_stats(spark, d):
    df = features.FeatureSpec(lags=("1 hour",)).build(spark, HOURS, event_places(spark, d), event_source(spark, d))
    return monitor.presence_stats(df, ["value", "lag_1_hour"], True).withColumn("fraction_missing", tidy(F.col("fraction_missing")))


@query(f"""WITH {O_SQL}, yp AS (SELECT location, "true" / 1e5 AS y, predicted / 1e5 AS p FROM f WHERE "true" IS NOT NULL AND predicted IS NOT NULL)
SELECT location, round(avg(2 * (y * ln(y / p) - y + p)), 5) AS mean_poisson_deviance, round(avg(2 * (ln(p / y) + y / p - 1)), 5) AS mean_gamma_deviance, round(avg((y - p) * (y - p)), 5) AS mean_tweedie_deviance FROM yp GROUP BY 1""")
def metrics_deviance(spark, d):
    f = order_forecast(spark, d).select("location", (F.col("true") / 1e5).alias("true"), (F.col("predicted") / 1e5).alias("predicted"))
    return metrics.scored(f, by=["location"]).select("location", *(F.round(c, 5).alias(c) for c in ("mean_poisson_deviance", "mean_gamma_deviance", "mean_tweedie_deviance")))


#: A labelled score that both engines hold: whether an order is dear, by its share of the largest price, and ties from rounding.
RANKED = """SELECT CAST(o_totalprice > 200000 AS INT) AS y, CAST(o_orderpriority < '3' AS INT) AS p, round(o_totalprice % 1000) / 1000 AS q FROM orders"""


def _ranked(spark, d):
    o = table(spark, d, "orders")
    return o.select((F.col("o_totalprice") > 200000).cast("int").alias("y"), (F.col("o_orderpriority") < "3").cast("int").alias("p"), (F.round(F.col("o_totalprice") % 1000) / 1000).alias("q"))


@query(f"""WITH c AS ({RANKED}), n AS (SELECT count(*) FILTER (y = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (y = 0 AND p = 0)::DOUBLE AS tn, count(*) FILTER (y = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (y = 1 AND p = 0)::DOUBLE AS fn, count(*)::DOUBLE AS n, avg((q - y) ** 2) AS brier, avg(greatest(0.0, 1 - (2 * y - 1) * (2 * q - 1))) AS hinge, -avg(y * ln(least(greatest(q, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(q, 1e-15), 1 - 1e-15))) AS log_loss FROM c)
SELECT round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp + fn), 6) AS jaccard, round((fp + fn) / n, 6) AS hamming, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
round(((tp + tn) / n - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)) / (1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)), 6) AS kappa, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(brier, 6) AS brier, round(log_loss, 5) AS log_loss, round(hinge, 6) AS hinge FROM n""")
def classifier_metrics(spark, d):
    out = metrics.binary(_ranked(spark, d), "y", "p", "q")
    return out.select(*(F.round(c, 5 if c == "log_loss" else 6).alias(c) for c in out.columns))


@query(f"""WITH c AS ({RANKED}), s AS (SELECT q, sum(y) AS hits, count(*) AS n FROM c GROUP BY 1), w AS (SELECT q, hits, n, sum(hits) OVER o AS tp, sum(n) OVER o AS flagged, sum(hits) OVER () AS positives FROM s WINDOW o AS (ORDER BY q DESC ROWS UNBOUNDED PRECEDING)),
k AS (SELECT q, row_number() OVER (ORDER BY q DESC) AS i FROM c), g AS (SELECT q, sum(1 / log2(i + 1)) AS gain FROM k GROUP BY 1)
SELECT round(sum(hits * tp / flagged) / max(positives), 6) AS average_precision, round(sum(hits / n * gain), 4) AS dcg FROM w JOIN g USING (q)""")
def ranking_metrics(spark, d):
    out = metrics.ranking(_ranked(spark, d), "y", "q")
    return out.select(F.round("average_precision", 6).alias("average_precision"), F.round("dcg", 4).alias("dcg"))


@query(f"""WITH c AS ({RANKED}), s AS (SELECT q, sum(y) AS hits, count(*) AS n FROM c GROUP BY 1)
SELECT q AS score, CAST(sum(hits) OVER o AS BIGINT) AS tp, CAST(sum(n - hits) OVER o AS BIGINT) AS fp, CAST(sum(hits) OVER () - sum(hits) OVER o AS BIGINT) AS fn FROM s WINDOW o AS (ORDER BY q DESC ROWS UNBOUNDED PRECEDING)""")
def detection_trade_off(spark, d):
    return metrics.trade_off(_ranked(spark, d), "y", "q").select("score", "tp", "fp", "fn")


@query("""WITH c AS (SELECT o_orderpriority AS t, CASE WHEN o_totalprice > 150000 THEN o_orderpriority ELSE '1-URGENT' END AS p FROM orders), l AS (SELECT DISTINCT t AS label FROM c)
SELECT label, round(count(*) FILTER (t = label AND p = label) / count(*) FILTER (p = label), 6) AS "precision", round(count(*) FILTER (t = label AND p = label) / count(*) FILTER (t = label), 6) AS recall, round(2 * count(*) FILTER (t = label AND p = label) / (count(*) FILTER (t = label) + count(*) FILTER (p = label)), 6) AS f1, count(*) FILTER (t = label) AS support FROM l, c GROUP BY 1""")
def class_report(spark, d):
    p = F.when(F.col("o_totalprice") > 150000, F.col("o_orderpriority")).otherwise("1-URGENT")
    out = metrics.classes(table(spark, d, "orders").select(F.col("o_orderpriority").alias("true"), p.alias("predicted")))
    return out.select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"WITH {E_SQL} SELECT location, date_time, {r('avg(value) OVER (PARTITION BY location ORDER BY date_time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS mean FROM (SELECT location, date_time, src.value FROM (SELECT location, CAST(t AS TIMESTAMP) AS date_time FROM (SELECT DISTINCT location FROM dom), generate_series(TIMESTAMP '2024-01-02 22:00:00', TIMESTAMP '2024-01-06 01:00:00', INTERVAL 1 HOUR) g(t)) LEFT JOIN src USING (location, date_time)) QUALIFY date_time BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-05 23:00:00'")
def padded_rolling(spark, d):
    """A rolling mean whose first rows see what lies before the domain."""
    some = Domain("2024-01-03 00:00:00", "2024-01-05 23:00:00", "1 hour")

    def mean(wide: Domain) -> DataFrame:
        df = align.select(wide.grid(spark, event_places(spark, d)), event_source(spark, d).filter(wide.within()), ["value"])
        return df.select(*KEYS, tidy(F.avg("value").over(windows.over().rowsBetween(-2, 0))).alias("mean"))

    return with_padding(some, 2, mean)


@query("SELECT o_orderpriority, min(o_orderdate)::TIMESTAMP AS first FROM orders GROUP BY 1")
def distinct_in_order(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    return ordered_distinct(o, "o_orderpriority", "at")


@query("SELECT o_custkey, list_sort(list_distinct(flatten(list([o_orderpriority, o_orderstatus])))) AS kinds FROM orders GROUP BY 1")
def flat_sets(spark, d):
    lists = F.collect_list(F.array("o_orderpriority", "o_orderstatus"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(flatten_distinct(lists)).alias("kinds"))

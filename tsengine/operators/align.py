"""Aligning sources to a domain: left joins, location mappings, hierarchies, nearest grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsengine.functions.values import shift_longitude
from tsengine.operators.domain import KEYS


def select(domain: DataFrame, source: DataFrame, variables: list[str]) -> DataFrame:
    """The source at the domain's places and times as doubles; missing is null, further rows are dropped."""
    return domain.join(source.select(*KEYS, *variables), KEYS, "left").select(*KEYS, *(F.col(v).cast("double").alias(v) for v in variables))


def mapped(domain: DataFrame, mapping: DataFrame, source: DataFrame, variables: list[str]) -> DataFrame:
    """Like select, for sources keyed by another location: mapping has (location, mapped_location); unmapped gives nulls."""
    by_source = source.select(F.col("location").alias("mapped_location"), "date_time", *variables)
    return domain.join(mapping, "location", "left").join(by_source, ["mapped_location", "date_time"], "left").select(*KEYS, "mapped_location", *(F.col(v).cast("double").alias(v) for v in variables))


def unmapped(locations: DataFrame, mapping: DataFrame) -> DataFrame:
    return locations.join(mapping, "location", "left_anti")


def merge_mappings(old: DataFrame, new: DataFrame) -> DataFrame:
    """The union of two mappings; the new one wins."""
    return old.alias("o").join(new.alias("n"), "location", "full").select("location", F.coalesce("n.mapped_location", "o.mapped_location").alias("mapped_location"))


def rollup(hierarchy: DataFrame, series: DataFrame, variables: list[str]) -> DataFrame:
    """Children's values added up per (parent, date_time); null only where all are. hierarchy: (parent, child), many to many."""
    joined = hierarchy.join(series.withColumnRenamed("location", "child"), "child")
    return joined.groupBy(F.col("parent").alias("location"), "date_time").agg(*(F.sum(v).alias(v) for v in variables))


def outer(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "full")


#: Degrees of a block of cells. The ranges of latitude and shifted longitude bound the number of blocks: 24 by 46.
BLOCK = 8.0


def nearest_cells(sites: DataFrame, cells: DataFrame, degrees: float = 2.0) -> DataFrame:
    """(location, y, x): the cell with the smallest squared distance in degrees; ties go to the smallest (y, x).

    Both are bucketed by a grid of ``degrees``; a site looks at its own bucket and the eight around it, so the join is on
    equal buckets and exact for what it finds within ``degrees``. A site left over first weighs the blocks of cells, by
    their outlines (at most 24 * 46, one broadcast row): it joins only blocks whose nearest edge isn't farther than the
    farthest corner of another, so no site meets all cells. Sites without coordinates are left out.
    """
    sites = sites.filter("latitude IS NOT NULL AND longitude IS NOT NULL").withColumn("longitude", shift_longitude(F.col("longitude")))
    spots = cells.select("y", "x", F.col("latitude").alias("lat"), shift_longitude(F.col("longitude")).alias("lon"))
    distance = F.pow(F.col("lat") - F.col("latitude"), 2) + F.pow(F.col("lon") - F.col("longitude"), 2)

    def dealt(size: float) -> DataFrame:
        return spots.withColumn("bi", F.floor(F.col("lat") / size).cast("long")).withColumn("bj", F.floor(F.col("lon") / size).cast("long"))

    def best(looking: DataFrame, size: float) -> DataFrame:
        return looking.join(dealt(size), ["bi", "bj"]).groupBy("location").agg(F.min(F.struct(distance.alias("d"), "y", "x")).alias("b"))

    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    at = lambda c, near: F.floor(F.col(c) / degrees).cast("long") + F.col(near)
    close = sites.withColumn("near", F.explode(around)).withColumn("bi", at("latitude", "near.i")).withColumn("bj", at("longitude", "near.j"))
    found = best(close, degrees).filter(F.col("b.d") <= degrees**2)
    outlines = dealt(BLOCK).groupBy("bi", "bj").agg(*(f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("low", F.min), ("high", F.max))))
    every = outlines.agg(F.collect_list(F.struct("*")).alias("blocks"))
    apart = lambda x, low, high: F.greatest(low - x, x - high, F.lit(0.0))
    across = lambda x, low, high: F.greatest(x - low, high - x)

    def squared(block: Column, f) -> Column:
        return sum((F.pow(f(F.col(c), block[f"{n}_low"], block[f"{n}_high"]), 2) for c, n in (("latitude", "lat"), ("longitude", "lon"))), F.lit(0.0))

    left = sites.join(found, "location", "left_anti").crossJoin(F.broadcast(every))
    left = left.withColumn("most", F.array_min(F.transform("blocks", lambda b: squared(b, across))))
    left = left.withColumn("near", F.explode(F.filter("blocks", lambda b: squared(b, apart) <= F.col("most"))))
    far = best(left.select("location", "latitude", "longitude", F.col("near.bi").alias("bi"), F.col("near.bj").alias("bj")), BLOCK)
    return found.unionByName(far).select("location", "b.y", "b.x")


def at_cells(domain: DataFrame, cells_of: DataFrame, cube: DataFrame, variables: list[str], time: str = "valid_time") -> DataFrame:
    """A gridded cube's variables at each site's cell; sites without a cell give nulls."""
    values = cube.select("y", "x", F.col(time).alias("date_time"), *variables)
    return domain.join(cells_of, "location", "left").join(values, ["y", "x", "date_time"], "left").select(*KEYS, *(F.col(v).cast("double").alias(v) for v in variables))


def in_intervals(domain: DataFrame, intervals: DataFrame, step_seconds: int, name: str = "masked") -> DataFrame:
    """Flag domain rows that lie on the step grid of one of their location's closed intervals (location, start, end).

    Intervals on the same grid are merged where they overlap, cut to the domain's range and written out as times, which
    meet the domain by place and time: no row meets an interval that it isn't in. Intervals with a null end, or that end before they
    start, flag nothing.
    """
    micros = step_seconds * 1_000_000
    since = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c))
    span = domain.agg(F.min("date_time").alias("__low"), F.max("date_time").alias("__high"))  # one row
    near = intervals.join(F.broadcast(span), (F.col("start") <= F.col("end")) & (F.col("start") <= F.col("__high")) & (F.col("end") >= F.col("__low")))
    placed = near.select("location", F.pmod(since("start"), F.lit(micros)).alias("phase"), since("start").alias("a"), since("end").alias("b"), since("__low").alias("low"), since("__high").alias("high"))
    grid = Window.partitionBy("location", "phase")
    so_far = F.max("b").over(grid.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    merged = placed.withColumn("new", (so_far.isNull() | (F.col("a") > so_far)).cast("int")).withColumn("group", F.sum("new").over(grid.orderBy("a", "b")))
    merged = merged.groupBy("location", "phase", "group").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.first("low").alias("low"), F.first("high").alias("high"))
    first = F.greatest(F.col("a"), F.col("low") + F.pmod(F.col("phase") - F.col("low"), F.lit(micros)))
    last = F.least("b", "high")
    times = merged.filter(first <= last).select("location", F.explode(F.sequence(first, last, F.lit(micros))).alias("at")).distinct()
    flags = times.select("location", (F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("at").cast("decimal(24,6)") / 1_000_000)).alias("date_time"), F.lit(True).alias(name))
    return domain.join(flags, KEYS, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def squash_mask(df: DataFrame, value: str, mask: str, constant: float) -> DataFrame:
    """Keep the value where the mask is true, else the constant."""
    return df.withColumn(value, F.when(F.col(mask), F.col(value)).otherwise(F.lit(constant)))

"""Statistics of features and labels: presence, freshness, range, quantiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

QUANTILES = (0.05, 0.25, 0.75, 0.95)


def long(df: DataFrame, features: list[str]) -> DataFrame:
    return df.unpivot(["location", "date_time"], features, "feature", "value")


def spread_quantiles(df: DataFrame, features: list[str], wanted: list[float], ranges: int) -> DataFrame:
    """(feature, q_...): exact quantiles of each feature over all rows, without holding a feature's values in one task.

    Values are dealt into ranges by approximate cut points; the ranges' counts tell which ranges the quantiles lie in, and
    only these are put in order, each by itself. What is sent to the driver are cut points, counts of ranges (features
    times ranges) and two values for each quantile. df is read three times; persist it if it is costly.
    """
    cuts = dict(zip(features, df.approxQuantile(features, [i / ranges for i in range(1, ranges)], 0.5 / ranges), strict=True))
    known = F.create_map(*[x for f in features for x in (F.lit(f), F.array(*map(F.lit, sorted(set(cuts[f])))).cast("array<double>"))])
    rows = df.unpivot([], features, "feature", "value").filter("value IS NOT NULL")
    dealt = rows.withColumn("range", F.size(F.filter(F.element_at(known, F.col("feature")), lambda c: c <= F.col("value"))))
    sizes: dict[str, list] = {f: [] for f in features}
    for r in dealt.groupBy("feature", "range").agg(F.count("*").alias("n")).orderBy("feature", "range").collect():
        sizes[r.feature].append((r["range"], r.n))
    places = []  # feature, name, range, place in the range from 1, weight
    for f, held in sizes.items():
        n = sum(x for _, x in held)
        for q in wanted if n else []:
            at = q * (n - 1)
            for rank, weight in ((math.floor(at), 1 - at % 1), (math.floor(at) + 1, at % 1)):
                for number, x in held:
                    if 0 <= rank < x and weight:
                        places.append((f, f"q_{q:g}".replace(".", "_"), number, rank + 1, weight))
                    rank -= x
    chosen = df.sparkSession.createDataFrame(places, "feature string, name string, range int, place int, weight double")
    some = dealt.join(F.broadcast(chosen.select("feature", "range").distinct()), ["feature", "range"], "left_semi")  # at most two for each quantile
    ordered = some.withColumn("place", F.row_number().over(Window.partitionBy("feature", "range").orderBy("value")))
    found = ordered.join(F.broadcast(chosen), ["feature", "range", "place"])
    return found.groupBy("feature").pivot("name", [f"q_{q:g}".replace(".", "_") for q in wanted]).agg(F.sum(F.col("value") * F.col("weight")))


def quantile_name(q: float) -> str:
    return f"q_{q:g}".replace(".", "_")


def grouped_quantiles(df: DataFrame, value: str, keys: list[str], wanted: list[float], ranges: int | None = None) -> DataFrame:
    """(keys, q_...): exact quantiles of each group, interpolated between neighbours, without holding a group in one task.

    Equal values of a group are counted first. Cut points over all rows deal the values into ranges; a group's counts by
    range tell which ranges its quantiles lie in, and only these are put in order, a range of a group at a time: no more
    than about one range's share of all rows. Null and NaN values are left out; a group without others has no row.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value_of = F.col(value).cast("double")
    rows = df.filter(value_of.isNotNull() & ~F.isnan(value_of)).select(*keys, value_of.alias("__v"))
    cuts = sorted(set(rows.approxQuantile("__v", [i / n for i in range(1, n)], 0.5 / n))) if n > 1 else []
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("__v"))) if cuts else F.lit(0)
    counted = rows.groupBy(*keys, "__v").agg(F.count("*").alias("__n")).withColumn("__range", place)
    sizes = counted.groupBy(*keys, "__range").agg(F.sum("__n").alias("__n"))
    by = Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.coalesce(F.sum("__n").over(by.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = sizes.select(*keys, F.col("__range").alias("__r"), "__n", before.alias("__before"), F.sum("__n").over(by).alias("__all"))
    at = [F.lit(q) * (F.col("__all") - 1) for q in wanted]
    ends = [f(a).cast("long") for a in at for f in (F.floor, F.ceil)]
    holds = sum(((e >= F.col("__before")) & (e < F.col("__before") + F.col("__n"))).cast("int") for e in ends) > 0
    some = sized.filter(holds).drop("__n").withColumnsRenamed({k: f"__of_{i}" for i, k in enumerate(keys)})
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{i}"))
    joined = counted.join(some, same)
    walk = Window.partitionBy(*keys, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn("__first", F.col("__before") + F.coalesce(F.sum("__n").over(walk), F.lit(0)))
    hit = lambda e: F.max(F.when((e >= F.col("__first")) & (e < F.col("__first") + F.col("__n")), F.col("__v")))
    part = lambda a: F.max(a - F.floor(a))
    out = []
    for q, a in zip(wanted, at, strict=True):
        low, high = hit(F.floor(a).cast("long")), hit(F.ceil(a).cast("long"))
        out.append((low + (high - low) * part(a)).alias(quantile_name(q)))
    return placed.groupBy(*keys).agg(*out)


def feature_stats(df: DataFrame, features: list[str], by_location: bool = False, quantiles: tuple[float, ...] | None = QUANTILES, ranges: int | None = None) -> DataFrame:
    """Per feature (and location): n_obs, n_missing, fraction_missing, n_trailing_missing, mean, min, max and quantiles.

    The quartiles are always among the quantiles. Trailing missing rows are those after the last observation in time.
    A quantile holds the different values of its group in one task; where those of a whole feature are too many for that,
    ``ranges`` has them taken by spread_quantiles.
    """
    if ranges and quantiles is not None and not by_location:
        stats = feature_stats(df, features, False, None)
        return stats.join(F.broadcast(spread_quantiles(df, features, sorted({*quantiles, 0.25, 0.75}), ranges)), "feature", "left")  # one row per feature
    keys = ["feature", *(["location"] if by_location else [])]
    rows = long(df, features)
    # The last observations come from the wide rows, aggregated before they are unpivoted.
    seen = df.groupBy(*keys[1:]).agg(*(F.max(F.when(F.col(f).isNotNull(), F.col("date_time"))).alias(f) for f in features))
    first = seen.unpivot(keys[1:], features, "feature", "__last")
    trailing = F.count_if(F.col("__last").isNull() | (F.col("date_time") > F.col("__last")))
    aggs = [F.count("*").alias("n_obs"), F.count_if(F.col("value").isNull()).alias("n_missing"), (F.count_if(F.col("value").isNull()) / F.count("*")).alias("fraction_missing"), trailing.alias("n_trailing_missing")]
    aggs += [F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")]
    if quantiles is not None:
        wanted = sorted({*quantiles, 0.25, 0.75})
        aggs += [F.percentile("value", q).alias(f"q_{q:g}".replace(".", "_")) for q in wanted]
    return rows.join(F.broadcast(first) if not by_location else first, keys).groupBy(*keys).agg(*aggs)  # one row per feature


def presence_stats(df: DataFrame, features: list[str], by_location: bool = False) -> DataFrame:
    """What is watched while predicting: feature_stats without mean and quantiles."""
    return feature_stats(df, features, by_location, None).drop("mean")


def observed(df: DataFrame, features: list[str], name: str = "features") -> tuple[DataFrame, Observation]:
    """The frame, and an observation of how many values of each feature it held once it has been computed: no pass of its own."""
    watched = Observation(name)
    counts = [x for f in features for x in (F.count(f).alias(f"{f}_present"), F.min(f).alias(f"{f}_min"), F.max(f).alias(f"{f}_max"))]
    return df.observe(watched, F.count(F.lit(1)).alias("n_obs"), *counts), watched


def range_stats(df: DataFrame, value: str, end: str, ranges: int | None = None) -> DataFrame:
    """Per location and for all: last observation, freshness in seconds before ``end`` (for all: the smallest), presence, range, quartiles.

    The quartiles hold a group's different values in one task; with ``ranges`` they are taken by grouped_quantiles.
    """
    v = F.col(value)
    last = F.max(F.when(v.isNotNull(), F.col("date_time")))
    quartiles = [] if ranges else [F.percentile(v, 0.25).alias("q_25"), F.percentile(v, 0.75).alias("q_75")]
    stats = df.rollup("location").agg(
        F.grouping("location").alias("__all"), last.alias("most_recent_non_null"), F.count("*").alias("n_stats"), F.count_if(v.isNull()).alias("n_missing"), F.count(v).alias("n_present"),
        (F.count_if(v.isNull()) / F.count("*")).alias("fraction_missing"), F.avg(v).alias("mean"), F.min(v).alias("min"), *quartiles, F.max(v).alias("max"),
    )
    if ranges:
        each = grouped_quantiles(df, value, ["location"], [0.25, 0.75], ranges).select(F.lit(0).alias("__a"), F.col("location").alias("__l"), F.col("q_0_25").alias("q_25"), F.col("q_0_75").alias("q_75"))
        every = grouped_quantiles(df, value, [], [0.25, 0.75], ranges).select(F.lit(1).alias("__a"), F.lit(None).cast("string").alias("__l"), F.col("q_0_25").alias("q_25"), F.col("q_0_75").alias("q_75"))
        stats = stats.join(each.unionByName(every), (F.col("__all") == F.col("__a")) & F.col("location").eqNullSafe(F.col("__l")), "left").drop("__a", "__l")
    fresh = F.timestamp_diff("SECOND", F.col("most_recent_non_null"), F.lit(end).cast("timestamp_ntz"))
    return stats.withColumn("location", F.when(F.col("__all") == 1, F.lit("all")).otherwise(F.col("location"))).withColumn("freshness", fresh).drop("__all")


def wide(stats: DataFrame, feature_names: list[str]) -> DataFrame:
    """Statistics with a row per location and statistic and a column per feature."""
    metrics = [c for c in stats.columns if c not in ("feature", "location")]
    keys = [c for c in ("location",) if c in stats.columns]
    flat = stats.select("feature", *keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(["feature", *keys], metrics, "statistic", "value")
    return flat.groupBy(*keys, "statistic").pivot("feature", feature_names).agg(F.first("value"))


def standardize(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """z-scores with the population's standard deviation; a constant column is null."""
    w = Window.partitionBy(*(by or [F.lit(0)]))
    if by:
        return df.select("*", *(((F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0))).alias(f"{c}_z") for c in columns))
    one = df.agg(*(x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))))
    out = df.join(F.broadcast(one))  # one row
    return out.select(*df.columns, *(((F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0))).alias(f"{c}_z") for c in columns))

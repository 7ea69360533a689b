"""Making gaps, and scoring how they were filled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsengine.operators.windows import neighbours
from tsengine.session import cut


def random_gaps(df: DataFrame, value: str, n: int | None = None, fraction: float | None = None, seed: int = 32, mask: str = "synth_gap") -> DataFrame:
    """Mark n (or a fraction, rounded half to even) of each location's observations, chosen by a hash of seed, place and time."""
    if n is not None and fraction is not None:
        raise ValueError("give n or fraction, not both")
    if n is None and fraction is None:
        return df.withColumn(mask, F.lit(False))
    there = F.col(value).isNotNull()
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "location", F.date_format("date_time", "yyyy-MM-dd HH:mm:ss")).cast("binary"))
    by = Window.partitionBy("location")
    most = F.lit(n) if n is not None else F.bround(F.count(value).over(by) * fraction)
    rank = F.row_number().over(by.orderBy(F.when(there, 0).otherwise(1), order, "date_time"))
    return df.withColumn(mask, there & (rank <= most))


#: Rows of a place that are compared in one task are at least so many.
CHUNK = 4096


def independent(spots: DataFrame, apart: int) -> DataFrame:
    """Of (key, i, order), the spots that remain when they are taken in order and each excludes those less than ``apart`` away: key, i, order.

    Round by round: a spot that comes first of all within its reach would be taken whatever else happens, so all such
    spots are taken at once, and their neighbours go. That is the same set as one after the other, needs about as many rounds
    as the logarithm of the number of spots, and looks at a chunk of places with the ends of the next ones in a task. Order must be unique within a key.
    """
    size, reach = max(CHUNK, 8 * apart), 2 * (apart - 1)
    taken, open_spots = None, cut(spots)
    while not open_spots.isEmpty():
        chunks = F.array_distinct(F.array(*(F.floor((F.col("i") + d) / size) for d in (0, -reach, reach))))
        home = F.col("chunk") == F.floor(F.col("i") / size)
        near = Window.partitionBy("key", "chunk").orderBy("i").rangeBetween(-(apart - 1), apart - 1)
        dealt = open_spots.withColumn("chunk", F.explode(chunks)).withColumn("first", F.min("order").over(near) == F.col("order"))
        judged = cut(dealt.withColumn("excluded", F.max("first").over(near)).filter(home & (F.col("first") | ~F.col("excluded"))).drop("chunk", "excluded"))
        chosen = judged.filter("first").drop("first")
        taken, open_spots = chosen if taken is None else taken.unionByName(chosen), judged.filter("NOT first").drop("first")
    return open_spots if taken is None else taken


def block_gaps(df: DataFrame, value: str, size: int, n: int | None = None, fraction: float | None = None, attempts: int = 3, seed: int = 32, mask: str = "synth_gap", block: str | None = "30 days") -> DataFrame:
    """Mark n blocks (or int(fraction of the rows / size)) of ``size`` observed rows per location, with an observed, unmarked row before and after each that belongs to no other block.

    Blocks are drawn in the order of a hash of seed, place and time, each excluding those that it would touch (see
    ``independent``), so the result depends on the rows alone. A place where they don't fit is tried again with further
    seeds; where they never fit, reading the result raises an error. Times of a place must differ.
    """
    if n is not None and fraction is not None:
        raise ValueError("give n or fraction, not both")
    if n is None and fraction is None:
        return df.withColumn(mask, F.lit(False))
    lost = neighbours(df.withColumn("__lost", F.when(F.col(value).isNull(), 1.0)), "__lost", block=block)
    rows = lost.withColumn("__n", F.col("__here.i")).withColumn("__next_lost", F.col("__after.i")).drop("__here", "__before", "__after", "__lost")
    wanted = F.lit(n) if n is not None else F.floor(F.lit(fraction) * F.count("*") / size)
    places = df.groupBy("location").agg(F.count("*").alias("__rows"), wanted.cast("long").alias("__wanted")).withColumnRenamed("location", "__place")
    starts = rows.join(places, F.col("location").eqNullSafe(F.col("__place"))).filter((F.col("__wanted") > 0) & (F.col("__n") + size + 1 <= F.col("__rows")) & (F.col("__next_lost").isNull() | (F.col("__next_lost") > F.col("__n") + size + 1)))
    draw = F.md5(F.concat_ws("|", (F.lit(seed) + F.col("try")).cast("string"), F.coalesce("location", F.lit("")), F.date_format("date_time", "yyyy-MM-dd HH:mm:ss")).cast("binary"))
    spots = starts.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1)))).select(F.struct("location", "try").alias("key"), F.col("__n").alias("i"), F.struct(draw.alias("draw"), F.col("__n").alias("i")).alias("order"))
    ranked = independent(spots, size + 2).withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("order")))
    some = ranked.join(places, F.col("key.location").eqNullSafe(F.col("__place"))).filter(F.col("rank") <= F.col("__wanted"))
    full = some.filter(F.col("rank") == F.col("__wanted")).groupBy(F.col("key.location").alias("__of")).agg(F.min("key.try").alias("__try"))
    chosen = places.join(full, F.col("__place").eqNullSafe(F.col("__of")), "left").drop("__of")
    marks = some.select(F.col("key.location").alias("__marked"), F.col("key.try").alias("__of_try"), F.explode(F.sequence(F.col("i") + 1, F.col("i") + size)).alias("__i"))
    marks = marks.join(full, F.col("__marked").eqNullSafe(F.col("__of")) & (F.col("__of_try") == F.col("__try"))).select("__marked", "__i", F.lit(True).alias(mask))
    joined = rows.join(chosen, F.col("location").eqNullSafe(F.col("__place"))).join(marks, F.col("location").eqNullSafe(F.col("__marked")) & (F.col("__n") == F.col("__i")), "left")
    fits = F.when((F.col("__wanted") <= 0) | F.col("__try").isNotNull(), F.coalesce(mask, F.lit(False))).otherwise(F.raise_error(F.lit("the gaps don't fit")).cast("boolean"))
    return joined.select(*df.columns, fits.alias(mask))


def gaps_by_column(df: DataFrame, wanted: dict[str, dict], seed: int = 32) -> DataFrame:
    """A mask synth_gap_{column} for each column, from the arguments of random_gaps or, with a size, of block_gaps; each column draws by a seed of its own."""
    for i, (column, how) in enumerate(wanted.items()):
        make = block_gaps if "size" in how else random_gaps
        df = make(df, column, **{"seed": seed + i, "mask": f"synth_gap_{column}"} | how)
    return df


def with_gaps(df: DataFrame, value: str, mask: str = "synth_gap", name: str = "gapped") -> DataFrame:
    return df.withColumn(name, F.when(~F.col(mask), F.col(value)))


def score(df: DataFrame, actual: str, filled: str, mask: str = "synth_gap", by: list[str] | None = None) -> DataFrame:
    """Root mean square and median absolute error on marked rows, per series or pooled."""
    e = F.col(filled) - F.col(actual)
    aggs = [F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.median(F.abs(e)).alias("median_abs_error")]
    marked = df.filter(F.col(mask))
    return marked.groupBy(*by).agg(*aggs) if by else marked.agg(*aggs)

"""Making series: ordering, calendars, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailspark.contracts import finite


#: Positions that are renumbered together.
CHUNK = 65_536


def placed(df: DataFrame, order: list, part: Column) -> DataFrame:
    """Adds ``pos``, the row's number in its series by ``order``; ``part`` rises with the order and cuts a series into pieces.

    Pieces are counted first, then rows are numbered within their piece and moved by the pieces
    before: no task sorts more than a piece.
    """
    cut = df.withColumn("__part", part)
    sums = cut.groupBy("series_id", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("series_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("series_id").alias("__own"), F.col("__part").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("series_id", "__part").orderBy(*order)
    met = cut.withColumn("__row", F.row_number().over(within)).join(base, F.col("series_id").eqNullSafe(F.col("__own")) & F.col("__part").eqNullSafe(F.col("__of")))
    return met.withColumn("__pos", (F.col("__base") + F.col("__row") - 1).cast("long")).drop("__part", "__own", "__of", "__base", "__row")


def ordered(df: DataFrame, key: Column, order: list, value: Column, part: Column | None = None) -> DataFrame:
    """A series per key, numbered by ``order`` (which must be a total order); pieces are the days of its first column, or ``part``."""
    first = F.col(order[0]) if isinstance(order[0], str) else order[0]
    named = df.withColumn("series_id", key.cast("string")).withColumn("value", finite(value))
    return placed(named, order, first.cast("date") if part is None else part).select("series_id", F.col("__pos").alias("pos"), "value")


def compress(series: DataFrame, zeros: bool = False) -> DataFrame:
    """Positive (or non-negative) values only, positions renumbered without gaps."""
    kept = series.filter(F.col("value") >= 0 if zeros else F.col("value") > 0)
    return placed(kept, ["pos"], F.floor(F.col("pos") / CHUNK)).select("series_id", F.col("__pos").alias("pos"), "value")


def daily(df: DataFrame, key: Column, ts: Column, value: Column, how=F.sum) -> DataFrame:
    """(series_id, ts, value): one row for each day that occurs."""
    return df.select(key.cast("string").alias("series_id"), ts.cast("date").alias("ts"), finite(value).alias("value")).groupBy("series_id", "ts").agg(how("value").alias("value"))


def calendar(days: DataFrame) -> DataFrame:
    """(series_id, ts) for every day from a series' first to its last."""
    span = days.groupBy("series_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return span.select("series_id", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("ts"))


def zero_filled(days: DataFrame) -> DataFrame:
    """Daily values on the whole calendar, 0 where there is none."""
    return calendar(days).join(days, ["series_id", "ts"], "left").select("series_id", "ts", F.coalesce("value", F.lit(0.0)).alias("value"))


def numbered(days: DataFrame) -> DataFrame:
    return placed(days, ["ts"], F.year("ts")).select("series_id", F.col("__pos").alias("pos"), "value", "ts")


def keep_last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key by ``order``, an ingest ordinal."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def drop_partial_year(days: DataFrame, share: float = 0.9) -> DataFrame:
    """Without the last calendar year of a series if it has fewer than ``share`` of 365 rows."""
    year = F.year("ts")
    per_year = Window.partitionBy("series_id", year)
    last = Window.partitionBy("series_id")
    marked = days.withColumn("__n", F.count("*").over(per_year)).withColumn("__last", F.max(year).over(last))
    return marked.filter((year < F.col("__last")) | (F.col("__n") >= share * 365)).drop("__n", "__last")


def annual_maxima(days: DataFrame) -> DataFrame:
    return days.groupBy("series_id", F.year("ts").alias("year")).agg(F.max("value").alias("max_value"))


def seasonality(days: DataFrame) -> DataFrame:
    """Population deviation of the monthly means over the absolute overall mean; null for a mean near 0."""
    month = days.groupBy("series_id", F.month("ts").alias("m")).agg(F.avg("value").alias("mean"), F.sum("value").alias("s"), F.count("value").alias("n"))
    both = month.groupBy("series_id").agg(F.stddev_pop("mean").alias("sd"), (F.sum("s") / F.sum("n")).alias("mean"))
    return both.select("series_id", F.when(F.abs("mean") >= 1e-8, F.col("sd") / F.abs("mean")).alias("seasonality"))


def rolling_sum(days: DataFrame, width: int = 30) -> DataFrame:
    """Trailing sums over ``width`` rows once enough values are there."""
    w = Window.partitionBy("series_id").orderBy("ts").rowsBetween(1 - width, 0)
    enough = F.count("value").over(w) >= max(7, width // 3)
    return days.select("series_id", "ts", F.when(enough, F.sum("value").over(w)).alias("value"))


def day_anomaly(days: DataFrame) -> DataFrame:
    """Values standardised by the mean and sample deviation of their day of the year."""
    w = Window.partitionBy("series_id", F.dayofyear("ts"))
    sd = F.nullif(F.stddev_samp("value").over(w), F.lit(0.0))
    return days.select("series_id", "ts", ((F.col("value") - F.avg("value").over(w)) / sd).alias("value"))


def hot_dry(hot: DataFrame, rain: DataFrame, months: tuple[int, ...] = tuple(range(4, 11)), width: int = 30) -> DataFrame:
    """Compound severity of heat and drought from two daily series (series_id, ts, value) on their common calendar.

    Rolling sums first, the warm months after; severity is the sum of the positive parts of the
    heat anomaly and of the negated rain anomaly, and only positive severities stay.
    """
    span = hot.groupBy("series_id").agg(F.min("ts").alias("a1"), F.max("ts").alias("b1")).join(rain.groupBy("series_id").agg(F.min("ts").alias("a2"), F.max("ts").alias("b2")), "series_id")
    first, last = F.greatest("a1", "a2"), F.least("b1", "b2")
    days = span.filter(first <= last).select("series_id", F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("ts"))
    days = drop_partial_year(days)

    def side(values: DataFrame, name: str) -> DataFrame:
        full = days.join(values, ["series_id", "ts"], "left").select("series_id", "ts", "value")
        warm = rolling_sum(full, width).filter(F.month("ts").isin(*months))
        return day_anomaly(warm).withColumnRenamed("value", name)

    both = side(hot, "h").join(side(rain, "r"), ["series_id", "ts"])
    severity = F.greatest(F.coalesce("h", F.lit(0.0)), F.lit(0.0)) + F.greatest(F.coalesce(-F.col("r"), F.lit(0.0)), F.lit(0.0))
    return both.select("series_id", "ts", severity.alias("value")).filter("value > 0")


def deflated(amounts: DataFrame, index: DataFrame) -> DataFrame:
    """value * 100 / index of the year (year, cpi_2025_base); years without index go.

    The index has one row a year, so it may be broadcast.
    """
    cpi = F.broadcast(index.select(F.col("year").alias("__y"), F.col("cpi_2025_base").cast("double").alias("__c")))
    met = amounts.join(cpi, F.year("ts") == F.col("__y"))
    return met.withColumn("value", F.col("value") * 100 / F.col("__c")).drop("__y", "__c")

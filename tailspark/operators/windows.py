"""Sliding, disjoint and circular window extremes.

A sliding window belongs to the chunk of ``CHUNK`` positions in which it starts; each chunk
also holds the rows that its last windows reach into.  Chunks, not series, are what a task
sorts, so one series of any length spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65_536
#: Widths up to which one frame per width is cheaper than doubling.
FRAME_LIMIT = 128


def _chunked(series: DataFrame, reach: int) -> DataFrame:
    """Rows with their chunk, and copies of a chunk's first rows in the chunk before."""
    size = max(CHUNK, reach)
    own = F.floor(F.col("pos") / size)
    also = F.when((F.col("pos") % size < reach - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    return series.select("series_id", "pos", "value", own.alias("home"), F.explode(also).alias("chunk"))


def _framed(width: int, reducer: Callable[[str], Column]) -> Column:
    """The extreme of the complete, all-finite window that starts in the row, else null."""
    w = Window.partitionBy("series_id", "chunk").orderBy("pos").rowsBetween(0, width - 1)
    return F.when((F.count("*").over(w) == width) & (F.count("value").over(w) == width), reducer("value").over(w))


def sliding(series: DataFrame, widths: list[int], minimum: bool = False) -> DataFrame:
    """(series_id, pos, b, m): extremes of all complete windows of each width that hold finite values only.

    Widths below 2 have no windows.  Wide windows are put together from two of half their
    reach by doubling, so their cost does not grow with the width.
    """
    widths = sorted({int(b) for b in widths if b >= 2})
    if not widths:
        return series.select("series_id", "pos", F.lit(None).cast("long").alias("b"), F.col("value").alias("m")).limit(0)
    rows = _chunked(series, widths[-1])
    pair = F.least if minimum else F.greatest
    fill = F.lit(float("inf") if minimum else float("-inf"))
    order = Window.partitionBy("series_id", "chunk").orderBy("pos")
    frames = [b for b in widths if b <= FRAME_LIMIT]
    wide = [b for b in widths if b > FRAME_LIMIT]
    reducer = F.min if minimum else F.max
    rows = rows.select("*", *(_framed(b, reducer).alias(f"w{b}") for b in frames))
    if wide:
        levels = max(wide).bit_length() - 1
        rows = rows.withColumn("p0", F.coalesce("value", fill)).withColumn("bad", F.sum(F.col("value").isNull().cast("long")).over(order))
        for j in range(levels):
            rows = rows.withColumn(f"p{j + 1}", pair(F.col(f"p{j}"), F.lead(f"p{j}", 1 << j).over(order)))
        for b in wide:
            k = b.bit_length() - 1
            clean = F.lead("bad", b - 1).over(order) - F.col("bad") + F.col("value").isNull().cast("long") == 0
            rows = rows.withColumn(f"w{b}", F.when(clean, pair(F.col(f"p{k}"), F.lead(f"p{k}", b - (1 << k)).over(order))))
    long = F.explode(F.array(*(F.struct(F.lit(b).cast("long").alias("b"), F.col(f"w{b}").alias("m")) for b in widths)))
    return rows.filter("home = chunk").select("series_id", "pos", long.alias("x")).select("series_id", "pos", "x.b", "x.m").filter("m IS NOT NULL")


def sliding_on_grid(series: DataFrame, grid: DataFrame, minimum: bool = False) -> DataFrame:
    """Sliding extremes of each series at its own widths (series_id, b)."""
    widths = [r[0] for r in grid.select("b").distinct().collect()]  # whole numbers up to the largest block
    return sliding(series, widths, minimum).join(grid.select("series_id", "b"), ["series_id", "b"])


def disjoint_on_grid(series: DataFrame, grid: DataFrame, minimum: bool = False) -> DataFrame:
    """(series_id, b, block, m): extremes of complete, all-finite blocks from position 0."""
    block = F.floor(F.col("pos") / F.col("b"))
    reducer = F.min if minimum else F.max
    met = series.join(grid.select("series_id", "b"), "series_id").filter("b >= 2")
    blocks = met.groupBy("series_id", "b", block.alias("block")).agg(reducer("value").alias("m"), F.count("*").alias("n"), F.count("value").alias("ok"))
    return blocks.filter((F.col("n") == F.col("b")) & (F.col("ok") == F.col("b"))).select("series_id", "b", "block", "m")


def on_grid(series: DataFrame, grid: DataFrame, is_sliding: bool, minimum: bool = False) -> DataFrame:
    return (sliding_on_grid if is_sliding else disjoint_on_grid)(series, grid, minimum)


def circular(series: DataFrame, width: int) -> DataFrame:
    """(series_id, pos, m): maxima of the windows that wrap around the end; a missing value makes its windows null."""
    n = Window.partitionBy("series_id")
    sized = series.withColumn("n", F.count("*").over(n))
    again = sized.filter(F.col("pos") < width - 1).withColumn("pos", F.col("pos") + F.col("n"))
    w = Window.partitionBy("series_id").orderBy("pos").rowsBetween(0, width - 1)
    both = sized.unionByName(again).withColumn("m", F.when(F.count("value").over(w) == width, F.max("value").over(w)))
    return both.filter(F.col("pos") < F.col("n")).select("series_id", "pos", "m")


#: Most ranges that the values of one series are dealt to.
RANGES = 1_024


def _ranged(counts: DataFrame, total: DataFrame) -> DataFrame:
    """Adds ``range``, the place of a value among about even splits of its series' values; short series have one range."""
    splits = total.select(F.col("series_id").alias("own"), "n", "splits")
    met = counts.join(splits, F.col("series_id") == F.col("own")).drop("own")
    return met.withColumn("range", F.size(F.filter("splits", lambda s: s < F.col("value")))).drop("splits")


def ecdf_values(series: DataFrame) -> DataFrame:
    """(series_id, value, f): the empirical distribution at each distinct finite value.

    Values are counted, dealt to ranges of their series, summed up within each range, and moved
    by the counts of the ranges below.  Ranges part at the values whose hash is a multiple of
    ``CHUNK`` (thinned to ``RANGES`` at most): the plan reads them twice, and they must be the
    same both times, which approximate quantiles are not where partial results meet in another order.
    """
    finite = series.filter("value IS NOT NULL")
    bound = F.when(F.pmod(F.xxhash64("value"), F.lit(CHUNK)) == 0, F.col("value"))
    n = finite.groupBy("series_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(bound)).alias("all"))
    step = F.greatest(F.lit(1), F.ceil(F.size("all") / RANGES)).cast("int")
    total = n.select("series_id", "n", F.filter(F.col("all"), lambda s, i: i % step == 0).alias("splits"))
    counts = _ranged(finite.groupBy("series_id", "value").agg(F.count("*").alias("c")), total)
    sums = counts.groupBy("series_id", "range").agg(F.sum("c").alias("s"))
    below = Window.partitionBy("series_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("series_id").alias("own"), F.col("range").alias("r"), F.coalesce(F.sum("s").over(below), F.lit(0)).alias("base"))
    within = Window.partitionBy("series_id", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("c").over(within)).join(base, (F.col("series_id") == F.col("own")) & (F.col("range") == F.col("r")))
    f = F.when(F.col("n") == 1, F.lit(1.0)).otherwise((F.col("base") + F.col("upto")) / (F.col("n") + 1))
    return placed.select("series_id", "value", f.alias("f"))


def ecdf(series: DataFrame) -> DataFrame:
    """Adds f, the share of finite values up to a value, of n + 1; a single value counts as 0 below and 1 from it on."""
    f = ecdf_values(series).select(F.col("series_id").alias("own"), F.col("value").alias("v"), "f")
    finite = series.filter("value IS NOT NULL")
    return finite.join(f, (finite["series_id"] == F.col("own")) & (finite["value"] == F.col("v"))).drop("own", "v")


def ecdf_at(series: DataFrame, points: DataFrame) -> DataFrame:
    """eCDF of each series at foreign points (series_id, q): f is null for a series without values.

    Points and values are sorted together per series, so there is no join on ``<=``.
    """
    both = series.filter("value IS NOT NULL").select("series_id", F.col("value").alias("x"), F.lit(0).alias("kind")).unionByName(points.select("series_id", F.col("q").cast("double").alias("x"), F.lit(1).alias("kind")))
    w = Window.partitionBy("series_id").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    n = F.count_if(F.col("kind") == 0).over(Window.partitionBy("series_id"))
    upto = F.count_if(F.col("kind") == 0).over(w)
    f = F.when(n == 1, upto.cast("double")).when(n > 1, upto / (n + 1))
    return both.withColumn("f", f).filter("kind = 1").select("series_id", F.col("x").alias("q"), "f")

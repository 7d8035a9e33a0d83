"""Grids of block sizes, tail counts and dyadic scales, as expressions of a series' length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailspark.contracts import MIN_BLOCKS


def _geometric(lo: Column, hi: Column, steps: Column) -> Column:
    """Distinct whole numbers, rounded half to even, of a geometric grid from lo to hi."""
    at = F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(1)))
    values = F.transform(at, lambda i: F.rint(lo * F.pow(hi / lo, i / (steps - 1))).cast("long"))
    return F.array_distinct(values)


def block_sizes(n: Column, min_blocks: int = MIN_BLOCKS) -> Column:
    """Block sizes for n observations (null below 32)."""
    n = n.cast("double")
    # the double 0.2 lies above one fifth: an exact fifth power's root counts as just above a whole number
    lo = F.greatest(F.lit(5.0), F.ceil(F.pow(n, 0.2) * (1 + 1e-15)).cast("double"))
    hi = F.greatest(lo + 4, F.least(F.floor(F.pow(n, 0.55)), F.floor(n / max(min_blocks, 1))).cast("double"))
    steps = F.least(F.lit(32.0), F.greatest(F.lit(10.0), hi - lo + 1)).cast("int")
    return F.when(n >= 32, F.filter(_geometric(lo, hi, steps), lambda b: b > 1))


def tail_counts(n: Column, least: int = 8, share: float = 0.25, num: int = 24) -> Column:
    """Numbers of upper order statistics for tail estimators."""
    upper = F.least(F.greatest(F.lit(least + 2), F.floor(n * share)), n - 3).cast("double")
    lower = F.least(F.lit(float(least)), upper)
    return F.when(upper <= lower, F.array(lower.cast("long"))).otherwise(_geometric(lower, upper, F.lit(num)))


def spectrum_scales(n: Column, first: int = 1, blocks: int = 2) -> Column:
    """Dyadic scales j with at least ``blocks`` blocks of 2 ** j."""
    return F.filter(F.sequence(F.lit(first), F.lit(62)), lambda j: F.floor(n / F.pow(F.lit(2.0), j)) >= blocks)


def resample_block(n: int, least: int = 16) -> int:
    """Block length of the circular resampling."""
    return int(min(max(least, round(n**0.5)), n))


def grid_table(series: DataFrame, grid=block_sizes, name: str = "b") -> DataFrame:
    """(series_id, n, b) of every series by its number of rows."""
    n = series.groupBy("series_id").agg(F.count("*").alias("n"))
    return n.select("series_id", "n", F.explode(grid(F.col("n"))).alias(name))

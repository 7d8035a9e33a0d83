"""Schemas, defaults and checks shared by all operators.

A series is a long table (series_id, pos, value): ``pos`` counts from 0 without gaps and is
the order of time; ``value`` is null where the observation is missing or not finite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERIES = "series_id string, pos bigint, value double"
#: Defaults of the estimators.
TAU = 0.5
MIN_BLOCKS = 15
PLATEAU_POINTS = 5
TRIM = 0.15
CURVATURE = 2.0
STABLE_POINTS = 4
SHRINKAGE = 0.35
Z_95 = 1.96
Z_EXACT = 1.959963984540054
CHI2_95 = 3.841458820694124
TINY = 1e-8
DAYS_PER_YEAR = 365.25


def finite(col: Column | str) -> Column:
    """The value as a double, null if it is NaN or infinite."""
    v = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def same_set(df: DataFrame, column: str, expected: list) -> bool:
    """Whether the distinct values of a column are exactly ``expected`` (None apart)."""
    found = df.select(F.array_sort(F.collect_set(column)).alias("s")).first()[0]
    return found == sorted(expected)


def contract_ok(df: DataFrame, columns: set[str], expected: dict[str, list]) -> bool:
    """Whether a cached table has the columns and exactly the groups a run needs."""
    return columns <= set(df.columns) and all(same_set(df, c, v) for c, v in expected.items())


def positive_finite(series: DataFrame, least: int = 0, zeros: bool = False) -> DataFrame:
    """Positive (or non-negative) finite values of the series that keep at least ``least`` of them."""
    kept = series.filter(F.col("value") >= 0 if zeros else F.col("value") > 0).filter(finite("value").isNotNull())
    enough = kept.groupBy("series_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("series_id")
    return kept.join(enough, "series_id", "left_semi") if least else kept


def kept_counts(series: DataFrame, least: int = 0, zeros: bool = False) -> DataFrame:
    """(series_id, n, n_kept, reason): what ``positive_finite`` leaves, and why a series is left out (null if it is not)."""
    good = finite("value") >= 0 if zeros else finite("value") > 0
    n = series.groupBy("series_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(good, F.lit(False))).alias("n_kept"))
    return n.withColumn("reason", F.when(F.col("n_kept") < least, F.format_string(f"at least {least} values are needed, %d are left", "n_kept")))


def diagnostics(series: DataFrame) -> DataFrame:
    """Counts of missing, negative and non-positive values per series, instead of warnings on executors."""
    v = F.col("value")
    return series.groupBy("series_id").agg(
        F.count("*").alias("n"), F.count_if(v.isNull()).alias("n_missing"), F.count_if(v < 0).alias("n_negative"), F.count_if(v <= 0).alias("n_nonpositive")
    )

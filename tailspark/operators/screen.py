"""Screening of candidate series for severity and persistence analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailspark import series as prep
from tailspark.contracts import DAYS_PER_YEAR
from tailspark.functions.grid import grid_table
from tailspark.operators import persistence, resample, windows


def _facts(days: DataFrame) -> DataFrame:
    return days.groupBy("series_id").agg(
        F.count("*").alias("n_obs"), (F.datediff(F.max("ts"), F.min("ts")) / DAYS_PER_YEAR).alias("n_years"), F.min("ts").alias("start"), F.max("ts").alias("end"),
        F.avg((F.col("value") > 0).cast("double")).alias("positive_share"), F.avg((F.col("value") == 0).cast("double")).alias("zero_share"),
    )


def severity_screen(days: DataFrame, reps: int = 40, seed: int = 0, min_years: float = 20, min_points: int = 5, min_xi: float = -0.25, min_share: float = 0.95) -> DataFrame:
    """One row per dated series; a series that cannot be fitted has null estimates and is not recommended."""
    days = days.filter("value IS NOT NULL")
    s = prep.numbered(days).select("series_id", "pos", "value")
    fits = resample.estimate(s, reps=reps, seed=seed)
    first = fits.select("series_id", F.col("b_lo").alias("b"))
    share = windows.sliding_on_grid(s, first).groupBy("series_id").agg(F.avg((F.col("m") > 0).cast("double")).alias("maxima_positive_share"))
    met = _facts(days).join(prep.seasonality(days), "series_id", "left").join(fits.drop("c00", "c01", "c11"), "series_id", "left").join(share, "series_id", "left")
    ok = (F.col("n_years") >= min_years) & (F.col("n_points") >= min_points) & (F.col("xi_lo") >= min_xi) & (F.col("maxima_positive_share") >= min_share)
    return met.withColumn("support", F.coalesce(F.col("xi_lo") > 0, F.lit(False))).withColumn("recommended", F.coalesce(ok, F.lit(False)))


def persistence_screen(days: DataFrame, min_years: float = 20, zeros: bool = False) -> DataFrame:
    """Sliding bb path with ordinary least squares and K-gaps for every dated series."""
    days = days.filter("value IS NOT NULL")
    values = persistence.prepared(prep.numbered(days).select("series_id", "pos", "value"), zeros)
    grid = grid_table(values)
    bb = persistence.pooled(persistence.stable(persistence.path(values, "bb", True, grid)))
    bb = bb.select("series_id", F.col("theta").alias("theta_bb"), F.col("theta_lo").alias("theta_lo_bb"), F.col("theta_hi").alias("theta_hi_bb"), F.col("window_lo").alias("stable_lo"), F.col("window_hi").alias("stable_hi"))
    kg = persistence.k_gaps(values).select("series_id", F.col("theta").alias("theta_kg"), F.col("theta_lo").alias("theta_lo_kg"), F.col("theta_hi").alias("theta_hi_kg"))
    met = _facts(days).join(bb, "series_id", "left").join(kg, "series_id", "left")
    ok = (F.col("n_years") >= min_years) & F.col("theta_bb").isNotNull() & F.col("theta_kg").isNotNull() & (F.col("stable_lo") > 0)
    return met.withColumn("recommended", F.coalesce(ok, F.lit(False)))


#: Fixed value: lower bound of the tail index that marks a candidate which could not be screened.
FAILED = -999.0


def candidates(sites: DataFrame, days: DataFrame, **kwargs) -> DataFrame:
    """Every candidate (state_code, site_no, ...) with its severity screening by series_id = site_no.

    A candidate that cannot be screened stays as a row that is not recommended, with a lower
    bound of ``FAILED`` and the reason in ``error``; no series can make the others fail.
    """
    found = severity_screen(days, **kwargs)
    found = found.select(F.col("series_id").alias("__site"), *(c for c in found.columns if c != "series_id"))
    met = sites.join(found, sites["site_no"] == F.col("__site"), "left")
    error = (
        F.when(F.col("__site").isNull(), "no observations").when(F.col("n_obs") < 32, "too few observations")
        .when(F.col("xi").isNull(), "too few positive summaries").when(F.col("ci_variant") == "ols", "no bootstrap covariance")
    )
    failed = F.col("xi").isNull()
    out = met.withColumn("error", error).withColumn("xi_lo", F.when(failed, FAILED).otherwise(F.col("xi_lo")))
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("support", "recommended")}).drop("__site")

"""Severity: the extreme value index as the slope of log summaries on log block sizes, and design-life levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailspark.contracts import DAYS_PER_YEAR, PLATEAU_POINTS, TAU, Z_95
from tailspark.functions.arrays import mean, total
from tailspark.functions.grid import grid_table
from tailspark.operators import curves, select


def ols(windows: DataFrame) -> DataFrame:
    """Adds intercept, xi, se, xi_lo, xi_hi, the HC0 covariance c00, c01, c11, b_lo, b_hi and n_points to windows with ``part``."""
    mx, my = mean(F.col("part"), lambda p: p["x"]), mean(F.col("part"), lambda p: p["y"])
    centred = windows.withColumn("mx", mx).withColumn("my", my)
    sxx = total(F.col("part"), lambda p: (p["x"] - F.col("mx")) * (p["x"] - F.col("mx")))
    sxy = total(F.col("part"), lambda p: (p["x"] - F.col("mx")) * (p["y"] - F.col("my")))
    fit = centred.withColumn("sxx", sxx).withColumn("xi", F.try_divide(sxy, F.col("sxx"))).withColumn("intercept", F.col("my") - F.col("xi") * F.col("mx"))
    n = F.size("part")

    def pulls(p: Column) -> tuple[Column, Column, Column]:
        """Residual, and the weights of a point in the intercept and the slope."""
        v = (p["x"] - F.col("mx")) / F.col("sxx")
        return p["y"] - F.col("intercept") - F.col("xi") * p["x"], 1 / n - F.col("mx") * v, v

    def moment(i: int, j: int) -> Column:
        def one(p: Column) -> Column:
            e, *w = pulls(p)
            return e * e * w[i] * w[j]

        return total(F.col("part"), one)

    out = fit.withColumns({"c00": moment(0, 0), "c01": moment(0, 1), "c11": moment(1, 1)}).withColumn("se", F.sqrt(F.greatest("c11", F.lit(0.0))))
    return out.withColumns(
        {
            "xi_lo": F.col("xi") - Z_95 * F.col("se"),
            "xi_hi": F.col("xi") + Z_95 * F.col("se"),
            "b_lo": F.get("part", F.lit(0))["b"],
            "b_hi": F.element_at("part", -1)["b"],
            "n_points": n.cast("long"),
        }
    ).drop("mx", "my", "sxx")


def target_scaling(series: DataFrame, target: str = "quantile", tau: float = TAU, is_sliding: bool = True, grid: DataFrame | None = None, least: int = PLATEAU_POINTS) -> DataFrame:
    """One fit per series by ordinary least squares on its plateau.

    Series of fewer than 32 rows or finite values, or fewer than ``least`` positive summaries,
    have no row here; ``status`` of ``with_status`` names them.
    """
    enough = series.groupBy("series_id").agg(F.count("value").alias("ok")).filter("ok >= 32").select("series_id")
    grid = grid_table(series) if grid is None else grid
    rows = curves.curve(series, grid.join(enough, "series_id", "left_semi"), is_sliding, target, tau)
    return ols(select.plateau(curves.positive_points(rows), least))


def with_status(series: DataFrame, fits: DataFrame) -> DataFrame:
    """Every series with its fit, and a status that says why there is none."""
    n = series.groupBy("series_id").agg(F.count("value").alias("n_finite"))
    met = n.join(fits, "series_id", "left")
    status = F.when(F.col("n_finite") < 32, "too few observations").when(F.col("xi").isNull(), "too few positive summaries").otherwise("ok")
    return met.withColumn("status", status)


def design_life(fits: DataFrame, years: list[float], per_year: float = DAYS_PER_YEAR) -> DataFrame:
    """(series_id, years, level, level_lo, level_hi): levels of design lives, with delta-method intervals."""
    horizon = F.explode(F.array(*(F.lit(float(y)) for y in years)))
    each = fits.select("series_id", "intercept", "xi", "c00", "c01", "c11", horizon.alias("years")).filter("years > 0")
    x = F.ln(per_year * F.col("years"))
    mu = F.col("intercept") + F.col("xi") * x
    half = Z_95 * F.sqrt(F.greatest(F.col("c00") + 2 * F.col("c01") * x + F.col("c11") * x * x, F.lit(0.0)))
    return each.select("series_id", "years", F.exp(mu).alias("level"), F.exp(mu - half).alias("level_lo"), F.exp(mu + half).alias("level_hi"))


def shared_tau(series: DataFrame, taus: list[float], headline: float = TAU, is_sliding: bool = True) -> DataFrame:
    """(series_id, tau, intercept, xi): several quantiles on the headline quantile's plateau with its slope.

    All quantiles come from one pass over the maxima.
    """
    grid = grid_table(series)
    rows = curves.quantile_curves(series, grid, sorted({*taus, headline}), is_sliding).filter("value > 0")
    fits = ols(select.plateau(curves.positive_points(rows.filter(F.col("tau") == headline).withColumn("is_positive", F.lit(True)))))
    kept = fits.select("series_id", "xi", F.explode("part.b").alias("b"))
    met = rows.filter(F.col("tau").isin(taus)).join(kept, ["series_id", "b"])
    offset = F.ln("value") - F.col("xi") * F.ln(F.col("b").cast("double"))
    return met.groupBy("series_id", "tau", "xi").agg(F.avg(offset).alias("intercept")).select("series_id", "tau", "intercept", "xi")


def design_life_table(shared: DataFrame, years: list[float], per_year: float = DAYS_PER_YEAR) -> DataFrame:
    each = shared.select("*", F.explode(F.array(*(F.lit(float(y)) for y in years))).alias("years"))
    return each.select("series_id", "tau", "years", F.exp(F.col("intercept") + F.col("xi") * F.ln(per_year * F.col("years"))).alias("level"))


def window_variants(points: DataFrame, k: int = 3) -> DataFrame:
    """Fits on the k best plateaus of each series."""
    return ols(select.top_plateaus(points, k))


def envelope(variants: DataFrame, years: float, per_year: float = DAYS_PER_YEAR) -> DataFrame:
    """Smallest and largest design-life level over the window variants."""
    levels = variants.select("series_id", F.exp(F.col("intercept") + F.col("xi") * F.ln(F.lit(per_year * years))).alias("level"))
    return levels.groupBy("series_id").agg(F.min("level").alias("level_min"), F.max("level").alias("level_max"))


def observations_per_year(days: DataFrame) -> DataFrame:
    """Rows a year of each dated series."""
    years = F.greatest(F.datediff(F.max("ts"), F.min("ts")) / DAYS_PER_YEAR, F.lit(1.0))
    return days.groupBy("series_id").agg((F.count("*") / years).alias("per_year"))


#: Lanczos coefficients (g = 7, n = 9) of the gamma function.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def gamma(x: Column) -> Column:
    """Gamma function for x >= 0.5, as an expression."""
    y = x - 1
    series = F.lit(_LANCZOS[0]) + sum((F.lit(c) / (y + i) for i, c in enumerate(_LANCZOS[1:], 1)), F.lit(0.0))
    t = y + 7.5
    return 2.5066282746310002 * F.pow(t, y + 0.5) * F.exp(-t) * series


def gev_return_level(maxima: DataFrame, period: float) -> DataFrame:
    """(series_id, shape, scale, location, level): generalised extreme values fitted by L-moments to annual maxima."""
    from pyspark.sql import Window

    w = Window.partitionBy("series_id").orderBy("max_value")
    ranked = maxima.filter("max_value IS NOT NULL").select("series_id", F.col("max_value").alias("v"), F.row_number().over(w).alias("r"), F.count("*").over(Window.partitionBy("series_id")).alias("n"))
    r, n = F.col("r").cast("double"), F.col("n").cast("double")
    b = ranked.filter("n >= 4").groupBy("series_id").agg(F.avg("v").alias("b0"), F.avg((r - 1) / (n - 1) * F.col("v")).alias("b1"), F.avg((r - 1) * (r - 2) / ((n - 1) * (n - 2)) * F.col("v")).alias("b2"))
    l2, l3 = 2 * F.col("b1") - F.col("b0"), 6 * F.col("b2") - 6 * F.col("b1") + F.col("b0")
    c = 2 / (3 + F.try_divide(l3, l2)) - 0.6309297535714574
    k = 7.8590 * c + 2.9554 * c * c
    shaped = b.withColumns({"l2": l2, "k": k}).filter("l2 > 0").withColumn("g", gamma(1 + F.greatest("k", F.lit(-0.49))))
    flat = F.abs("k") < 1e-8
    scale = F.when(flat, F.col("l2") / 0.6931471805599453).otherwise(F.col("l2") * F.col("k") / ((1 - F.pow(F.lit(2.0), -F.col("k"))) * F.col("g")))
    placed = shaped.withColumn("scale", scale).withColumn("location", F.when(flat, F.col("b0") - 0.5772156649015329 * F.col("scale")).otherwise(F.col("b0") - F.col("scale") / F.col("k") * (1 - F.col("g"))))
    y = -F.ln(F.lit(1 - 1 / period))
    level = F.when(flat, F.col("location") - F.col("scale") * F.ln(y)).otherwise(F.col("location") + F.col("scale") / F.col("k") * (1 - F.pow(y, F.col("k"))))
    return placed.select("series_id", F.col("k").alias("shape"), "scale", "location", level.alias("level"))

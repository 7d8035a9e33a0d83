"""Summaries of block maxima: quantile, mean and mode curves over block sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailspark.contracts import TAU
from tailspark.operators import kernels, windows


def quantiles_by_rank(rows: DataFrame, keys: list[str], taus: list[float], value: str = "m") -> DataFrame:
    """(keys, tau, value): median-unbiased quantiles per group (h = (n + 1/3) tau + 1/3 within 1..n).

    By rank in one sort for all taus: it spills, and never collects a group.
    """
    w = Window.partitionBy(*keys).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = rows.select(*keys, value, F.row_number().over(w).alias("r"), n.alias("n"))

    def share(tau: float) -> tuple:
        h = F.least(F.greatest((F.col("n") + 1 / 3) * tau + 1 / 3, F.lit(1.0)), F.col("n").cast("double"))
        low = F.floor(h)
        part = F.when(F.col("r") == low, 1 - (h - low)).when(F.col("r") == low + 1, h - low).otherwise(0.0)
        return F.struct(F.lit(float(tau)).alias("tau"), part.alias("part"))

    used = ranked.select(*keys, value, F.explode(F.filter(F.array(*map(share, taus)), lambda s: s["part"] > 0)).alias("s"))
    return used.groupBy(*keys, F.col("s.tau").alias("tau")).agg(F.sum(F.col(value) * F.col("s.part")).alias("value"))


def quantile_by_rank(rows: DataFrame, keys: list[str], tau: float, value: str = "m") -> DataFrame:
    return quantiles_by_rank(rows, keys, [tau], value).drop("tau")


def mode(rows: DataFrame, keys: list[str], value: str = "m", points: int = 256) -> DataFrame:
    """Mode of positive values: the peak, on the original scale, of a Gaussian density of log1p values on a grid.

    Each value meets each of the ``points`` grid points once, in partial sums per group.
    """
    pos = rows.filter(F.col(value) > 0).select(*keys, F.log1p(value).alias("l"), F.col(value).alias("v"))
    s = pos.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_samp("l").alias("sd"), F.percentile("l", F.lit(0.75)).alias("q3"), F.percentile("l", F.lit(0.25)).alias("q1"), F.min("l").alias("lo"), F.max("l").alias("hi"), F.min("v").alias("only"))
    iqr = F.col("q3") - F.col("q1")
    sigma = F.least(F.col("sd"), F.when(iqr > 0, iqr / 1.349).otherwise(F.col("sd")))
    sigma = F.when(sigma > 0, sigma).otherwise(F.greatest("sd", F.lit(1e-3)))
    width = F.greatest(1.059 * sigma * F.pow(F.col("n").cast("double"), F.lit(-0.2)), F.lit(1e-3))
    grid = s.filter("n > 1").select(*keys, width.alias("h"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "lo", "hi")
    at = grid.select(*keys, "h", "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)).alias("g"))
    z = (F.col("g") - F.col("l")) / F.col("h")
    density = pos.join(at, keys).groupBy(*keys, "i", "g").agg((F.sum(F.exp(-0.5 * z * z)) * F.exp(-F.col("g"))).alias("d"))
    best = density.groupBy(*keys).agg(F.min(F.struct((-F.col("d")).alias("d"), "i", "g")).alias("best"))
    return best.select(*keys, F.expm1("best.g").alias("value")).unionByName(s.filter("n = 1").select(*keys, F.col("only").alias("value")))


def summarise(maxima: DataFrame, target: str, tau: float = TAU) -> DataFrame:
    """(series_id, b, value) of maxima (series_id, b, m)."""
    keys = ["series_id", "b"]
    if target == "mean":
        return maxima.groupBy(*keys).agg(F.avg("m").alias("value"))
    if target == "mode":
        return mode(maxima, keys)
    if target == "quantile":
        return quantile_by_rank(maxima, keys, tau)
    raise ValueError(f"Unsupported target: {target}")


def curve(series: DataFrame, grid: DataFrame, is_sliding: bool = True, target: str = "quantile", tau: float = TAU, engine: str | None = None) -> DataFrame:
    """(series_id, b, n_blocks, value, is_positive): a summary of block maxima for each block size.

    ``engine`` is ``arrow`` (the default for sliding windows: kernels on chunks) or ``native``
    (frames and ranks); disjoint blocks are one native aggregate.  Both give the same values.
    """
    if target not in ("quantile", "mean", "mode"):
        raise ValueError(f"Unsupported target: {target}")
    if is_sliding and engine != "native":
        rows = kernels.curve(series, grid, target, [tau])
        return rows.select("series_id", "b", "n_blocks", "value", F.coalesce(F.col("value") > 0, F.lit(False)).alias("is_positive"))
    return curve_of(windows.on_grid(series, grid, is_sliding), grid, target, tau)


def quantile_curves(series: DataFrame, grid: DataFrame, taus: list[float], is_sliding: bool = True) -> DataFrame:
    """(series_id, b, tau, value) of several quantiles in one pass."""
    if is_sliding:
        return kernels.curve(series, grid, "quantile", taus).filter("n_blocks > 0").select("series_id", "b", "tau", "value")
    return quantiles_by_rank(windows.on_grid(series, grid, is_sliding), ["series_id", "b"], taus)


def curve_of(maxima: DataFrame, grid: DataFrame, target: str = "quantile", tau: float = TAU) -> DataFrame:
    counts = maxima.groupBy("series_id", "b").agg(F.count("*").alias("n_blocks"))
    values = summarise(maxima, target, tau)
    all_b = grid.select("series_id", "b").join(counts, ["series_id", "b"], "left").join(values, ["series_id", "b"], "left")
    return all_b.select("series_id", "b", F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"), "value", F.coalesce(F.col("value") > 0, F.lit(False)).alias("is_positive"))


def targets(series: DataFrame, grid: DataFrame, is_sliding: bool = True, tau: float = TAU) -> DataFrame:
    """Wide table of the three summaries: series_id, b, median (or quantile_tau_x), mean, mode."""
    maxima = windows.on_grid(series, grid, is_sliding)
    name = "median" if tau == 0.5 else "quantile_tau_" + f"{tau:g}".replace(".", "_")
    out = grid.select("series_id", "b")
    for target, label in (("quantile", name), ("mean", "mean"), ("mode", "mode")):
        out = out.join(summarise(maxima, target, tau).withColumnRenamed("value", label), ["series_id", "b"], "left")
    return out


def positive_points(curve_rows: DataFrame) -> DataFrame:
    """series_id and pts, the sorted array of (b, x = ln b, y = ln value) of positive summaries (some tens)."""
    one = F.struct("b", F.ln(F.col("b").cast("double")).alias("x"), F.ln("value").alias("y"))
    return curve_rows.filter("is_positive").groupBy("series_id").agg(F.array_sort(F.collect_list(one)).alias("pts"))


def plot_data(points: DataFrame) -> DataFrame:
    """The points behind a scaling plot, one row each."""
    return points.select("series_id", F.explode("pts").alias("p")).select("series_id", "p.*")


def aligned(curve: DataFrame, wanted: DataFrame, value: str = "value") -> DataFrame:
    """A curve's values at wanted block sizes (series_id, b); a size that the curve lacks is an error."""
    have = curve.select("series_id", "b", F.col(value).alias("__value"), F.lit(True).alias("__found"))
    met = wanted.join(have, ["series_id", "b"], "left")
    lacking = F.raise_error(F.format_string("The curve of %s has no block size %s.", "series_id", F.col("b").cast("string"))).cast("double")
    return met.select(*wanted.columns, F.when(F.col("__found"), F.col("__value")).otherwise(lacking).alias(value))

"""Persistence: the extremal index from block-maxima paths and from threshold exceedances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailspark.contracts import TINY, Z_95
from tailspark.functions import intervals
from tailspark.functions.grid import grid_table
from tailspark.operators import kernels, select, windows
from tailspark.series import compress

PATHS = tuple((base, is_sliding) for base in ("northrop", "bb") for is_sliding in (False, True))
QUANTILES = (0.90, 0.95)
RUNS = (1, 2)


def prepared(series: DataFrame, zeros: bool = False) -> DataFrame:
    """Kept values with positions renumbered, for series of at least 32 of them."""
    kept = compress(series, zeros)
    enough = kept.groupBy("series_id").agg(F.count("*").alias("n")).filter("n >= 32").select("series_id")
    return kept.join(enough, "series_id", "left_semi")


def scores(values: DataFrame, base: str) -> DataFrame:
    """Values as scores: -ln F (northrop) or 1 - F (bb) of the clipped empirical distribution."""
    f = intervals.clip(F.col("f"), TINY, 1 - TINY)
    return windows.ecdf(values).select("series_id", "pos", (-F.ln(f) if base == "northrop" else 1 - f).alias("value"))


def statistics(values: DataFrame, grid: DataFrame, base: str, is_sliding: bool) -> DataFrame:
    """(series_id, b, s): block size times the least score of each window."""
    minima = windows.on_grid(scores(values, base), grid, is_sliding, minimum=True)
    return minima.select("series_id", "b", (F.col("b") * F.col("m")).alias("s"))


def _score_means(values: DataFrame, grid: DataFrame, is_sliding: bool) -> DataFrame:
    """(series_id, b, n_stat, northrop, bb): mean statistics of both paths from counts of window maxima.

    Scores fall as values rise, so a window's least score is the score of its largest value, and
    only distinct maxima need a place in the distribution.
    """
    if is_sliding:
        counts = kernels.maxima_counts(values, grid)
    else:
        counts = windows.disjoint_on_grid(values, grid).groupBy("series_id", "b", F.col("m").alias("value")).agg(F.count("*").alias("n"))
    clipped = intervals.clip(F.col("f"), TINY, 1 - TINY)
    means = {"northrop": -F.ln(clipped), "bb": 1 - clipped}
    met = counts.join(windows.ecdf_values(values), ["series_id", "value"]).groupBy("series_id", "b")
    return met.agg(F.sum("n").alias("n_stat"), *((F.col("b") * F.sum(score * F.col("n")) / F.sum("n")).alias(base) for base, score in means.items()))


def _as_path(stat: DataFrame, base: Column, is_sliding: bool) -> DataFrame:
    """theta, its inverse and its logarithm from the mean statistic of a path."""
    mean = F.greatest("mean_stat", F.lit(TINY))
    bb = intervals.clip(1 / mean - 1 / F.col("b"))
    eir = F.when(base == "northrop", F.greatest("mean_stat", F.lit(1.0))).otherwise(1 / bb)
    theta = F.when(base == "northrop", 1 / F.greatest("mean_stat", F.lit(1.0))).otherwise(bb)
    return stat.select("series_id", base.alias("base_path"), F.lit(is_sliding).alias("sliding"), "b", "n_stat", "mean_stat", theta.alias("theta"), eir.alias("eir"), F.ln(eir).alias("z"))


def path(values: DataFrame, base: str, is_sliding: bool, grid: DataFrame | None = None, engine: str | None = None) -> DataFrame:
    """(series_id, base_path, sliding, b, n_stat, mean_stat, theta, eir, z) of prepared values; ``engine`` as for curves."""
    grid = grid_table(values) if grid is None else grid
    if engine != "native":
        stat = _score_means(values, grid, is_sliding).withColumnRenamed(base, "mean_stat")
    else:
        stat = statistics(values, grid, base, is_sliding).groupBy("series_id", "b").agg(F.count("*").alias("n_stat"), F.avg("s").alias("mean_stat"))
    return _as_path(stat, F.lit(base), is_sliding)


def paths(values: DataFrame, keys=PATHS) -> DataFrame:
    """The requested paths, one below the other; both paths of a scheme come from one pass over its windows."""
    grid = grid_table(values)
    parts = []
    for is_sliding in sorted({s for _, s in keys}):
        bases = [b for b, s in keys if s == is_sliding]
        each = F.explode(F.array(*(F.struct(F.lit(b).alias("base"), F.col(b).alias("mean")) for b in bases))).alias("x")
        stat = _score_means(values, grid, is_sliding).select("series_id", "b", "n_stat", each).select("series_id", "b", "n_stat", F.col("x.base").alias("base"), F.col("x.mean").alias("mean_stat"))
        parts.append(_as_path(stat, F.col("base"), is_sliding))
    return reduce(DataFrame.unionByName, parts)


def path_points(rows: DataFrame) -> DataFrame:
    return rows.filter("z IS NOT NULL").groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("b", "z"))).alias("pts"))


def stable(rows: DataFrame) -> DataFrame:
    """series_id, window_lo, window_hi, selected_level (the first block size of the window), part."""
    best = select.stable_path(path_points(rows))
    first = F.get("part", F.lit(0))["b"]
    return best.select("series_id", first.alias("window_lo"), F.element_at("part", -1)["b"].alias("window_hi"), first.alias("selected_level"), "score", "start", "stop", "part")


def stable_paths(values: DataFrame, keys=PATHS, k: int = 1) -> DataFrame:
    """The ``k`` calmest windows of each requested path: base_path, sliding, rank and part."""
    grid = grid_table(values)

    def one(base: str, is_sliding: bool) -> DataFrame:
        tops = select.top_stable(path_points(path(values, base, is_sliding, grid)), k)
        return tops.select("series_id", F.lit(base).alias("base_path"), F.lit(is_sliding).alias("sliding"), "rank", "part")

    return reduce(DataFrame.unionByName, (one(b, s) for b, s in keys))


def pooled(windows_: DataFrame) -> DataFrame:
    """theta from the mean of z over a window (ordinary least squares), with a log-scale interval."""
    from tailspark.functions.arrays import mean, total

    z = mean(F.col("part"), lambda p: p["z"])
    n = F.size("part").cast("double")
    spread = total(F.col("part"), lambda p: (p["z"] - F.col("zbar")) * (p["z"] - F.col("zbar")))
    out = windows_.withColumn("zbar", z).withColumn("z_se", F.sqrt(F.try_divide(spread, n - 1) / n))
    lo, hi = intervals.log_theta(F.col("zbar"), F.col("z_se"))
    return out.withColumns({"theta": F.exp(-F.col("zbar")), "theta_lo": lo, "theta_hi": hi, "n_levels": F.size("part").cast("long")})


def bb_native(values: DataFrame, is_sliding: bool) -> DataFrame:
    """theta at the selected block size from the mean statistic, Wald interval cut to [0, 1]."""
    rows = path(values, "bb", is_sliding)
    level = stable(rows).select("series_id", F.col("selected_level").alias("b"))
    s = statistics(values, grid_table(values), "bb", is_sliding).join(level, ["series_id", "b"]).filter("s > 0")
    fit = s.groupBy("series_id", "b").agg(F.avg("s").alias("m"), F.stddev_samp("s").alias("sd"), F.count("*").alias("n")).filter("n >= 2")
    fit = fit.withColumn("theta", intervals.clip(1 / F.col("m") - 1 / F.col("b"))).withColumn("se", F.col("sd") / F.sqrt(F.col("n").cast("double")) / (F.col("m") * F.col("m")))
    lo, hi = intervals.unit_wald(F.col("theta"), F.col("se"))
    return fit.select("series_id", "b", "theta", lo.alias("theta_lo"), hi.alias("theta_hi"), "se")


def northrop_native(values: DataFrame, is_sliding: bool, adjusted: bool = False) -> DataFrame:
    """theta at the selected block size by pseudo-likelihood, profile interval; ``adjusted`` rescales by the score variance."""
    rows = path(values, "northrop", is_sliding)
    level = stable(rows).select("series_id", F.col("selected_level").alias("b"))
    s = statistics(values, grid_table(values), "northrop", is_sliding).join(level, ["series_id", "b"]).filter("s > 0")
    fit = s.groupBy("series_id", "b").agg(F.count("*").cast("double").alias("n"), F.sum("s").alias("total"), F.sum(F.col("s") * F.col("s")).alias("squares")).filter("n >= 2")
    fit = fit.withColumn("theta", intervals.clip(F.col("n") / F.col("total")))
    n, total, theta = F.col("n"), F.col("total"), F.col("theta")
    variance = n / (theta * theta) - 2 * total / theta + F.col("squares")
    scale = F.when(variance > 0, F.sqrt(n / (theta * theta) / variance)).otherwise(1.0) if adjusted else F.lit(1.0)
    fit = fit.withColumn("scale", scale)

    def loglik(t: Column) -> Column:
        moved = theta + F.col("scale") * (t - theta)
        return F.when((moved >= TINY) & (moved <= 1), n * F.ln(moved) - moved * total).otherwise(F.lit(float("-inf")))

    lo, hi = intervals.profile_interval(loglik, theta, F.lit(TINY), F.lit(1 - TINY))
    variant = "chandwich_adjusted" if adjusted else "profile"
    out = fit.select("series_id", "b", "theta", lo.alias("theta_lo"), hi.alias("theta_hi"), F.lit(variant).alias("ci_variant"))
    return out.withColumn("se", (F.col("theta_hi") - F.col("theta_lo")) / (2 * Z_95))


def exceedances(values: DataFrame, quantiles=QUANTILES) -> DataFrame:
    """(series_id, tau, u, n, pos, gap): positions strictly above the linear quantile, and the gap to the one before.

    Quantiles are aggregates per series, so values are read twice and never collected.
    """
    u = values.groupBy("series_id").agg(F.percentile("value", F.array(*map(F.lit, quantiles))).alias("q"), F.count("*").alias("n"))
    levels = u.select("series_id", "n", F.posexplode("q").alias("i", "u")).withColumn("tau", F.element_at(F.array(*map(F.lit, quantiles)), F.col("i") + 1))
    above = values.join(levels, "series_id").filter(F.col("value") > F.col("u"))
    w = Window.partitionBy("series_id", "tau").orderBy("pos")
    return above.select("series_id", "tau", "u", "n", "pos", (F.col("pos") - F.lag("pos").over(w)).alias("gap"))


def _fold(candidates: DataFrame, order: list[str]) -> DataFrame:
    """One candidate per series: the first unless a later one's interval lies apart from the kept one's."""
    fields = ["tau", "u", "run_k", "theta", "theta_lo", "theta_hi", "se"]
    one = F.struct(*order, *(c for c in fields if c not in order))
    listed = candidates.groupBy("series_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    return listed.select("series_id", _folded(F.col("c")).alias("c")).select("series_id", *(F.col(f"c.{f}") for f in fields))


def _folded(array: Column) -> Column:
    rest = F.slice(array, F.lit(2), F.greatest(F.size(array) - 1, F.lit(0)))

    def choose(a: Column, b: Column) -> Column:
        apart = (a["theta_lo"] > b["theta_hi"]) | (b["theta_lo"] > a["theta_hi"])
        return F.when(a["theta"].isNull() | (apart & b["theta"].isNotNull()), b).otherwise(a)

    return F.aggregate(rest, F.get(array, F.lit(0)), choose)


def ferro_segers(values: DataFrame, quantiles=QUANTILES) -> DataFrame:
    """Intervals estimator per threshold of at least three exceedances, folded over the thresholds."""
    t = exceedances(values, quantiles).groupBy("series_id", "tau", "u").agg(
        F.count("*").alias("n_exc"), F.max("gap").alias("most"),
        *(F.avg(x).alias(n) for n, x in _moments()), *(f(x, y).alias(n) for n, f, x, y in _spreads()), F.count("gap").cast("double").alias("n"),
    )
    t = t.filter("n_exc >= 3")
    small = F.col("most") <= 2
    part = lambda name: F.when(small, F.col(f"{name}_small")).otherwise(F.col(f"{name}_large"))
    t = t.select("series_id", "tau", "u", "n", part("a").alias("a"), part("b").alias("b"), part("va").alias("va"), part("vb").alias("vb"), part("cab").alias("cab"))
    a, b = F.col("a"), F.greatest("b", F.lit(TINY))
    ga, gb = 4 * a / b, -2 * a * a / F.greatest(F.col("b") * F.col("b"), F.lit(TINY))
    se = F.sqrt(F.greatest(ga * ga * F.col("va") + 2 * ga * gb * F.col("cab") + gb * gb * F.col("vb"), F.lit(0.0)) / F.col("n"))
    fit = t.withColumn("theta", intervals.clip(2 * a * a / b)).withColumn("se", se)
    lo, hi = intervals.unit_wald(F.col("theta"), F.col("se"))
    fit = fit.select("series_id", "tau", "u", F.lit(None).cast("int").alias("run_k"), "theta", lo.alias("theta_lo"), hi.alias("theta_hi"), "se")
    return _fold(fit, ["tau"])


def _pairs() -> dict[str, tuple[Column, Column]]:
    t = F.col("gap").cast("double")
    return {"small": (t, t * t), "large": (t - 1, (t - 1) * (t - 2))}


def _moments():
    return [(f"{n}_{kind}", x) for kind, xy in _pairs().items() for n, x in zip("ab", xy, strict=True)]


def _spreads():
    return [(f"{n}_{kind}", F.covar_samp, x, y) for kind, (a, b) in _pairs().items() for n, x, y in (("va", a, a), ("vb", b, b), ("cab", a, b))]


def k_gaps(values: DataFrame, quantiles=QUANTILES, runs=RUNS) -> DataFrame:
    """K-gaps likelihood per threshold and run parameter, folded over runs and then over thresholds.

    The maximum has a closed form: the smaller root of S t^2 - (n0 + 2 n1 + S) t + 2 n1 = 0.
    """
    each = exceedances(values, quantiles).withColumn("run_k", F.explode(F.array(*map(F.lit, runs))))
    excess = F.when(F.col("gap").isNotNull(), F.greatest(F.col("gap") - F.col("run_k"), F.lit(0)).cast("double"))
    t = each.groupBy("series_id", "tau", "u", "n", "run_k").agg(
        F.count("*").alias("n_exc"), F.count_if(excess <= 0).cast("double").alias("n0"), F.count_if(excess > 0).cast("double").alias("n1"), F.sum(excess).alias("total")
    )
    t = t.filter("n_exc >= 3").withColumn("s", F.col("total") * F.col("n_exc") / F.col("n"))
    n0, n1, s = F.col("n0"), F.col("n1"), F.col("s")
    a = n0 + 2 * n1 + s
    best = F.when(n1 == 0, F.lit(TINY)).otherwise(F.try_divide(a - F.sqrt(F.greatest(a * a - 8 * n1 * s, F.lit(0.0))), 2 * s))
    fit = t.withColumn("theta", intervals.clip(best, TINY, 1 - TINY))

    def loglik(x: Column) -> Column:
        return n0 * F.ln(F.greatest(1 - x, F.lit(TINY))) + F.when(n1 > 0, 2 * n1 * F.ln(x) - x * s).otherwise(0.0)

    lo, hi = intervals.profile_interval(loglik, F.col("theta"), F.lit(TINY), F.lit(1 - TINY))
    fit = fit.select("series_id", "tau", "u", "run_k", "theta", lo.alias("theta_lo"), hi.alias("theta_hi")).withColumn("se", (F.col("theta_hi") - F.col("theta_lo")) / (2 * Z_95))
    one = F.struct("run_k", "tau", "u", "theta", "theta_lo", "theta_hi", "se")
    inner = fit.groupBy("series_id", F.col("tau").alias("t")).agg(F.array_sort(F.collect_list(one)).alias("c")).select("series_id", _folded(F.col("c")).alias("c"))
    return _fold(inner.select("series_id", "c.*"), ["tau"])

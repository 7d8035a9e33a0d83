"""Application tables: several prepared series through severity and persistence fits to report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailspark import series as prep
from tailspark.functions.grid import grid_table
from tailspark.operators import curves, persistence, resample, score, screen, select, severity

#: Report quantiles and horizons.
TAUS = (0.5, 0.9, 0.95, 0.99)
YEARS = (1.0, 10.0, 25.0, 50.0)


#: Extremal-index methods of an application, and its replicates and seed.
EI_METHODS = ("bb_sliding_fgls", "northrop_sliding_fgls", "k_gaps", "ferro_segers")


def fits(days: DataFrame, reps: int = resample.REPS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Points and weighted fits of dated series (series_id, ts, value)."""
    s = prep.numbered(days).select("series_id", "pos", "value")
    points = curves.positive_points(curves.curve(s, grid_table(s)))
    return points, resample.fgls(s, severity.ols(select.plateau(points)), reps, seed)


def ei_fits(days: DataFrame, reps: int = resample.REPS, seed: int = 7, zeros: bool = False) -> DataFrame:
    """Four extremal-index estimates of every series, one row per series and method, with mean cluster size 1 / theta.

    Both pooled fits share one bank of resamples of the unfiltered series.
    """
    s = prep.numbered(days).select("series_id", "pos", "value")
    values = persistence.prepared(s, zeros)
    keys = (("bb", True), ("northrop", True))
    drawn = resample.path_draws(s, grid_table(values), reps, seed, zeros, keys)
    pooled = resample.pooled(persistence.stable_paths(values, keys), drawn)
    pooled = pooled.select("series_id", F.concat_ws("_", "base_path", F.lit("sliding_fgls")).alias("method"), "theta", "theta_lo", "theta_hi", F.col("z_se").alias("se"), "window_lo", "window_hi", F.lit("log_wald").alias("ci_method"), "ci_variant")
    none = [F.lit(None).cast("long").alias(c) for c in ("window_lo", "window_hi")]
    other = lambda df, m, ci: df.select("series_id", F.lit(m).alias("method"), "theta", "theta_lo", "theta_hi", "se", *none, F.lit(ci).alias("ci_method"), F.lit("default").alias("ci_variant"))
    rows = pooled.unionByName(other(persistence.k_gaps(values), "k_gaps", "profile")).unionByName(other(persistence.ferro_segers(values), "ferro_segers", "wald"))
    return rows.withColumn("mean_cluster_size", 1 / F.col("theta"))


def ei_window_fits(days: DataFrame, k: int = 3, reps: int = resample.REPS, seed: int = 7, zeros: bool = False) -> DataFrame:
    """Pooled weighted fits on the ``k`` calmest windows of the sliding northrop path, on one bank."""
    s = prep.numbered(days).select("series_id", "pos", "value")
    values = persistence.prepared(s, zeros)
    keys = (("northrop", True),)
    drawn = resample.path_draws(s, grid_table(values), reps, seed, zeros, keys)
    return resample.pooled(persistence.stable_paths(values, keys, k), drawn)


def evi_window_fits(days: DataFrame, k: int = 3, reps: int = resample.REPS, seed: int = 7) -> DataFrame:
    """Weighted fits on the ``k`` best plateaus, on one curve and one set of draws."""
    s = prep.numbered(days).select("series_id", "pos", "value")
    grid = grid_table(s)
    tops = severity.window_variants(curves.positive_points(curves.curve(s, grid)), k)
    return resample.weighted(tops, resample.draws(resample.banks(s, grid), reps, seed))


def method_rows(days: DataFrame, reps: int = resample.REPS, seed: int = 7, taus=TAUS) -> DataFrame:
    """Severity rows by method: the sliding median fit as one row per quantile on its plateau and slope, with one- and
    ten-year levels; fits of other targets as one row without levels."""
    from tailspark.plans import benchmark

    s = prep.numbered(days).select("series_id", "pos", "value")
    rows = benchmark.evi_factorial(s, reps=reps, seed=seed, schemes=("sliding",)).withColumnsRenamed({"b_lo": "plateau_lo", "b_hi": "plateau_hi"}).drop("se")
    shared = severity.shared_tau(s, list(taus)).select("series_id", "tau", F.col("intercept").alias("offset"), F.col("xi").alias("slope"))
    levels = shared.join(severity.observations_per_year(days), "series_id")
    at = lambda y: F.exp(F.col("offset") + F.col("slope") * F.ln(F.lit(float(y)) * F.col("per_year")))
    levels = levels.select("series_id", "tau", at(1).alias("level_1y"), at(10).alias("level_10y"))
    median = F.col("method") == "sliding_median_ols"
    met = rows.filter(median).join(levels, "series_id").withColumn("is_headline_tau", F.abs(F.col("tau") - 0.5) < 1e-9)
    return met.withColumn("shared_xi", F.lit(True)).unionByName(rows.filter(~median).withColumns({"shared_xi": F.lit(False), "is_headline_tau": F.lit(False)}), allowMissingColumns=True)


def summary(evi_days: DataFrame, ei_days: DataFrame, reps: int = resample.REPS, zeros: bool = False) -> DataFrame:
    """One row per series: tail index, ten-year level with interval and window envelope, extremal index, cluster size."""
    points, fit = fits(evi_days, reps)
    per_year = severity.observations_per_year(evi_days)
    sized = fit.join(per_year, "series_id")
    x = F.ln(10.0 * F.col("per_year"))
    mu, half = F.col("intercept") + F.col("xi") * x, 1.96 * F.sqrt(F.greatest(F.col("c00") + 2 * F.col("c01") * x + F.col("c11") * x * x, F.lit(0.0)))
    rows = sized.select("series_id", "xi", "xi_lo", "xi_hi", "b_lo", "b_hi", "ci_variant", F.exp(mu).alias("dll10"), F.exp(mu - half).alias("dll10_lo"), F.exp(mu + half).alias("dll10_hi"))
    values = persistence.prepared(prep.numbered(ei_days).select("series_id", "pos", "value"), zeros)
    theta = persistence.pooled(persistence.stable(persistence.path(values, "bb", True))).select("series_id", "theta", "theta_lo", "theta_hi", (1 / F.col("theta")).alias("mean_cluster_size"))
    envelope = severity.envelope(severity.window_variants(points), 10.0)
    return rows.join(envelope, "series_id", "left").join(theta, "series_id", "left")


def design_life_rows(days: DataFrame, taus=TAUS, years=YEARS) -> DataFrame:
    """Long table of levels by quantile and horizon on the headline plateau."""
    s = prep.numbered(days).select("series_id", "pos", "value")
    return severity.design_life_table(severity.shared_tau(s, list(taus)), list(years))


def window_sensitivity(days: DataFrame, k: int = 3) -> DataFrame:
    """Extremal index on the k best windows of the sliding northrop path."""
    values = persistence.prepared(prep.numbered(days).select("series_id", "pos", "value"))
    tops = select.top_stable(persistence.path_points(persistence.path(values, "northrop", True)), k)
    return persistence.pooled(tops).select("series_id", "rank", F.get("part", F.lit(0))["b"].alias("window_lo"), F.element_at("part", -1)["b"].alias("window_hi"), "theta", "theta_lo", "theta_hi")


def display(summaries: DataFrame) -> DataFrame:
    """Text cells for a report."""
    cell = lambda a: score.interval_text(F.col(a), F.col(f"{a}_lo"), F.col(f"{a}_hi"))
    return summaries.select("series_id", cell("xi").alias("xi"), cell("dll10").alias("dll10"), cell("theta").alias("theta"), score.compact(F.col("mean_cluster_size")).alias("cluster_size"))


def screened(days: DataFrame, min_years: float = 20) -> DataFrame:
    """Severity screening in report order."""
    return screen.severity_screen(days, min_years=min_years).orderBy(F.desc("recommended"), F.desc("support"), F.desc("n_years"), F.desc("n_points"), "series_id")


def plot_data(points: DataFrame, fit: DataFrame) -> DataFrame:
    """Scaling-plot rows: points, whether they lie on the plateau, and the fitted line."""
    met = curves.plot_data(points).join(fit.select("series_id", "intercept", "xi", "b_lo", "b_hi"), "series_id", "left")
    return met.select("series_id", "b", "x", "y", F.col("b").between(F.col("b_lo"), F.col("b_hi")).alias("on_plateau"), (F.col("intercept") + F.col("xi") * F.col("x")).alias("fitted"))


def selection_sensitivity(evi_days: DataFrame, ei_days: DataFrame, k: int = 3, reps: int = resample.REPS) -> DataFrame:
    """Per series: the headline tail and extremal index, and their range over the ``k`` best windows."""
    evi = evi_window_fits(evi_days, k, reps).groupBy("series_id").agg(F.max(F.when(F.col("rank") == 1, F.col("xi"))).alias("xi"), F.min("xi").alias("xi_min"), F.max("xi").alias("xi_max"), F.count("*").alias("n_windows"))
    ei = ei_window_fits(ei_days, k, reps).groupBy("series_id").agg(F.max(F.when(F.col("rank") == 1, F.col("theta"))).alias("theta"), F.min("theta").alias("theta_min"), F.max("theta").alias("theta_max"))
    return evi.join(ei, "series_id", "left")


def path_plot_data(values: DataFrame, base: str = "northrop", is_sliding: bool = True) -> DataFrame:
    """Rows of an extremal-index plot: log block size, theta, and whether the point lies in the stable window.

    Series without any finite point have no row.
    """
    rows = persistence.path(values, base, is_sliding)
    window = persistence.stable(rows).select("series_id", "window_lo", "window_hi")
    met = rows.filter("z IS NOT NULL AND NOT isnan(z)").join(window, "series_id", "left")
    return met.select("series_id", "b", F.ln(F.col("b").cast("double")).alias("x"), "theta", F.coalesce(F.col("b").between(F.col("window_lo"), F.col("window_hi")), F.lit(False)).alias("in_window"))


def reported(rows: DataFrame, keys: list[str], column: str = "series_id") -> DataFrame:
    """Rows of the report's applications, with their place in its order."""
    return score.in_order(rows, column, keys, keep_others=False)


def build(role_rows: DataFrame, folder: str, reps: int = resample.REPS) -> dict[str, str]:
    """All application tables from prepared series in their roles, written below ``folder``; the paths, also as a manifest table."""
    role = lambda name: role_rows.filter(F.col("role") == name).select("series_id", "ts", "value")
    evi, ei = role("evi"), role("ei")
    tables = {
        "summary": summary(evi, ei, reps), "design_life": design_life_rows(evi), "methods": method_rows(evi, reps), "ei_methods": ei_fits(ei, reps, zeros=False),
        "windows": window_sensitivity(ei), "selection": selection_sensitivity(evi, ei, reps=reps), "screening": screened(evi, min_years=5),
    }
    paths = {}
    for name, table in tables.items():
        paths[name] = f"{folder}/{name}"
        table.write.mode("overwrite").parquet(paths[name])
    spark = role_rows.sparkSession
    spark.createDataFrame(sorted(paths.items()), "table string, path string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return paths


#: Characters that LaTeX reads as commands.
_LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex_escape(text: object) -> str:
    return "".join(_LATEX.get(c, c) for c in str(text))


def latex_table(table: DataFrame, caption: str, label: str, most_rows: int = 1_000) -> str:
    """A report table as LaTeX; the table is a finished small one, and a larger one than ``most_rows`` is refused."""
    rows = table.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"More than {most_rows} rows are no report table.")
    lines = [" & ".join("" if v is None else latex_escape(v) for v in r) + r" \\" for r in rows]
    head = " & ".join(map(latex_escape, table.columns)) + r" \\"
    return "\n".join(
        [r"\begin{table}[htbp]", r"\centering", rf"\caption{{{latex_escape(caption)}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(table.columns)}}}", r"\toprule", head, r"\midrule", *lines, r"\bottomrule", r"\end{tabular}", r"\end{table}"]
    )

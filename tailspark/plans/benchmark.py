"""Method comparisons on simulated series: factorials, sensitivity grids, cached tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailspark.contracts import contract_ok
from tailspark.functions.grid import grid_table
from tailspark.operators import curves, persistence, resample, score, select, severity, simulate, tail

#: Shrinkage and record-length grids of the sensitivity tables.
SHRINKAGES = (0.0, 0.2, 0.35, 0.5, 0.75, 1.0)
LENGTHS = (200, 365, 730)
_ROW = ["series_id", "method", "xi", "se", "xi_lo", "xi_hi", "b_lo", "b_hi", "ci_variant"]


def stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def evi_factorial(series: DataFrame, tau: float = 0.5, reps: int = resample.REPS, seed: int = 7, schemes=("disjoint", "sliding"), targets=("median", "mean", "mode")) -> DataFrame:
    """Scheme x target x regression.  All targets of a scheme share the maxima, the draws and one pass of fits."""
    grid = grid_table(series)
    kinds = {t: "quantile" if t == "median" else t for t in targets}
    out = []
    for scheme in schemes:
        is_sliding = scheme == "sliding"
        plateaus = stack([severity.ols(select.plateau(curves.positive_points(curves.curve(series, grid, is_sliding, k, tau)))).withColumn("target", F.lit(k)) for k in kinds.values()])
        drawn = resample.draws(resample.banks(series, grid, is_sliding), reps, seed, tuple(kinds.values()), tau)
        both = resample.weighted(plateaus, drawn, by=("series_id", "target"), ordinary=True)
        label = F.when(F.col("target") == "quantile", "median").otherwise(F.col("target"))
        out.append(both.withColumn("method", F.concat_ws("_", F.lit(scheme), label, "regression")).select(*_ROW))
    return stack(out)


#: Interval methods of the extremal-index estimators.
EI_CI = {"northrop_native": "profile", "bb_native": "wald", "k_gaps": "profile", "ferro_segers": "wald"}
_EI_ROW = ["series_id", "method", "theta", "theta_lo", "theta_hi", "ci_variant", "window_lo", "window_hi", "tau", "run_k"]


def _ei_rows(found: DataFrame, method, variant) -> DataFrame:
    """Rows of one estimator in the common columns; what it has not is null."""
    kinds = {"window_lo": "long", "window_hi": "long", "tau": "double", "run_k": "int"}
    named = found.withColumns({"method": method, "ci_variant": variant})
    return named.select(*(F.col(c) if c in named.columns else F.lit(None).cast(kinds[c]).alias(c) for c in _EI_ROW))


def _pooled_label():
    scheme = F.when(F.col("sliding"), "sliding").otherwise("disjoint")
    return F.concat_ws("_", "base_path", scheme, "regression")


def ei_methods(series: DataFrame, zeros: bool = False, reps: int = resample.REPS, seed: int = 7) -> DataFrame:
    """Eight pooled estimates (path x scheme x regression) and four others, one row per series and method.

    All pooled estimates share one bank of resamples.
    """
    values = persistence.prepared(series, zeros)
    drawn = resample.path_draws(series, grid_table(values), reps, seed, zeros, persistence.PATHS)
    both = resample.pooled(persistence.stable_paths(values), drawn, ordinary=True)
    out = [_ei_rows(both, _pooled_label(), F.col("ci_variant"))]
    native = {"northrop_native": persistence.northrop_native(values, True), "bb_native": persistence.bb_native(values, True)}
    for m, found in native.items():
        out.append(_ei_rows(found.withColumns({"window_lo": F.col("b"), "window_hi": F.col("b")}), F.lit(m), F.lit(EI_CI[m])))
    out.append(_ei_rows(persistence.k_gaps(values), F.lit("k_gaps"), F.lit("default")))
    out.append(_ei_rows(persistence.ferro_segers(values), F.lit("ferro_segers"), F.lit("default")))
    return stack(out)


def _scored(found: DataFrame, table: DataFrame, ids: DataFrame, hat: str, truth: str) -> DataFrame:
    met = found.join(ids, "series_id").join(table.drop("reps", "seed"), "scenario")
    named = met.withColumnsRenamed({hat: f"{hat}_hat", f"{hat}_lo": "ci_lo", f"{hat}_hi": "ci_hi"})
    return score.errors(named, truth, f"{hat}_hat")


def _simulated(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = simulate.simulate(table)
    return rows.select("series_id", "pos", "value"), rows.select("series_id", "scenario", "rep").distinct()


def evaluate_evi(table: DataFrame, **kwargs) -> DataFrame:
    """Replicate-level results of the factorial over a scenario table."""
    series, ids = _simulated(table)
    return _scored(evi_factorial(series, **kwargs), table, ids, "xi", "xi_true")


def evaluate_external(table: DataFrame) -> DataFrame:
    series, ids = _simulated(table)
    return _scored(tail.all_estimators(series), table, ids, "xi", "xi_true")


def evaluate_ei(table: DataFrame, **kwargs) -> DataFrame:
    series, ids = _simulated(table)
    return _scored(ei_methods(series, **kwargs), table, ids, "theta", "theta_true")


def shrinkage_sensitivity(table: DataFrame, shrinkages=SHRINKAGES, reps: int = resample.REPS) -> DataFrame:
    """Median error, coverage and score of the sliding median fit by shrinkage; curves and plateaus are shared."""
    series, ids = _simulated(table)
    grid = grid_table(series)
    ols = severity.ols(select.plateau(curves.positive_points(curves.curve(series, grid))))
    each = resample.weighted(ols, resample.draws(resample.banks(series, grid), reps), shrinkages)
    scored = _scored(each, table, ids, "xi", "xi_true")
    first = scored.groupBy("benchmark_set", "family", "n_obs", "scenario", "delta").agg(F.median("relative_error").alias("e"), F.avg(F.col("covered").cast("double")).alias("c"), F.median("interval_score").alias("s"))
    return first.groupBy("benchmark_set", "family", "n_obs", "delta").agg(F.median("e").alias("median_ape"), F.median("c").alias("median_coverage"), F.median("s").alias("median_interval_score"))


def ei_shrinkage_sensitivity(table: DataFrame, shrinkages=SHRINKAGES, reps: int = resample.REPS, seed: int = 7) -> DataFrame:
    """Median error, coverage and score of both sliding pooled fits by shrinkage; paths, windows and resamples are shared."""
    series, ids = _simulated(table)
    values = persistence.prepared(series)
    keys = (("bb", True), ("northrop", True))
    drawn = resample.path_draws(series, grid_table(values), reps, seed, paths=keys)
    each = resample.pooled(persistence.stable_paths(values, keys), drawn, shrinkages).withColumn("method", _pooled_label())
    scored = _scored(each, table, ids, "theta", "theta_true")
    first = scored.groupBy("benchmark_set", "family", "n_obs", "scenario", "method", "delta").agg(F.median("relative_error").alias("e"), F.avg(F.col("covered").cast("double")).alias("c"), F.median("interval_score").alias("s"))
    return first.groupBy("benchmark_set", "family", "n_obs", "method", "delta").agg(F.median("e").alias("median_ape"), F.median("c").alias("median_coverage"), F.median("s").alias("median_interval_score"))


def record_length_sensitivity(spark: SparkSession, lengths=LENGTHS, families=simulate.FAMILIES[:2], xis=simulate.EVI_XI, reps: int = 100) -> DataFrame:
    """Median error by record length and method, lengths as columns."""
    tables = [simulate.scenarios(spark, families, xis, (0.1,), n, reps, f"length{n}") for n in lengths]
    scored = stack([evaluate_evi(t, schemes=("sliding",), targets=("median",)) for t in tables])
    per = scored.groupBy("family", "n_obs", "method", "scenario").agg(F.median("relative_error").alias("e")).groupBy("family", "n_obs", "method").agg(F.median("e").alias("median_ape"))
    return per.groupBy("family", "method").pivot("n_obs", list(lengths)).agg(F.first("median_ape"))


def stress_suite(spark: SparkSession, reps: int = 100) -> DataFrame:
    table = simulate.scenarios(spark, (simulate.STRESS,), (0.1, 0.3, 1.0), (0.1, 0.5, 1.0), reps=reps, label="stress")
    return score.summary(evaluate_evi(table))


def load_or_build(spark: SparkSession, path: str, columns: set[str], expected: dict[str, list], build, version: int = 1) -> DataFrame:
    """The table at ``path`` if it is readable, of this version and meets the contract, else a fresh one written there.

    A damaged or outdated table is replaced; replacing swaps whole files, so a reader sees one or the other.
    """
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        kept = spark.read.parquet(path)
        if contract_ok(kept, columns | {"cache_version"}, expected | {"cache_version": [version]}):
            return kept.drop("cache_version")
    except (PySparkException, Py4JJavaError):  # damaged footers come as the latter
        pass
    build().withColumn("cache_version", F.lit(version)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).drop("cache_version")


def series_bank(spark: SparkSession, table: DataFrame, path: str, version: int = 1) -> DataFrame:
    """Simulated series of a scenario table, kept at ``path`` while scenarios and lengths stay the same."""
    rows = simulate.simulate(table)
    wanted = [r["scenario"] for r in table.select("scenario").distinct().collect()]  # a scenario table is small
    return load_or_build(spark, path, {"series_id", "pos", "value"}, {"scenario": wanted}, lambda: rows, version)


def path_covariance(series: DataFrame, windows: DataFrame, path: str, reps: int = resample.REPS, seed: int = 7) -> DataFrame:
    """Covariance of path draws at ``path``, valid only while the selected levels (``windows`` with part) are the same."""
    spark = series.sparkSession
    levels = [r["b"] for r in windows.select(F.explode("part.b").alias("b")).distinct().collect()]  # block sizes: some tens
    drawn = resample.path_draws(series, windows.select("series_id", F.explode("part.b").alias("b")), reps, seed)
    return load_or_build(spark, path, {"series_id", "b1", "b2", "cov", "reps"}, {"b1": levels}, lambda: resample.covariance_table(drawn, "z"), version=reps)


def outputs(spark: SparkSession, folder: str, table: DataFrame, kind: str = "evi", n_obs: int = 365, **kwargs) -> dict[str, DataFrame]:
    """Replicate-level results and their summary, kept under ``folder`` while they match the scenario table.

    Names end in the record length unless it is the usual 365.
    """
    suffix = "" if n_obs == 365 else f"_{n_obs}"
    groups = {k: v for k, v in simulate.expected_groups(table).items() if k != "n_obs"}
    work = {"evi": (evaluate_evi, score.summary), "external": (evaluate_external, score.summary), "ei": (evaluate_ei, lambda r: score.summary(r, hat="theta_hat"))}
    evaluate, summarise = work[kind]
    results = load_or_build(spark, f"{folder}/{kind}_results{suffix}", {"method", "rep"}, groups, lambda: evaluate(table, **kwargs))
    summary = load_or_build(spark, f"{folder}/{kind}_summary{suffix}", {"method", "coverage"}, groups, lambda: summarise(results))
    return {"results": results, "summary": summary}

"""Scoring of replicate-level results and the tables made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tailspark.functions import intervals

#: Methods by scheme, target and regression, in display order.
METHODS = tuple((f"{s}_{t}_{r}", f"{s}-{t}-{r}", s, t, r) for s in ("disjoint", "sliding") for t in ("median", "mean", "mode") for r in ("ols", "fgls"))
#: Families and their labels, in display order; interval styles of the external estimators.
FAMILIES = (("frechet_max_ar", "Frechet max-AR"), ("moving_maxima_q99", "Moving Maxima (q=99)"), ("pareto_additive_ar1", "Pareto additive AR(1)"), ("student_t_abs_moving_maxima_q99", "Abs-Student-t moving maxima (q=99)"))
KEYS = ["benchmark_set", "family", "xi_true", "theta_true", "phi", "method"]


def methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*m, i) for i, m in enumerate(METHODS)], "method string, method_label string, block_scheme string, summary_target string, regression string, method_order int")


def errors(results: DataFrame, truth: str = "xi_true", hat: str = "xi_hat") -> DataFrame:
    """Error, coverage and interval-score columns of results with ci_lo and ci_hi."""
    t, h, lo, hi = (F.col(c) for c in (truth, hat, "ci_lo", "ci_hi"))
    miss = h - t
    return results.withColumns(
        {
            "signed_error": miss, "abs_error": F.abs(miss), "relative_error": F.try_divide(F.abs(miss), F.abs(t)),
            "covered": intervals.contains(lo, hi, t), "interval_width": intervals.width(lo, hi), "interval_score": intervals.winkler(t, lo, hi),
        }
    )


def quartiles(c: str) -> list[Column]:
    return [F.percentile(c, F.lit(0.5)).alias(f"{c}_median"), F.percentile(c, F.lit(0.25)).alias(f"{c}_q25"), F.percentile(c, F.lit(0.75)).alias(f"{c}_q75")]


def summary(results: DataFrame, keys: list[str] = KEYS, hat: str = "xi_hat", more=()) -> DataFrame:
    """One row per scenario and method: errors, coverage with Wilson bounds, widths and scores, and ``more`` aggregates.  Null keys are a group."""
    g = results.groupBy(*keys).agg(
        F.percentile("n_obs", F.lit(0.5)).alias("n_obs"), F.count_distinct("rep").alias("n_rep"), F.count_if("covered").alias("n_cover"),
        F.avg(hat).alias(f"{hat}_mean"), F.coalesce(F.stddev_samp(hat), F.lit(0.0)).alias(f"{hat}_sd"), F.avg("signed_error").alias("bias"), F.avg("abs_error").alias("mae"),
        F.avg("relative_error").alias("mape"), F.coalesce(F.stddev_samp("relative_error"), F.lit(0.0)).alias("mape_sd"), F.avg(F.col("covered").cast("double")).alias("coverage"),
        F.avg("interval_width").alias("interval_width_mean"), F.avg("interval_score").alias("interval_score_mean"),
        *quartiles("relative_error"), *quartiles("interval_width"), *quartiles("interval_score"), *more,
    )
    n = F.col("n_rep").cast("double")
    lo, hi = intervals.wilson(F.col("n_cover"), F.col("n_rep"))
    c = F.col("coverage")
    return g.withColumns({f"{hat}_se": F.col(f"{hat}_sd") / F.sqrt(n), "mape_se": F.col("mape_sd") / F.sqrt(n), "coverage_se": F.sqrt(c * (1 - c) / F.greatest(n, F.lit(1.0))), "coverage_lo": lo, "coverage_hi": hi})


def _middle(*names: str) -> list[Column]:
    return [F.percentile(c, F.lit(0.5)).alias(c) for c in names]


def _named(summaries: DataFrame) -> DataFrame:
    label = F.format_string("%s_%s_xi%.2f_theta%.2f", "benchmark_set", "family", F.col("xi_true").cast("double"), F.col("theta_true").cast("double"))
    return summaries.withColumn("scenario", label)


def external_summary(results: DataFrame) -> DataFrame:
    """Summary of the published tail estimators: also by interval method, with the medians of the selected levels.

    A group has one tuning axis; where rows disagree the first by the alphabet stands.
    """
    more = [F.min("tuning_axis").alias("tuning_axis"), *_middle("selected_k", "stable_k_lo", "stable_k_hi", "fixed_upper_level")]
    return _named(summary(results, [*KEYS, "ci_method"], more=more))


def ei_summary(results: DataFrame) -> DataFrame:
    """Summary of extremal-index results: also by interval method, with the medians of the selected levels and one flag of the interval variant."""
    more = [
        *_middle("selected_level", "stable_level_lo", "stable_level_hi", "selected_threshold_quantile", "selected_run_k"),
        *(F.min(c).alias(c) for c in ("block_scheme", "base_path", "regression")), collapsed_flag("ci_variant").alias("ci_variant"),
    ]
    return _named(summary(results, [*KEYS, "ci_method"], hat="theta_hat", more=more))


def in_order(frame: DataFrame, column: str, names: list[str], keep_others: bool = True) -> DataFrame:
    """Adds ``<column>_order``: the place of a name in a fixed list; unknown names come last (999) or go."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col(column).cast("string")).cast("int") - 1
    out = frame.withColumn(f"{column}_order", F.when(place >= 0, place).otherwise(999))
    return out if keep_others else out.filter(F.col(f"{column}_order") < 999)


def family_label(family: Column) -> Column:
    """Display name of a family; unknown ones keep their own."""
    known = F.create_map(*(F.lit(x) for pair in FAMILIES for x in pair))
    return F.coalesce(F.try_element_at(known, family), family)


def labelled(summaries: DataFrame, table: DataFrame) -> DataFrame:
    """Labels and order of methods; unknown methods come last.  ``table`` is the fixed method table, so it may be broadcast."""
    return summaries.join(F.broadcast(table), "method", "left").withColumn("method_order", F.coalesce("method_order", F.lit(999)))


def median_iqr(c: str, digits: int = 2) -> Column:
    """Text like 0.12 [0.10, 0.15]; NA where there is nothing."""
    f = f"%.{digits}f"
    q = lambda p: F.percentile(c, F.lit(p))
    return F.coalesce(F.format_string(f"{f} [{f}, {f}]", q(0.5), q(0.25), q(0.75)), F.lit("NA"))


def story(summaries: DataFrame, row: list[str], metric: str, column_order: list[str]) -> DataFrame:
    """Rows by ``row``, one column per method label, cells of median and quartiles of a metric."""
    cells = summaries.groupBy(*row, "method_label").agg(median_iqr(metric).alias("cell"))
    return cells.groupBy(*row).pivot("method_label", column_order).agg(F.first("cell"))


def transposed(table: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """Methods as rows: unpivot, then pivot by the former rows."""
    long = table.unpivot([row], columns, "method_label", "cell")
    return long.groupBy("method_label").pivot(row).agg(F.first("cell"))


def sharpness(internal: DataFrame, external: DataFrame, keys: list[str]) -> DataFrame:
    """Median width, coverage and score per key and method over both summaries."""
    both = internal.unionByName(external, allowMissingColumns=True)
    return both.groupBy(*keys, "method").agg(F.median("interval_width_median").alias("width"), F.median("coverage").alias("coverage"), F.median("interval_score_median").alias("score"))


def collapsed_flag(c: str) -> Column:
    """The one value of a group, ``default`` if there is none, ``mixed`` if several."""
    return F.when(F.count_distinct(c) == 0, "default").when(F.count_distinct(c) == 1, F.max(c)).otherwise("mixed")


def ranked(frame: DataFrame) -> DataFrame:
    """Candidate sites with their rank within a state."""
    w = Window.partitionBy("state_code").orderBy(F.desc("recommended"), F.desc("support"), F.desc("plateau_points"), F.desc("n_years"), F.desc("xi_lo"), F.col("site_no").try_cast("long").asc_nulls_last(), "site_no")
    return frame.withColumn("rank", F.row_number().over(w))


def frozen(frame: DataFrame) -> DataFrame:
    """The best site of each state."""
    return ranked(frame).filter("rank = 1").drop("rank")


def _known(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _significant(x: Column, digits: int = 3) -> Column:
    """Decimal text of a few significant digits, without closing zeros."""
    places = F.greatest(digits - 1 - F.floor(F.log10(F.abs(x))), F.lit(0))
    # twelve decimals hold every number that is shown this way; closing zeros go
    near = F.round(x * F.pow(F.lit(10.0), places)) / F.pow(F.lit(10.0), places)
    return F.regexp_replace(F.format_string("%.12f", near), r"\.?0+$", "")


def _scientific(x: Column) -> Column:
    """Three significant digits and a power of ten: 1.23e4, 5e-05."""
    first = F.floor(F.log10(F.abs(x)))
    raw = F.round(x / F.pow(F.lit(10.0), first), 2)
    over = F.abs(raw) >= 10
    power, lead = F.when(over, first + 1).otherwise(first), F.when(over, raw / 10).otherwise(raw)
    digits = F.regexp_replace(F.format_string("%.2f", lead), r"\.?0+$", "")
    return F.concat(digits, F.when(power >= 0, F.concat(F.lit("e"), power.cast("string"))).otherwise(F.concat(F.lit("e-"), F.lpad((-power).cast("string"), 2, "0"))))


def compact(x: Column) -> Column:
    """Number as text with digits by magnitude, NA where missing."""
    a = F.abs(x)
    text = (
        F.when(~_known(x), "NA").when(a == 0, "0").when((a >= 1e4) | (a < 1e-4), _scientific(x)).when(a < 1e-2, _significant(x))
        .when(a >= 100, F.format_string("%.0f", F.rint(x))).when(a >= 1, F.format_string("%.2f", x)).otherwise(F.format_string("%.3f", x))
    )
    return F.coalesce(text, F.lit("NA"))


def scaled(x: Column, scale: float) -> Column:
    """Number in units of ``scale`` as text with thousands separators, NA where missing."""
    y = x / scale
    a = F.abs(y)
    text = (
        F.when(~_known(x), "NA").when(a == 0, "0").when(a >= 100, F.format_string("%,.0f", F.rint(y))).when(a >= 10, F.format_string("%,.1f", y))
        .when(a >= 1, F.format_string("%,.2f", y)).when(a >= 1e-4, _significant(y)).otherwise(_scientific(y))
    )
    return F.coalesce(text, F.lit("NA"))


def _bracketed(x: Column, lo: Column, hi: Column, text) -> Column:
    whole = _known(x) & _known(lo) & _known(hi)
    return F.coalesce(F.when(whole, F.format_string("%s [%s, %s]", text(x), text(lo), text(hi))), F.lit("NA"))


def interval_text(x: Column, lo: Column, hi: Column) -> Column:
    return _bracketed(x, lo, hi, compact)


def scaled_interval(x: Column, lo: Column, hi: Column, scale: float) -> Column:
    return _bracketed(x, lo, hi, lambda v: scaled(v, scale))


def plain_interval(x: Column, lo: Column, hi: Column) -> Column:
    """Two decimals throughout."""
    return _bracketed(x, lo, hi, lambda v: F.format_string("%.2f", v))


def window_text(lo: Column, hi: Column) -> Column:
    """Bounds of a stable window such as 12-48; NA without one."""
    return F.when(lo.isNotNull() & hi.isNotNull(), F.concat_ws("-", lo.cast("long").cast("string"), hi.cast("long").cast("string"))).otherwise("NA")


def yes_no(x: Column) -> Column:
    """yes, no or NA of a flag, whether it is boolean, number or text."""
    text = F.lower(F.trim(x.cast("string")))
    return F.when(x.isNull() | (text == "nan"), "NA").when(text.isin("false", "no", "0", "0.0", ""), "no").otherwise("yes")


def axis_limit(x: Column, steps: tuple[float, ...]) -> Column:
    """The least of rising display limits that holds a value and a margin of 2 %; the last one beyond them, missing values as they are."""
    padded = F.greatest(x * 1.02, F.lit(float(steps[0])))
    held = F.get(F.filter(F.array(*(F.lit(float(s)) for s in steps)), lambda s: padded <= s), F.lit(0))
    return F.when(_known(x), F.coalesce(held, F.lit(float(steps[-1])))).otherwise(x)

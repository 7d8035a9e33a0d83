"""Tail index estimators over order statistics, and the max-spectrum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailspark.functions import intervals
from tailspark.functions.arrays import total
from tailspark.functions.grid import spectrum_scales, tail_counts
from tailspark.operators import select
from tailspark.series import compress

LEAST = 8


def _positive(series: DataFrame, by_rows: bool) -> DataFrame:
    """Positive finite values with ``size``, which sets the candidate counts: how many they are or, ``by_rows``, how many rows the series has."""
    own = Window.partitionBy("series_id")
    if by_rows:
        return series.withColumn("size", F.count("*").over(own)).filter("value > 0")
    return series.filter("value > 0").withColumn("size", F.count("*").over(own))


def _ranked(series: DataFrame, by_rows: bool = False) -> DataFrame:
    """Positive finite values from the largest down, with running sums of logs; series of fewer than 8 have none."""
    w = Window.partitionBy("series_id").orderBy(F.desc("value"), "pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    l = F.ln("value")  # noqa: E741
    rows = _positive(series, by_rows).select(
        "series_id", "value", "size", F.row_number().over(w).alias("rank"), F.count("*").over(Window.partitionBy("series_id")).alias("n"),
        F.sum(l).over(upto).alias("s1"), F.sum(l * l).over(upto).alias("s2"), F.lead(l).over(w).alias("below"),
    )
    return rows.filter(F.col("n") >= LEAST)


def _on_counts(ranked: DataFrame) -> DataFrame:
    """The rows whose rank is a candidate count: an equality test on a short array, no join."""
    return ranked.filter(F.array_contains(tail_counts(F.col("size")), F.col("rank").cast("long"))).withColumnRenamed("rank", "k")


def _estimate(path: DataFrame, method: str, se, width: int = 4) -> DataFrame:
    """One row per series from a path (series_id, level, xi): the stable estimate with its interval."""
    one = F.struct(F.col("level").cast("long").alias("level"), "xi")
    points = path.filter(F.col("xi").isNotNull() & ~F.isnan("xi") & (F.abs("xi") < float("inf"))).groupBy("series_id").agg(F.array_sort(F.collect_list(one)).alias("pts"))
    chosen = select.stable_level(points, width)
    out = chosen.withColumn("se", se(F.col("xi"), F.col("level")))
    lo, hi = intervals.wald(F.col("xi"), F.col("se"))
    return out.select("series_id", F.lit(method).alias("method"), "xi", "level", F.col("lo").alias("window_lo"), F.col("hi").alias("window_hi"), "se", lo.alias("xi_lo"), hi.alias("xi_hi"), "path")


def hill_path(series: DataFrame, by_rows: bool = False) -> DataFrame:
    rows = _on_counts(_ranked(series, by_rows))
    return rows.select("series_id", F.col("k").alias("level"), (F.col("s1") / F.col("k") - F.col("below")).alias("xi"))


def hill(series: DataFrame, by_rows: bool = False) -> DataFrame:
    return _estimate(hill_path(series, by_rows), "hill_raw", intervals.hill_se)


def moment_path(series: DataFrame, by_rows: bool = False) -> DataFrame:
    rows = _on_counts(_ranked(series, by_rows))
    k, t = F.col("k"), F.col("below")
    m1 = F.col("s1") / k - t
    m2 = F.col("s2") / k - 2 * t * F.col("s1") / k + t * t
    spread = 1 - F.try_divide(m1 * m1, m2)
    return rows.select("series_id", k.alias("level"), F.when((m2 > 0) & (F.abs(spread) >= 1e-10), m1 + 1 - F.try_divide(F.lit(0.5), spread)).alias("xi"))


def moment(series: DataFrame, by_rows: bool = False) -> DataFrame:
    return _estimate(moment_path(series, by_rows), "dedh_moment_raw", intervals.moment_se)


def pickands_path(series: DataFrame, by_rows: bool = False) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy(F.desc("value"), "pos")
    rows = _positive(series, by_rows).select("series_id", "value", "size", F.row_number().over(w).alias("rank"), F.count("*").over(Window.partitionBy("series_id")).alias("n")).filter(F.col("n") >= LEAST)
    counts = tail_counts(F.col("size"))
    each = F.filter(F.flatten(F.transform(counts, lambda k: F.transform(F.array(F.lit(1), F.lit(2), F.lit(4)), lambda m: F.struct(k.alias("k"), m.alias("m"))))), lambda x: (x["k"] * x["m"] == F.col("rank")) & (4 * x["k"] <= F.col("n")))
    met = rows.select("series_id", "value", F.explode(each).alias("x"))
    at = lambda m: F.max(F.when(F.col("x.m") == m, F.col("value")))
    three = met.groupBy("series_id", F.col("x.k").alias("level")).agg(at(1).alias("a"), at(2).alias("b"), at(4).alias("c"))
    up, down = F.col("a") - F.col("b"), F.col("b") - F.col("c")
    return three.select("series_id", "level", F.when((up > 0) & (down > 0), F.ln(F.try_divide(up, down)) / 0.6931471805599453).alias("xi"))


def pickands(series: DataFrame, by_rows: bool = False) -> DataFrame:
    return _estimate(pickands_path(series, by_rows), "pickands_raw", intervals.pickands_se)


def spectrum(series: DataFrame) -> DataFrame:
    """(series_id, j, y, n_blocks): mean log2 of the disjoint maxima of 2 ** j positive values in time order."""
    vec = compress(series)
    n = vec.groupBy("series_id").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    scales = n.select("series_id", F.explode(spectrum_scales(F.col("n"))).alias("j"))
    size = F.pow(F.lit(2.0), F.col("j")).cast("long")
    blocks = vec.join(scales, "series_id").groupBy("series_id", "j", F.floor(F.col("pos") / size).alias("block")).agg(F.max("value").alias("m"), F.count("*").alias("c"))
    full = blocks.filter(F.col("c") == size)
    return full.groupBy("series_id", "j").agg(F.avg(F.log2("m")).alias("y"), F.count("*").alias("n_blocks"))


def weighted_slope(part: Column) -> tuple[Column, Column]:
    """Slope of y on j with weights n_blocks, and its HC1 standard error, of an array of points."""
    w = total(part, lambda p: p["n_blocks"].cast("double"))
    mx, my = total(part, lambda p: p["n_blocks"] * p["j"]) / w, total(part, lambda p: p["n_blocks"] * p["y"]) / w
    sxx = total(part, lambda p: p["n_blocks"] * (p["j"] - mx) * (p["j"] - mx))
    slope = total(part, lambda p: p["n_blocks"] * (p["j"] - mx) * (p["y"] - my)) / sxx
    n = F.size(part).cast("double")

    def one(p: Column) -> Column:
        e = p["y"] - my - slope * (p["j"] - mx)
        v = p["n_blocks"] * (p["j"] - mx) / sxx
        return e * e * v * v

    return slope, F.sqrt(total(part, one) * n / (n - 2))


def max_spectrum(series: DataFrame, least: int = 3) -> DataFrame:
    """The slope of the spectrum from the start scale of the calmest three; fewer than three scales give no row."""
    points = spectrum(series).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(F.col("j").cast("int").alias("j"), "y", "n_blocks"))).alias("all"))
    n = F.size("all")
    starts = points.filter(n >= least).select("series_id", F.explode(F.sequence(F.lit(0), n - least)).alias("s"), "all")
    part = starts.select("series_id", F.get("all", F.col("s"))["j"].alias("level"), F.slice("all", F.col("s") + 1, F.size("all")).alias("part"))
    slope, se = weighted_slope(F.col("part"))
    path = part.select("series_id", "level", slope.alias("xi"), se.alias("se_at"))
    chosen = _estimate(path, "max_spectrum_raw", lambda xi, level: F.lit(None).cast("double"), 3).drop("se", "xi_lo", "xi_hi")
    own = path.select("series_id", F.col("level").cast("long").alias("level"), F.col("se_at").alias("se"))
    met = chosen.join(own, ["series_id", "level"], "left")
    lo, hi = intervals.wald(F.col("xi"), F.col("se"))
    return met.select("series_id", "method", "xi", "level", "window_lo", "window_hi", "se", lo.alias("xi_lo"), hi.alias("xi_hi"), "path")


def all_estimators(series: DataFrame) -> DataFrame:
    """The four comparators, one row per series and method."""
    return hill(series).unionByName(moment(series)).unionByName(pickands(series)).unionByName(max_spectrum(series))

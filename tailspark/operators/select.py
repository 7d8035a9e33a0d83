"""Choosing windows of a curve or path: plateau, stable path window, stable levels.

A curve has some tens of points, held in one array per series, so every choice is an
expression over one row and needs no shuffle.  Among equal scores the first (start, stop) wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailspark.contracts import CURVATURE, PLATEAU_POINTS, STABLE_POINTS, TRIM
from tailspark.functions.arrays import diff, mean, median, pick, ratio, spans, total


def _bounds(n: Column, least: int, trim: float, pull: bool) -> tuple[Column, Column]:
    """Trimmed range of start and stop; the whole curve if the trimmed one is too short."""
    cut = F.floor(n * trim).cast("int")
    lo = F.least(cut, F.greatest(n - least, F.lit(0))) if pull else cut
    short = (n - cut) - lo < least
    return F.when(short, 0).otherwise(lo), F.when(short, n).otherwise(n - cut)


def _scored(points: DataFrame, least: int, trim: float, pull: bool, score) -> DataFrame:
    """One row for each window of each series, with its score."""
    n = F.size("pts")
    lo, hi = _bounds(n, least, trim, pull)
    each = points.filter(n >= least).select("series_id", "pts", F.explode(spans(lo, hi, least)).alias("w"))
    part = each.select("series_id", "w.start", "w.stop", F.slice("pts", F.col("w.start") + 1, F.col("w.stop") - F.col("w.start")).alias("part"))
    return part.withColumn("score", score(F.col("part")))


def _first(scored: DataFrame) -> DataFrame:
    best = scored.groupBy("series_id").agg(F.min(F.struct("score", "start", "stop", "part")).alias("best"))
    return best.select("series_id", "best.*")


def _top(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("score", "start", "stop")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _plateau_score(penalty: float):
    def score(part: Column) -> Column:
        x, y, n = pick(part, "x"), pick(part, "y"), F.size(part).cast("double")
        mx, my = mean(x), mean(y)
        sxx, sxy, syy = total(part, lambda p: (p["x"] - mx) * (p["x"] - mx)), total(part, lambda p: (p["x"] - mx) * (p["y"] - my)), total(part, lambda p: (p["y"] - my) * (p["y"] - my))
        mse = F.greatest(syy - F.coalesce(F.try_divide(sxy * sxy, sxx), F.lit(0.0)), F.lit(0.0)) / n
        bends = diff(ratio(diff(y), diff(x)))
        return (mse + penalty * F.coalesce(mean(bends, lambda d: F.abs(d)), F.lit(0.0))) / F.sqrt(n)

    return score


def plateau_windows(points: DataFrame, least: int = PLATEAU_POINTS, trim: float = TRIM, penalty: float = CURVATURE) -> DataFrame:
    return _scored(points, least, trim, True, _plateau_score(penalty))


def plateau(points: DataFrame, least: int = PLATEAU_POINTS, trim: float = TRIM, penalty: float = CURVATURE) -> DataFrame:
    """series_id, score, start, stop, part: the window of best straightness and least bending.

    Series of fewer than ``least`` points have none and no row.
    """
    return _first(plateau_windows(points, least, trim, penalty))


def top_plateaus(points: DataFrame, k: int = 3, least: int = PLATEAU_POINTS, trim: float = TRIM, penalty: float = CURVATURE) -> DataFrame:
    return _top(plateau_windows(points, least, trim, penalty), k)


def _stable_score(rough: float, bend: float):
    def score(part: Column) -> Column:
        z, n = pick(part, "z"), F.size(part).cast("double")
        m = mean(z)
        spread = mean(z, lambda v: (v - m) * (v - m))
        d1 = diff(z)
        return (spread + rough * mean(d1, lambda d: F.abs(d)) + bend * F.coalesce(mean(diff(d1), lambda d: F.abs(d)), F.lit(0.0))) / F.sqrt(n)

    return score


def stable_windows(points: DataFrame, least: int = STABLE_POINTS, trim: float = TRIM, rough: float = 0.75, bend: float = 0.5) -> DataFrame:
    return _scored(points, least, trim, False, _stable_score(rough, bend))


def stable_path(points: DataFrame, least: int = STABLE_POINTS, trim: float = TRIM, rough: float = 0.75, bend: float = 0.5) -> DataFrame:
    """The calmest window of a path: points are (b, z)."""
    return _first(stable_windows(points, least, trim, rough, bend))


def top_stable(points: DataFrame, k: int = 3, least: int = STABLE_POINTS, trim: float = TRIM) -> DataFrame:
    return _top(stable_windows(points, least, trim), k)


def stable_level(points: DataFrame, width: int = 4) -> DataFrame:
    """series_id, level, lo, hi, xi, path: the middle of the calmest ``width`` levels and the estimate nearest to it.

    Points are (level, xi) with finite xi.  Paths of at most ``width`` points keep their whole
    range, and the median level is truncated; otherwise it is rounded half to even.
    """
    n = F.size("pts")
    levels = lambda part: F.transform(pick(part, "level"), lambda v: v.cast("double"))

    def score(part: Column) -> Column:
        v = pick(part, "xi")
        m = mean(v)
        return mean(v, lambda x: (x - m) * (x - m)) + 0.5 * F.coalesce(mean(diff(diff(v)), lambda d: F.abs(d)), F.lit(0.0))

    def judged(s: Column) -> Column:
        part = F.slice(F.col("pts"), s + 1, width)
        return F.struct(score(part).alias("score"), s.alias("start"), part.alias("part"))

    starts = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))
    best = F.array_min(F.transform(starts, judged))["part"]
    part = F.when(n <= width, F.col("pts")).otherwise(best)
    kept = points.filter(n > 0).withColumn("part", part)
    middle = median(levels(F.col("part")))
    level = F.when(n <= width, F.floor(middle)).otherwise(F.rint(middle)).cast("long")
    near = F.array_min(F.transform(F.col("pts"), lambda p: F.struct(F.abs(p["level"] - F.col("level")).alias("d"), p["level"].alias("level"), p["xi"].alias("xi"))))
    return kept.withColumn("level", level).select("series_id", "level", F.get("part", F.lit(0))["level"].alias("lo"), F.element_at("part", -1)["level"].alias("hi"), near["xi"].alias("xi"), F.col("pts").alias("path"))

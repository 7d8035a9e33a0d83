"""Intervals, scores and standard errors as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tailspark.contracts import CHI2_95, TINY, Z_95, Z_EXACT


def wilson(successes: Column, total: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Wilson score interval in [0, 1]; null for no observations."""
    n = F.when(total > 0, total.cast("double"))
    p = successes / n
    denominator = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denominator
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denominator
    return F.greatest(centre - half, F.when(total > 0, 0.0)), F.least(centre + half, F.when(total > 0, 1.0))


def width(lo: Column, hi: Column) -> Column:
    return hi - lo


def contains(lo: Column, hi: Column, x: Column) -> Column:
    return x.between(lo, hi)


def winkler(truth: Column, lo: Column, hi: Column, alpha: float = 0.05) -> Column:
    """Interval score: width and 2 / alpha times the miss; null if any part is missing."""
    miss = F.when(truth < lo, lo - truth).when(truth > hi, truth - hi).otherwise(0.0)
    return F.when(truth.isNotNull() & lo.isNotNull() & hi.isNotNull(), hi - lo + 2 / alpha * miss)


def wald(x: Column, se: Column, z: float = Z_EXACT) -> tuple[Column, Column]:
    return x - z * se, x + z * se


def unit_wald(x: Column, se: Column) -> tuple[Column, Column]:
    """Wald interval cut to [0, 1]."""
    return F.when(se.isNotNull(), F.greatest(x - Z_95 * se, F.lit(0.0))), F.when(se.isNotNull(), F.least(x + Z_95 * se, F.lit(1.0)))


def log_theta(z: Column, se: Column) -> tuple[Column, Column]:
    """Interval of exp(-z) from one on z."""
    return F.exp(-(z + Z_95 * se)), F.exp(-(z - Z_95 * se))


def hill_se(xi: Column, k: Column) -> Column:
    return F.abs(xi) / F.sqrt(k.cast("double"))


def pickands_se(xi: Column, k: Column) -> Column:
    root = F.sqrt(k.cast("double"))
    near = math.sqrt(3.0) / (2.0 * math.log(2.0) ** 2) / root
    far = F.abs(xi) * F.sqrt(F.pow(F.lit(2.0), 2 * xi + 1) + 1) / F.abs(2 * (F.pow(F.lit(2.0), xi) - 1) * math.log(2.0) * root)
    return F.when(F.abs(xi) < 1e-8, near).otherwise(far)


def moment_se(xi: Column, k: Column) -> Column:
    return F.sqrt(1 + xi * xi) / F.sqrt(k.cast("double"))


def root(f: Callable[[Column], Column], lo: Column, hi: Column, rising: bool) -> Column:
    """Root of a monotone f between lo and hi by sixty halvings."""
    start = F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        below = f(mid) < 0 if rising else f(mid) >= 0
        return F.when(below, F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)


def profile_interval(loglik: Callable[[Column], Column], best: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """Where a unimodal log-likelihood has fallen by half the chi-square quantile; a bound not reached is the end."""
    drop = loglik(best) - CHI2_95 / 2
    below = lambda t: loglik(t) - drop
    lower = F.when(below(lo) >= 0, lo).otherwise(root(below, lo, best, rising=True))
    upper = F.when(below(hi) >= 0, hi).otherwise(root(below, best, hi, rising=False))
    return lower, upper


def clip(x: Column, lo: float = TINY, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))

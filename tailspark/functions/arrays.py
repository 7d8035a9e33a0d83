"""Arithmetic on short arrays (curves and paths of some tens of points)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(array: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(F.transform(array, f), F.lit(0.0), lambda a, x: a + x)


def mean(array: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.try_divide(total(array, f), F.size(array).cast("double"))


def diff(array: Column) -> Column:
    """Differences of neighbours; empty for fewer than two elements."""
    n = F.size(array)
    steps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(array, i) - F.get(array, i - 1))
    return F.when(n > 1, steps).otherwise(F.array().cast("array<double>"))


def ratio(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, y))


def pick(array: Column, field: str) -> Column:
    return F.transform(array, lambda p: p[field])


def median(array: Column) -> Column:
    """Median of a numeric array."""
    s, n = F.array_sort(array), F.size(array)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


def spans(lo: Column, hi: Column, least: int) -> Column:
    """All (start, stop) with lo <= start, start + least <= stop <= hi, as an array of structs."""
    starts = F.sequence(lo, F.greatest(hi - least, lo))
    inner = lambda s: F.transform(F.sequence(s + least, F.greatest(hi, s + least)), lambda e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("stop")))
    return F.filter(F.flatten(F.transform(starts, inner)), lambda w: w["stop"] <= hi)

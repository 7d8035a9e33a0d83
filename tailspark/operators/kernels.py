"""Sliding curves and paths through Arrow kernels on chunks of series.

A chunk holds ``CHUNK`` positions and what its last windows reach into, so a series of any length
spreads over tasks.  A kernel call gives, for every block size, the distinct maxima of the
windows that start in its chunk with their counts: far fewer numbers than windows, as a maximum
stays for many of them.  Summaries are then weighted by the counts.  The native operators
(windows, curves) give the same values by frames and ranks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailspark.operators import resample
from tailspark.operators.windows import CHUNK


def window_maxima(x: np.ndarray, sizes: list[int], own: int):
    """For each width in rising order the maxima of its complete, all-finite windows that start in the first ``own`` places."""
    bad = ~np.isfinite(x)
    level, reach = np.where(bad, -np.inf, x), 1
    gaps = np.concatenate(([0], np.cumsum(bad)))
    for b in sizes:
        n = min(x.size - b + 1, own)
        if n < 1 or b < 2:
            yield np.zeros(0)
            continue
        while reach * 2 <= b:
            level, reach = np.maximum(level[:-reach], level[reach:]), reach * 2
        m = np.maximum(level[:n], level[b - reach : b - reach + n])
        yield m[gaps[b : b + n] - gaps[:n] == 0]


def sliding_bank(series: DataFrame, grid: DataFrame) -> DataFrame:
    """(series_id, b, values, counts): distinct sliding maxima of each chunk and block size."""
    sizes = grid.groupBy("series_id").agg(F.array_sort(F.collect_set("b")).alias("sizes"), F.max("b").alias("reach"))
    span = series.groupBy("series_id").agg(F.max("pos").alias("last"))
    plan = sizes.join(span, "series_id").withColumn("size", F.greatest(F.lit(CHUNK), F.col("reach")))
    own = F.floor(F.col("pos") / F.col("size"))
    also = F.when((F.col("pos") % F.col("size") < F.col("reach") - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    rows = series.join(plan.select("series_id", "reach", "size"), "series_id").select("series_id", F.explode(also).alias("chunk"), "pos", "value")
    asked = plan.select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / F.col("size")))).alias("chunk"), "sizes", "size")
    keys = ["series_id", "chunk"]

    def run(key, values: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(values) and len(wanted):
            values = values.sort_values("pos")
            x = values["value"].to_numpy(dtype=float, na_value=np.nan)
            own = int((values["pos"] < (int(key[1]) + 1) * int(wanted["size"].iloc[0])).sum())
            widths = [int(b) for b in wanted["sizes"].iloc[0]]
            for b, m in zip(widths, window_maxima(x, widths, own), strict=True):
                if m.size:
                    out.append((key[0], b, *np.unique(m, return_counts=True)))
        return pd.DataFrame(out, columns=["series_id", "b", "values", "counts"])

    return rows.groupBy(*keys).cogroup(resample._own_key(asked, keys).groupBy(*keys)).applyInPandas(run, "series_id string, b long, values array<double>, counts array<long>")


def curve(series: DataFrame, grid: DataFrame, target: str, taus: list[float]) -> DataFrame:
    """(series_id, b, tau, n_blocks, value) of sliding maxima, one call per series and block size; tau is 0 for mean and mode."""
    names = ["series_id", "b", "tau", "n_blocks", "value"]
    taus = list(taus) if target == "quantile" else [0.0]

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        v, c = (np.concatenate(rows[n].to_list()) for n in ("values", "counts"))
        order = np.argsort(v, kind="stable")
        v, w = v[order], c[order][None].astype(np.int64)
        found = [resample.summaries(v, w, target, t)[0] for t in taus]
        return pd.DataFrame([(key[0], int(key[1]), t, int(w.sum()), f) for t, f in zip(taus, found, strict=True)], columns=names)

    got = sliding_bank(series, grid).groupBy("series_id", "b").applyInPandas(run, "series_id string, b long, tau double, n_blocks long, value double")
    each = grid.select("series_id", "b", F.explode(F.array(*map(F.lit, taus))).alias("tau"))
    met = each.join(got.withColumnRenamed("tau", "t"), ["series_id", "b"], "left").filter(F.col("t").isNull() | (F.col("t") == F.col("tau")))
    return met.select("series_id", "b", "tau", F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"), F.when(~F.isnan("value"), F.col("value")).alias("value"))


def maxima_counts(values: DataFrame, grid: DataFrame) -> DataFrame:
    """(series_id, b, value, n): how many sliding windows have a maximum."""
    each = sliding_bank(values, grid).select("series_id", "b", F.explode(F.arrays_zip("values", "counts")).alias("x"))
    return each.groupBy("series_id", "b", F.col("x.values").alias("value")).agg(F.sum("x.counts").alias("n"))

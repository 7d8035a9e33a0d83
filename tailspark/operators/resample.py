"""Resampling, and fits weighted by the covariance of what is resampled.

Super-blocks: a series is cut into segments.  A first kernel, one call per segment, gives the
maxima of every block size as (value, count) pairs, which are far fewer than windows.  A second,
one call per series and block size, weights those pairs by how often each replicate draws their
segment; summaries of all targets come from the same draws.  No task holds replicates times
observations, and a series spreads over its segments and then over its block sizes.

Circular resampling: one call per series and range of replicates, one resample at a time, all
paths from the same resample.

Fits are small kernels on (replicates x block sizes) per series.  Draws depend on (seed,
series_id) or (seed, series_id, replicate) alone, never on row or partition order.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailspark.contracts import SHRINKAGE, TAU, TINY, Z_95
from tailspark.functions.grid import grid_table, resample_block

REPS = 120
#: Ranges of replicates that a series' circular resampling is dealt to.
RANGES = 8
#: Numbers that a density is worked out on at a time.
_CELLS = 1 << 22


def generator(seed: int, series_id: str, *more: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(series_id.encode()), *more])


# -- extremes of windows --------------------------------------------------------------------


def running_maxima(x: np.ndarray, b: int) -> np.ndarray:
    """Maxima of all complete windows of width b, by doubling; NaN spreads, infinity stays."""
    width, top = 1, x
    while 2 * width <= b:
        top = np.maximum(top[:-width], top[width:])
        width *= 2
    n = len(x) - b + 1
    return np.maximum(top[:n], top[b - width : b - width + n])


def circular_maxima(x: np.ndarray, b: int) -> np.ndarray:
    """Maxima of the len(x) windows of width b that wrap around."""
    return running_maxima(np.concatenate((x, x[: b - 1])), b)


# -- summaries of weighted values -----------------------------------------------------------


def _order_statistic(v: np.ndarray, below: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Per row of cumulated weights: the value of a rank, counted from 1."""
    return v[np.array([np.searchsorted(c, r) for c, r in zip(below, rank, strict=True)], dtype=int)]


def weighted_quantiles(v: np.ndarray, w: np.ndarray, place) -> np.ndarray:
    """Quantile of sorted values for each row of whole weights; ``place`` gives the rank from the total weight."""
    below = np.cumsum(w, axis=1)
    n = below[:, -1]
    h = np.clip(place(n), 1, np.maximum(n, 1))
    low = np.floor(h)
    a, b = _order_statistic(v, below, low), _order_statistic(v, below, np.minimum(low + 1, n))
    return np.where(a == b, a, a + (b - a) * (h - low))


def weighted_modes(v: np.ndarray, w: np.ndarray, points: int = 256) -> np.ndarray:
    """Mode of sorted positive finite values for each row of whole weights: the peak of a Gaussian kernel density of
    log1p values, brought back to the original scale.  All rows go through one evaluation, some values at a time."""
    out = np.full(len(w), np.nan)
    n = w.sum(axis=1)
    out[n == 1] = (w[n == 1] * v).sum(axis=1)
    rows = np.flatnonzero(n > 1)
    if not len(rows):
        return out
    w, n, y = w[rows].astype(float), n[rows].astype(float), np.log1p(v)
    centre = w @ y / n
    sd = np.sqrt((w * (y - centre[:, None]) ** 2).sum(axis=1) / (n - 1))
    q1, q3 = (weighted_quantiles(y, w, lambda n, p=p: (n - 1) * p + 1) for p in (0.25, 0.75))
    sigma = np.where(q3 > q1, np.minimum(sd, (q3 - q1) / 1.349), sd)
    width = np.maximum(1.059 * np.where(sigma > 0, sigma, np.maximum(sd, 1e-3)) * n**-0.2, 1e-3)
    held = w > 0
    first, last = y[held.argmax(axis=1)], y[len(y) - 1 - held[:, ::-1].argmax(axis=1)]
    at = first[:, None] + (last - first)[:, None] * np.linspace(0, 1, points)
    density = np.zeros_like(at)
    step = max(1, _CELLS // at.size)
    for k in range(0, len(y), step):
        bells = np.exp(-0.5 * ((at[:, :, None] - y[k : k + step]) / width[:, None, None]) ** 2)
        density += np.einsum("rgu,ru->rg", bells, w[:, k : k + step])
    peak = (density * np.exp(-at)).argmax(axis=1)
    out[rows] = np.expm1(at[np.arange(len(at)), peak])
    return out


def mode_of(x: np.ndarray) -> float:
    v, n = np.unique(x[np.isfinite(x) & (x > 0)], return_counts=True)
    return float(weighted_modes(v, n[None])[0]) if len(v) else float("nan")


def summaries(v: np.ndarray, w: np.ndarray, target: str, tau: float = TAU) -> np.ndarray:
    """Summary of sorted values (NaN last) for each row of whole weights."""
    missing = np.isnan(v)
    if target == "mode":
        good = np.isfinite(v) & (v > 0)
        return weighted_modes(v[good], w[:, good])
    n = w.sum(axis=1)
    if target == "quantile":
        out = weighted_quantiles(v[~missing], w[:, ~missing], lambda n: (n + 1 / 3) * tau + 1 / 3) if (~missing).any() else np.full(len(w), np.nan)
    elif target == "mean":
        out = np.where(w[:, ~missing] > 0, w[:, ~missing] * v[~missing], 0.0).sum(axis=1) / n
    else:
        raise ValueError(f"Unsupported target: {target}")
    return np.where(w[:, missing].sum(axis=1) > 0, np.nan, out)


# -- super-block bootstrap ------------------------------------------------------------------


def _own_key(side: DataFrame, keys=("series_id",)) -> DataFrame:
    """The same rows under key columns of their own, as both sides of a cogroup may stem from one table."""
    return side.select(*(F.col(c).alias(f"__{c}") for c in keys), *(c for c in side.columns if c not in keys)).withColumnsRenamed({f"__{c}": c for c in keys})


def super_blocks(series: DataFrame, grid: DataFrame) -> DataFrame:
    """(series_id, sizes, span, n_seg): how a series is cut; none where it is too short."""
    n = series.groupBy("series_id").agg(F.count("*").alias("n"), F.count("value").alias("n_finite"))
    sizes = grid.groupBy("series_id").agg(F.array_sort(F.collect_set("b")).alias("sizes"), F.max("b").alias("most"))
    met = n.filter("n_finite >= 64").join(sizes, "series_id")
    long = F.least(F.greatest(4 * F.col("most"), F.floor(F.sqrt("n")), F.col("most") + 1), F.col("n"))
    span = F.when(F.floor(F.col("n") / long) < 4, F.greatest(F.col("most") + 1, F.floor(F.col("n") / 4))).otherwise(long)
    cut = met.withColumn("span", span.cast("long")).withColumn("n_seg", F.floor(F.col("n") / F.col("span")))
    return cut.filter("n_seg >= 2").select("series_id", "sizes", "span", "n_seg")


def banks(series: DataFrame, grid: DataFrame, is_sliding: bool = True) -> DataFrame:
    """(series_id, n_seg, seg, b, values, counts): the distinct maxima of each segment and block size."""
    plan = super_blocks(series, grid)
    rows = series.join(plan.select("series_id", "span", "n_seg"), "series_id").filter(F.col("pos") < F.col("span") * F.col("n_seg"))
    rows = rows.select("series_id", F.floor(F.col("pos") / F.col("span")).alias("seg"), "pos", "value")
    wanted = plan.select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_seg") - 1)).alias("seg"), "sizes", "n_seg")

    def run(key, values: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not asked.empty and not values.empty:
            x = values.sort_values("pos")["value"].to_numpy(dtype=float, na_value=np.nan)
            for b in asked["sizes"].iloc[0]:
                b = int(b)
                top = circular_maxima(x, b) if is_sliding else x[: x.size // b * b].reshape(-1, b).max(axis=1)
                v, n = np.unique(top, return_counts=True)
                out.append((key[0], int(asked["n_seg"].iloc[0]), int(key[1]), b, v, n))
        return pd.DataFrame(out, columns=["series_id", "n_seg", "seg", "b", "values", "counts"])

    keys = ["series_id", "seg"]
    return rows.groupBy(*keys).cogroup(_own_key(wanted, keys).groupBy(*keys)).applyInPandas(run, "series_id string, n_seg long, seg long, b long, values array<double>, counts array<long>")


def draws(banks_: DataFrame, reps: int = REPS, seed: int = 7, targets=("quantile",), tau: float = TAU) -> DataFrame:
    """(series_id, target, b, rep, y): log summaries of all targets on the same drawn segments; y is null where there is none."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seg")
        n = int(rows["n_seg"].iloc[0])
        drawn = generator(seed, key[0]).integers(0, n, size=(reps, n))
        times = np.stack([np.bincount(d, minlength=n) for d in drawn])
        v = np.concatenate(rows["values"].to_list()).astype(float)
        c = np.concatenate(rows["counts"].to_list())
        seg = np.repeat(rows["seg"].to_numpy(), [len(x) for x in rows["values"]])
        order = np.argsort(v, kind="stable")
        v, c, seg = v[order], c[order], seg[order]
        found = {t: [] for t in targets}
        step = max(1, _CELLS // max(1, len(v)))
        for k in range(0, reps, step):
            w = times[k : k + step][:, seg] * c
            for t in targets:
                found[t].append(summaries(v, w, t, tau))
        parts = []
        for t in targets:
            s = np.concatenate(found[t])
            y = np.log(np.where(np.isfinite(s) & (s > 0), s, np.nan))
            parts.append(pd.DataFrame({"series_id": key[0], "target": t, "b": int(key[1]), "rep": np.arange(reps), "y": y}))
        return pd.concat(parts)

    return banks_.groupBy("series_id", "b").applyInPandas(run, "series_id string, target string, b long, rep long, y double")


def regularised(cov: np.ndarray, shrinkage: float) -> np.ndarray:
    """Shrunk towards its diagonal, with a small ridge."""
    c = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov))
    return c + np.eye(len(c)) * max(abs(np.trace(c) / len(c)) * 1e-8, 1e-12)


def gls(x: np.ndarray, y: np.ndarray, cov: np.ndarray, shrinkage: float = SHRINKAGE) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and their covariance of a weighted least squares fit on columns ``x``."""
    w = np.linalg.pinv(regularised(cov, shrinkage))
    spread = np.linalg.pinv(x.T @ w @ x)
    return spread @ (x.T @ w @ y), spread


def _valid(drawn: pd.DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Block sizes, and the replicates (rows) that are finite at all of them."""
    wide = drawn.pivot(index="rep", columns="b", values=value).sort_index(axis=1)
    m = wide.to_numpy(dtype=float)
    return wide.columns.to_numpy(), m[np.isfinite(m).all(axis=1)]


def _covariance_at(drawn: pd.DataFrame, value: str, sizes: np.ndarray, window_only: bool = False) -> tuple[np.ndarray | None, int]:
    """Covariance at ``sizes`` over the valid replicates, and their number; none for fewer than two or for a size that was not drawn.

    ``window_only`` asks for validity at these sizes only.
    """
    if drawn.empty:
        return None, 0
    own, good = _valid(drawn[drawn["b"].isin(sizes)] if window_only else drawn, value)
    at = np.searchsorted(own, sizes)
    if len(good) < 2 or (at >= len(own)).any() or (own[np.minimum(at, len(own) - 1)] != sizes).any():
        return None, len(good)
    return np.atleast_2d(np.cov(good, rowvar=False))[np.ix_(at, at)], len(good)


_FIT = "series_id string, intercept double, xi double, se double, xi_lo double, xi_hi double, c00 double, c01 double, c11 double, b_lo long, b_hi long, n_points long, reps long, ci_variant string, delta double, rank int"


def weighted(fits: DataFrame, drawn: DataFrame, shrinkages=(SHRINKAGE,), by=("series_id",), ordinary: bool = False) -> DataFrame:
    """Refit windows (``fits`` with part, of severity.ols; several a series with ``rank``) with the covariance of ``drawn``.

    ``by`` names the columns that both share: series_id, and target where there are several.
    Every window uses the same draws; one row per window and shrinkage ``delta``.  The ordinary
    fit stays where there is no covariance, and ``ci_variant`` says so; with ``ordinary`` it is a
    row of its own beside the weighted one (``regression``).
    """
    more = [c for c in by if c != "series_id"]
    schema = _FIT + ", regression string" + "".join(f", {c} string" for c in more)
    names = [c.split()[0] for c in schema.split(", ")]
    rank = F.col("rank").cast("int") if "rank" in fits.columns else F.lit(1)
    side = fits.select("series_id", "intercept", "xi", "c00", "c01", "c11", F.col("part.b").alias("pb"), F.col("part.x").alias("px"), F.col("part.y").alias("py"), rank.alias("rank"), *more)

    def run(key, plans: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for p in plans.sort_values("rank").itertuples():
            sizes, px, py = np.array(p.pb, dtype=int), np.array(p.px), np.array(p.py)
            cov, n = _covariance_at(rows, "y", sizes)
            for regression, delta in [*([("ols", float("nan"))] if ordinary else []), *(("fgls", d) for d in shrinkages)]:
                beta, c, variant = np.array([p.intercept, p.xi]), np.array([[p.c00, p.c01], [p.c01, p.c11]]), "ols"
                if cov is not None and regression == "fgls":
                    beta, c = gls(np.column_stack((np.ones_like(px), px)), py, cov, delta)
                    variant = "bootstrap_cov"
                se = float(np.sqrt(max(c[1, 1], 0.0)))
                out.append((key[0], beta[0], beta[1], se, beta[1] - Z_95 * se, beta[1] + Z_95 * se, c[0, 0], c[0, 1], c[1, 1], sizes[0], sizes[-1], len(sizes), n, variant, float(delta), p.rank, regression, *key[1:]))
        return pd.DataFrame(out, columns=names)

    return side.groupBy(*by).cogroup(_own_key(drawn.select(*by, "b", "rep", "y"), by).groupBy(*by)).applyInPandas(run, schema)


def fgls(series: DataFrame, fits: DataFrame, reps: int = REPS, seed: int = 7, target: str = "quantile", tau: float = TAU, is_sliding: bool = True, shrinkage: float = SHRINKAGE) -> DataFrame:
    """Plateau fits weighted by the bootstrap covariance of the series' whole grid."""
    return weighted(fits, draws(banks(series, grid_table(series), is_sliding), reps, seed, (target,), tau), (shrinkage,))


def estimate(series: DataFrame, target: str = "quantile", tau: float = TAU, is_sliding: bool = True, reps: int = 200, seed: int = 0, shrinkage: float = SHRINKAGE) -> DataFrame:
    """Curve, plateau and bootstrap-weighted fit of every series."""
    from tailspark.operators import curves, select, severity

    points = curves.positive_points(curves.curve(series, grid_table(series), is_sliding, target, tau))
    return fgls(series, severity.ols(select.plateau(points)), reps, seed, target, tau, is_sliding, shrinkage)


def covariance_table(drawn: DataFrame, value: str = "y") -> DataFrame:
    """(series_id, b1, b2, cov, reps): covariance over the replicates that are finite at every block size; no rows for fewer than two."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        b, good = _valid(rows, value)
        if len(good) < 2:
            return pd.DataFrame({"series_id": [], "b1": [], "b2": [], "cov": [], "reps": []})
        cov = np.atleast_2d(np.cov(good, rowvar=False))
        return pd.DataFrame({"series_id": key[0], "b1": np.repeat(b, len(b)), "b2": np.tile(b, len(b)), "cov": cov.ravel(), "reps": len(good)})

    return drawn.select("series_id", "b", "rep", value).groupBy("series_id").applyInPandas(run, "series_id string, b1 long, b2 long, cov double, reps long")


def bootstrap_covariance(series: DataFrame, grid: DataFrame, reps: int = REPS, seed: int = 7, target: str = "quantile", tau: float = TAU, is_sliding: bool = True) -> DataFrame:
    """(series_id, b1, b2, cov, reps): covariance of log summaries over valid replicates."""
    return covariance_table(draws(banks(series, grid, is_sliding), reps, seed, (target,), tau))


# -- circular resampling --------------------------------------------------------------------


def wrapped(x: np.ndarray, rng: np.random.Generator, block: int | None = None) -> np.ndarray:
    """One resample of the same length from blocks that wrap around."""
    size = block or resample_block(x.size)
    starts = rng.integers(0, x.size, size=-(-x.size // size))
    return x[((starts[:, None] + np.arange(size)) % x.size).ravel()[: x.size]]


def resamples(series: DataFrame, reps: int, block: int | None = None, seed: int = 7) -> DataFrame:
    """(series_id, rep, pos, value): circular block resamples of the same length, one task call each."""

    def run(key, values: pd.DataFrame) -> pd.DataFrame:
        x = values.sort_values("pos")["value"].to_numpy(dtype=float, na_value=np.nan)
        return pd.DataFrame({"series_id": key[0], "rep": int(key[1]), "pos": np.arange(x.size), "value": wrapped(x, generator(seed, key[0], int(key[1])), block)})

    each = series.select("series_id", "pos", "value", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    return each.groupBy("series_id", "rep").applyInPandas(run, "series_id string, rep long, pos long, value double")


def _z_paths(x: np.ndarray, wanted: dict[tuple[str, bool], np.ndarray], zeros: bool = False) -> dict[tuple[str, bool], np.ndarray]:
    """Paths of z = ln(1 / theta) over block sizes, NaN where a size has no window; the distribution is worked out once."""
    x = x[np.isfinite(x) & ((x >= 0) if zeros else (x > 0))]
    f = np.clip(np.searchsorted(np.sort(x), x, "right") / (x.size + 1), TINY, 1 - TINY)
    out = {}
    for (base, is_sliding), sizes in wanted.items():
        score = np.log(f) if base == "northrop" else f - 1  # negated, as maxima are at hand
        z = np.full(len(sizes), np.nan)
        for k, b in enumerate(map(int, sizes)):
            n = x.size // b
            if n:
                least = -(running_maxima(score, b) if is_sliding else score[: n * b].reshape(n, b).max(axis=1))
                mean = float(b * least.mean())
                theta = 1 / max(mean, 1.0) if base == "northrop" else min(max(1 / max(mean, TINY) - 1 / b, TINY), 1.0)
                z[k] = -np.log(theta)
        out[base, is_sliding] = z
    return out


def z_path(x: np.ndarray, sizes: np.ndarray, base: str, is_sliding: bool, zeros: bool = False) -> np.ndarray:
    return _z_paths(x, {(base, is_sliding): sizes}, zeros)[base, is_sliding]


def path_draws(series: DataFrame, grid: DataFrame, reps: int = REPS, seed: int = 7, zeros: bool = False, paths=(("northrop", True),)) -> DataFrame:
    """(series_id, base_path, sliding, b, rep, z): paths of resamples of the unfiltered series, filtered per resample.

    All paths share the resamples.  ``grid`` has the block sizes of each series.
    """
    ranges = min(RANGES, reps)
    each = series.select("series_id", "pos", "value", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("part"))
    sizes = grid.groupBy("series_id").agg(F.array_sort(F.collect_set("b")).alias("sizes")).select("series_id", "sizes", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("part"))

    def run(key, values: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not asked.empty and not values.empty:
            b = np.array(asked["sizes"].iloc[0], dtype=int)
            x = values.sort_values("pos")["value"].to_numpy(dtype=float, na_value=np.nan)
            for rep in range(int(key[1]), reps, ranges):
                found = _z_paths(wrapped(x, generator(seed, key[0], rep)), {tuple(p): b for p in paths}, zeros)
                out += [pd.DataFrame({"series_id": key[0], "base_path": base, "sliding": is_sliding, "b": b, "rep": rep, "z": z}) for (base, is_sliding), z in found.items()]
        names = ["series_id", "base_path", "sliding", "b", "rep", "z"]
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    keys = ["series_id", "part"]
    return each.groupBy(*keys).cogroup(_own_key(sizes, keys).groupBy(*keys)).applyInPandas(run, "series_id string, base_path string, sliding boolean, b long, rep long, z double")


def path_covariance(series: DataFrame, base: str = "northrop", is_sliding: bool = True, reps: int = REPS, seed: int = 7, zeros: bool = False) -> DataFrame:
    """Covariance of a path on the whole grid; no rows for a series whose resamples leave some block size without a window."""
    from tailspark.operators import persistence

    grid = grid_table(persistence.prepared(series, zeros))
    return covariance_table(path_draws(series, grid, reps, seed, zeros, ((base, is_sliding),)), "z")


_POOLED = "series_id string, base_path string, sliding boolean, rank int, window_lo long, window_hi long, theta double, theta_lo double, theta_hi double, z_se double, n_levels long, ci_variant string, delta double, regression string"


def pooled(windows: DataFrame, drawn: DataFrame, shrinkages=(SHRINKAGE,), ordinary: bool = False) -> DataFrame:
    """Pooled theta over windows (base_path, sliding and part; several a path with ``rank``) weighted by the covariance of ``drawn``.

    The covariance is taken on a window's own block sizes, so it fits where two replicates are
    finite there; elsewhere the ordinary mean stays.  With ``ordinary`` that is a row of its own.
    """
    names = [c.split()[0] for c in _POOLED.split(", ")]
    rank = F.col("rank").cast("int") if "rank" in windows.columns else F.lit(1)
    side = windows.select("series_id", "base_path", "sliding", rank.alias("rank"), F.col("part.b").alias("pb"), F.col("part.z").alias("pz"))
    keys = ["series_id", "base_path", "sliding"]

    def run(key, plans: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for p in plans.sort_values("rank").itertuples():
            sizes, z = np.array(p.pb, dtype=int), np.array(p.pz)
            cov, _ = _covariance_at(rows, "z", sizes, window_only=True)
            for regression, delta in [*([("ols", float("nan"))] if ordinary else []), *(("fgls", d) for d in shrinkages)]:
                centre, se, variant = float(z.mean()), float(z.std(ddof=1) / np.sqrt(z.size)) if z.size > 1 else 0.0, "ols"
                if cov is not None and regression == "fgls":
                    beta, c = gls(np.ones((z.size, 1)), z, cov, delta)
                    centre, se, variant = float(beta[0]), float(np.sqrt(max(c[0, 0], 0.0))), "bootstrap_cov"
                out.append((*key, p.rank, sizes[0], sizes[-1], np.exp(-centre), np.exp(-(centre + Z_95 * se)), np.exp(-(centre - Z_95 * se)), se, z.size, variant, float(delta), regression))
        return pd.DataFrame(out, columns=names)

    return side.groupBy(*keys).cogroup(_own_key(drawn, keys).groupBy(*keys)).applyInPandas(run, _POOLED)


def percentile_interval(rows: DataFrame, keys: list[str], value: str, level: float = 0.95, least: int = 5) -> DataFrame:
    """Equal-tailed interval of finite draws; null for fewer than ``least``."""
    tail = (1 - level) / 2
    q = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    enough = lambda i: F.when(F.col("n") >= least, F.get("q", F.lit(i)))
    return q.select(*keys, enough(0).alias("lo"), enough(1).alias("hi"))

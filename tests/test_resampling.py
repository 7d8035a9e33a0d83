"""Bootstrap, covariance-weighted fits and shared banks against plain NumPy on whole series."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailspark import series as prep
from tailspark.functions.grid import grid_table
from tailspark.operators import curves, persistence, resample, select, severity
from tailspark.plans import application, benchmark

RNG = np.random.default_rng(17)


def windows_of(x, b, is_sliding):
    """Maxima of a segment, by looking at every window."""
    if is_sliding:
        around = np.concatenate((x, x[: b - 1]))
        return np.array([around[i : i + b].max() for i in range(len(x))])
    return np.array([x[i : i + b].max() for i in range(0, len(x) - b + 1, b)])


def plain_mode(x):
    x = x[np.isfinite(x) & (x > 0)]
    v = np.log1p(x)
    q3, q1 = np.quantile(v, [0.75, 0.25])
    sigma = min(v.std(ddof=1), (q3 - q1) / 1.349)
    h = max(1.059 * sigma * len(v) ** -0.2, 1e-3)
    g = np.linspace(v.min(), v.max(), 256)
    dens = [sum(np.exp(-0.5 * ((a - y) / h) ** 2) for y in v) * np.exp(-a) for a in g]
    return np.expm1(g[int(np.argmax(dens))])


PLAIN = {"quantile": lambda m: np.quantile(m, 0.5, method="median_unbiased"), "mean": np.mean, "mode": plain_mode}


def plain_draws(x, sizes, reps, seed, name, is_sliding, target):
    most, n = max(sizes), len(x)
    span = min(max(4 * most, int(n**0.5), most + 1), n)
    if n // span < 4:
        span = max(most + 1, n // 4)
    k = n // span
    segments = x[: k * span].reshape(k, span)
    drawn = np.random.default_rng([seed, zlib.crc32(name.encode())]).integers(0, k, size=(reps, k))
    out = np.full((reps, len(sizes)), np.nan)
    for j, b in enumerate(sizes):
        bank = [windows_of(s, b, is_sliding) for s in segments]
        for r in range(reps):
            value = PLAIN[target](np.concatenate([bank[i] for i in drawn[r]]))
            if np.isfinite(value) and value > 0:
                out[r, j] = np.log(value)
    return out


def wide(rows, value="y"):
    return rows.toPandas().pivot(index="rep", columns="b", values=value).sort_index(axis=1).to_numpy(dtype=float)


@pytest.mark.parametrize("is_sliding", [True, False])
def test_draws_of_all_targets_equal_plain_numpy(make_series, is_sliding):
    x = RNG.pareto(3, 700) + 1
    s = make_series(a=x, short=x[:40])
    grid = grid_table(s).filter("b < 25")
    sizes = [r["b"] for r in grid.filter("series_id = 'a'").orderBy("b").collect()]
    got = resample.draws(resample.banks(s, grid, is_sliding), 6, 7, ("quantile", "mean", "mode"))
    assert {r["series_id"] for r in got.select("series_id").distinct().collect()} == {"a"}
    for target in PLAIN:
        assert wide(got.filter(F.col("target") == target)) == pytest.approx(plain_draws(x, sizes, 6, 7, "a", is_sliding, target), rel=1e-9)


def test_missing_values_and_negative_summaries_void_replicates(make_series):
    x = np.round(RNG.normal(0.05, 1, 400), 2)
    x[7] = np.nan
    x[200] = np.inf
    s = make_series(a=[None if np.isnan(v) else v for v in x])
    grid = grid_table(s).filter("b < 12")
    sizes = [r["b"] for r in grid.orderBy("b").collect()]
    got = wide(resample.draws(resample.banks(s, grid), 12, 7))
    want = plain_draws(x, sizes, 12, 7, "a", True, "quantile")
    assert (np.isnan(got) == np.isnan(want)).all() and got[~np.isnan(got)] == pytest.approx(want[~np.isnan(want)])


def test_running_extremes_and_weighted_summaries():
    x = RNG.normal(size=200)
    x[50], x[90] = np.inf, np.nan
    for b in (1, 2, 3, 7, 16, 63, 200):
        want = windows_of(x, b, True)
        assert ((resample.circular_maxima(x, b) == want) | (np.isnan(resample.circular_maxima(x, b)) & np.isnan(want))).all()
    v = np.unique(np.round(RNG.pareto(2, 60), 2) + 0.5)
    w = RNG.integers(0, 4, (5, len(v)))
    for target, plain in PLAIN.items():
        assert resample.summaries(v, w, target) == pytest.approx([plain(np.repeat(v, n)) for n in w])
    with pytest.raises(ValueError):
        resample.summaries(v, w, "median")


def plain_gls(x, y, cov, delta):
    c = (1 - delta) * cov + delta * np.diag(np.diag(cov))
    c = c + np.eye(len(c)) * max(abs(np.trace(c)) / len(c) * 1e-8, 1e-12)
    inv = np.linalg.inv(c)
    spread = np.linalg.inv(x.T @ inv @ x)
    return spread @ x.T @ inv @ y, spread


def test_weighted_fit_equals_plain_numpy(make_series):
    x = RNG.pareto(3, 900) + 1
    s = make_series(a=x)
    points = curves.positive_points(curves.curve(s, grid_table(s)))
    plateau = select.plateau(points).first()
    rows = {r["delta"]: r for r in resample.weighted(severity.ols(select.plateau(points)), resample.draws(resample.banks(s, grid_table(s)), 20), (0.0, 0.35, 1.0)).collect()}
    sizes = [r["b"] for r in grid_table(s).orderBy("b").collect()]
    drawn = plain_draws(x, sizes, 20, 7, "a", True, "quantile")
    at = [sizes.index(p["b"]) for p in plateau["part"]]
    cov = np.cov(drawn, rowvar=False)[np.ix_(at, at)]
    px, py = (np.array([p[c] for p in plateau["part"]]) for c in "xy")
    for delta in (0.35, 1.0):
        beta, spread = plain_gls(np.column_stack((np.ones(len(px)), px)), py, cov, delta)
        r = rows[delta]
        assert (r["intercept"], r["xi"]) == pytest.approx(tuple(beta), rel=1e-6)
        assert (r["c00"], r["c01"], r["c11"]) == pytest.approx((spread[0, 0], spread[0, 1], spread[1, 1]), rel=1e-5)
        assert r["se"] == pytest.approx(spread[1, 1] ** 0.5, rel=1e-5) and r["xi_hi"] - r["xi_lo"] == pytest.approx(2 * 1.96 * r["se"]) and r["ci_variant"] == "bootstrap_cov" and r["reps"] == 20
    assert rows[0.0]["ci_variant"] == "bootstrap_cov"


def plain_z(x, sizes, base, is_sliding):
    x = x[np.isfinite(x) & (x > 0)]
    f = np.clip([np.mean(x <= v) * len(x) / (len(x) + 1) for v in x], 1e-8, 1 - 1e-8)
    score = -np.log(f) if base == "northrop" else 1 - f
    out = []
    for b in sizes:
        m = [score[i : i + b].min() for i in range(0, len(x) - b + 1, 1 if is_sliding else b)]
        mean = b * np.mean(m)
        theta = 1 / max(mean, 1) if base == "northrop" else min(max(1 / mean - 1 / b, 1e-8), 1)
        out.append(-np.log(theta))
    return out


def test_path_draws_share_resamples_and_equal_plain_numpy(make_series):
    x = np.abs(RNG.standard_t(3, 300))
    x[::11] = 0
    s = make_series(a=x)
    grid = grid_table(persistence.prepared(s))
    sizes = [r["b"] for r in grid.orderBy("b").collect()]
    got = resample.path_draws(s, grid, 4, 7, paths=persistence.PATHS)
    for base, is_sliding in persistence.PATHS:
        mine = wide(got.filter((F.col("base_path") == base) & (F.col("sliding") == is_sliding)), "z")
        for rep in range(4):
            rng = np.random.default_rng([7, zlib.crc32(b"a"), rep])
            size = min(max(16, round(len(x) ** 0.5)), len(x))
            starts = rng.integers(0, len(x), size=-(-len(x) // size))
            again = np.array([x[(st + k) % len(x)] for st in starts for k in range(size)])[: len(x)]
            assert mine[rep] == pytest.approx(plain_z(again, sizes, base, is_sliding))


def test_pooled_fit_equals_plain_numpy(make_series):
    s = make_series(a=RNG.pareto(2, 600) + 0.1)
    keys = (("bb", True), ("northrop", True))
    values = persistence.prepared(s)
    windows = persistence.stable_paths(values, keys, 2)
    drawn = resample.path_draws(s, grid_table(values), 15, 7, paths=keys)
    parts = {(r["base_path"], r["rank"]): r["part"] for r in windows.collect()}
    rows = resample.pooled(windows, drawn, ordinary=True).collect()
    assert len(rows) == 8
    for r in rows:
        part = parts[r["base_path"], r["rank"]]
        z = np.array([p["z"] for p in part])
        if r["regression"] == "ols":
            centre, se = z.mean(), z.std(ddof=1) / len(z) ** 0.5
        else:
            d = drawn.filter((F.col("base_path") == r["base_path"]) & F.col("b").isin([p["b"] for p in part]))
            beta, spread = plain_gls(np.ones((len(z), 1)), z, np.cov(wide(d, "z"), rowvar=False), 0.35)
            centre, se = beta[0], spread[0, 0] ** 0.5
        assert (r["theta"], r["theta_lo"], r["theta_hi"]) == pytest.approx((np.exp(-centre), np.exp(-centre - 1.96 * se), np.exp(-centre + 1.96 * se)), rel=1e-5)


def test_partitions_do_not_matter(make_series):
    s = make_series(a=RNG.pareto(3, 400) + 1, b=RNG.pareto(3, 300) + 1)
    one, two = (sorted((r["series_id"], round(r["xi"], 10), r["ci_variant"]) for r in resample.estimate(x, reps=10).collect()) for x in (s, s.repartition(7)))
    assert one == two and {r[2] for r in one} == {"bootstrap_cov"}


def test_path_covariance_wants_every_block_size(make_series):
    x = RNG.pareto(2, 400)
    got = resample.path_covariance(make_series(a=x), reps=6).collect()
    sizes = {r["b1"] for r in got}
    assert len(got) == len(sizes) ** 2 and {r["reps"] for r in got} == {6}
    few = np.where(np.arange(400) % 9 == 0, x, -1.0)
    assert all(r["reps"] >= 2 for r in resample.path_covariance(make_series(a=few), reps=6).collect())


@pytest.fixture(scope="module")
def days(spark):
    rows = [(k, i, float(v)) for k in ("u", "v") for i, v in enumerate(RNG.pareto(3, 800) + 0.5)]
    return spark.createDataFrame(rows, "series_id string, day int, value double").selectExpr("series_id", "date_add(DATE'2001-01-01', day) AS ts", "value")


def test_factorial_is_its_parts(days):
    s = prep.numbered(days).select("series_id", "pos", "value")
    rows = {(r["series_id"], r["method"]): r for r in benchmark.evi_factorial(s, reps=8).collect()}
    assert len(rows) == 24
    points = curves.positive_points(curves.curve(s, grid_table(s), False, "mean"))
    for r in severity.ols(select.plateau(points)).collect():
        assert rows[r["series_id"], "disjoint_mean_ols"]["xi"] == pytest.approx(r["xi"])
    for r in resample.estimate(s, reps=8, seed=7).collect():
        mine = rows[r["series_id"], "sliding_median_fgls"]
        assert (mine["xi"], mine["se"], mine["b_lo"]) == pytest.approx((r["xi"], r["se"], r["b_lo"]))


def test_persistence_methods_are_their_parts(days):
    s = prep.numbered(days).select("series_id", "pos", "value")
    rows = {(r["series_id"], r["method"]): r for r in benchmark.ei_methods(s, reps=6).collect()}
    assert len(rows) == 24
    values = persistence.prepared(s)
    for r in persistence.pooled(persistence.stable(persistence.path(values, "bb", False))).collect():
        assert rows[r["series_id"], "bb_disjoint_ols"]["theta"] == pytest.approx(r["theta"])
    for r in persistence.k_gaps(values).collect():
        assert rows[r["series_id"], "k_gaps"]["theta"] == pytest.approx(r["theta"])


def test_application_fits(days):
    four = {(r["series_id"], r["method"]): r for r in application.ei_fits(days, reps=6).collect()}
    assert {m for _, m in four} == set(application.EI_METHODS) and len(four) == 8
    assert all(r["mean_cluster_size"] == pytest.approx(1 / r["theta"]) and r["theta_lo"] <= r["theta"] <= r["theta_hi"] for r in four.values())
    tops = application.ei_window_fits(days, reps=6).collect()
    best = {r["series_id"]: r for r in tops if r["rank"] == 1}
    assert len(tops) == 6 and all(best[k]["theta"] == pytest.approx(four[k, "northrop_sliding_fgls"]["theta"]) for k in best)
    windows = application.evi_window_fits(days, reps=6).collect()
    _, fit = application.fits(days, reps=6)
    first = {r["series_id"]: r for r in windows if r["rank"] == 1}
    assert len(windows) == 6 and all(first[r["series_id"]]["xi"] == pytest.approx(r["xi"]) for r in fit.collect())
    rows = application.method_rows(days, reps=6).collect()
    assert len(rows) == 2 * (4 + 5) and sum(r["is_headline_tau"] for r in rows) == 2
    assert all((r["level_10y"] or 2) > (r["level_1y"] or 1) for r in rows)


def test_simulated_truth_is_met(spark):
    from tailspark.operators import simulate

    table = simulate.scenarios(spark, ("frechet_max_ar",), (0.3, 1.0), (0.5, 1.0), reps=3)
    rows = benchmark.ei_shrinkage_sensitivity(table, (0.0, 0.35, 1.0), reps=6).collect()
    assert {(r["method"], r["delta"]) for r in rows} == {(f"{m}_sliding_fgls", d) for m in ("bb", "northrop") for d in (0.0, 0.35, 1.0)}
    assert all(0 <= r["median_coverage"] <= 1 and r["median_ape"] < 1 for r in rows)

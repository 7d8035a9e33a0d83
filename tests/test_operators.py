"""Operators against plain NumPy on small inputs, with the edge cases of missing and odd values."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tailspark import series
from tailspark.functions import intervals
from tailspark.functions.grid import block_sizes, grid_table
from tailspark.operators import curves, persistence, resample, select, severity, simulate, tail, windows

NAN = float("nan")


def pareto(n, a, seed):
    return 1 + np.random.default_rng(seed).pareto(a, n)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_grid_equals_numpy(spark):
    ns = [*range(32, 400), 730, 2405, 3125, 10_000, 99_999]
    got = {r[0]: list(r[1]) for r in spark.createDataFrame([(n,) for n in ns], "n long").select("n", block_sizes(F.col("n"))).collect()}
    for n in ns:
        lo = max(5, math.ceil(n**0.2))
        hi = max(lo + 4, min(math.floor(n**0.55), n // 15))
        want = np.unique(np.rint(np.geomspace(lo, hi, min(32, max(10, hi - lo + 1)))).astype(int)).tolist()
        assert got[n] == want, n


def test_grid_needs_32(spark):
    assert spark.range(1).select(block_sizes(F.lit(31))).first()[0] is None


def test_disjoint_drops_tail_and_missing(spark, make_series):
    s = make_series(a=[1, 5, None, 2, 4, 3, 9])
    grid = spark.createDataFrame([("a", 2)], "series_id string, b long")
    assert rows(windows.disjoint_on_grid(s, grid), "m") == [(3.0 + 1,), (5.0,)]
    assert windows.disjoint_on_grid(s, spark.createDataFrame([("a", 10)], "series_id string, b long")).count() == 0


def test_sliding_rules(make_series):
    s = make_series(a=[1, 5, None, 2, 4, 3])
    assert rows(windows.sliding(s, [2]), "pos", "m") == [(0, 5.0), (3, 4.0), (4, 4.0)]
    assert windows.sliding(s, [1]).count() == 0
    assert windows.sliding(s, [10]).count() == 0


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=300, max_size=420), st.sampled_from([7, 130, 200, 256]), st.booleans())
def test_sliding_equals_brute_force(make_series, values, b, minimum):
    got = rows(windows.sliding(make_series(a=values), [b], minimum), "pos", "m")
    f = min if minimum else max
    want = [(i, float(f(w))) for i in range(len(values) - b + 1) if None not in (w := values[i : i + b])]
    assert got == want


def test_sliding_over_chunks(make_series, monkeypatch):
    monkeypatch.setattr(windows, "CHUNK", 16)
    x = np.random.default_rng(1).integers(0, 100, 200)
    got = rows(windows.sliding(make_series(a=x), [2, 13]), "b", "pos", "m")
    assert got == sorted((b, i, float(x[i : i + b].max())) for b in (2, 13) for i in range(len(x) - b + 1))


def test_circular(make_series):
    assert [m for _, m in rows(windows.circular(make_series(a=[1, 5, 2, 4]), 2), "pos", "m")] == [5, 5, 4, 4]
    assert [m for _, m in sorted((r["pos"], r["m"]) for r in windows.circular(make_series(a=[1, None, 2, 4]), 3).collect())] == [None, None, 4.0, None]


def test_ecdf(spark, make_series):
    assert [r[1] for r in rows(windows.ecdf(make_series(a=[1, 2, 2, 3])), "pos", "f")] == pytest.approx([0.2, 0.6, 0.6, 0.8])
    points = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("b", 3.0)], "series_id string, q double")
    got = windows.ecdf_at(make_series(a=[1, 2, 3, 4], b=[3]), points)
    assert rows(got, "series_id", "q", "f") == [("a", 2.0, 0.4), ("b", 2.0, 0.0), ("b", 3.0, 1.0)]


@pytest.mark.parametrize("tau", [0.1, 0.5, 0.9])
def test_quantile_is_median_unbiased(make_series, tau):
    x = np.random.default_rng(3).normal(size=37)
    s = make_series(a=x).withColumnRenamed("value", "m")
    assert curves.quantile_by_rank(s, ["series_id"], tau).first()["value"] == pytest.approx(np.quantile(x, tau, method="median_unbiased"))


def test_mode_equals_kernel(make_series):
    x = pareto(200, 2.0, 5)
    assert curves.mode(make_series(a=x).withColumnRenamed("value", "m"), ["series_id"]).first()["value"] == pytest.approx(resample.mode_of(x))


def test_zero_maxima_have_no_positive_point(spark, make_series):
    grid = spark.createDataFrame([("a", b) for b in (2, 4, 8)], "series_id string, b long")
    c = curves.curve(make_series(a=[0] * 40), grid, False, "mean")
    assert rows(c, "is_positive") == [(False,)] * 3


def brute_plateau(x, y, least=5):
    n = len(x)
    lo = int(n * 0.15)
    hi = n - lo
    lo = min(lo, max(n - least, 0))
    if hi - lo < least:
        lo, hi = 0, n
    best = None
    for s in range(lo, hi - least + 1):
        for e in range(s + least, hi + 1):
            xs, ys = x[s:e], y[s:e]
            a = np.column_stack((np.ones(e - s), xs))
            r = ys - a @ np.linalg.lstsq(a, ys, rcond=None)[0]
            bend = np.abs(np.diff(np.diff(ys) / np.diff(xs))).mean()
            score = ((r**2).mean() + 2 * bend) / math.sqrt(e - s)
            if best is None or score < best[0] - 1e-12:
                best = (score, s, e)
    return best


def test_plateau_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    for n in (5, 9, 24):
        b = np.arange(5, 5 + n)
        y = np.cumsum(rng.random(n))
        c = spark.createDataFrame([("a", int(i), True, float(np.exp(v))) for i, v in zip(b, y, strict=True)], "series_id string, b long, is_positive boolean, value double")
        got = select.plateau(curves.positive_points(c)).first()
        want = brute_plateau(np.log(b), y)
        assert (got["start"], got["stop"]) == want[1:] and got["score"] == pytest.approx(want[0])


def test_severity_recovers_pareto(make_series):
    fit = severity.target_scaling(make_series(a=pareto(4096, 2.0, 17))).first()
    # the plateau may be short and the ordinary error ignores dependence, so the bound is a wide one
    assert abs(fit["xi"] - 0.5) < 0.3
    assert fit["xi_lo"] <= fit["xi"] <= fit["xi_hi"]


def test_scaling_does_not_change_xi(make_series):
    x = pareto(600, 2.0, 8)
    fits = severity.target_scaling(make_series(a=x, b=7 * x))
    a, b = sorted(fits.collect(), key=lambda r: r["series_id"])
    assert a["xi"] == pytest.approx(b["xi"]) and (a["b_lo"], a["b_hi"]) == (b["b_lo"], b["b_hi"])
    la, lb = (r["level"] for r in sorted(severity.design_life(fits, [10.0]).collect(), key=lambda r: r["series_id"]))
    assert lb == pytest.approx(7 * la)


def test_short_series_have_a_status(make_series):
    s = make_series(a=pareto(200, 2.0, 1), b=[1.0] * 20)
    got = dict(rows(severity.with_status(s, severity.target_scaling(s)), "series_id", "status"))
    assert got == {"a": "ok", "b": "too few observations"}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "series_id string, pos long, value double")
    assert severity.target_scaling(empty, is_sliding=False).count() == 0
    assert tail.hill(empty).count() == 0
    assert persistence.k_gaps(persistence.prepared(empty)).count() == 0


@pytest.mark.parametrize("method", [tail.hill, tail.moment, tail.pickands, tail.max_spectrum])
def test_tail_estimators_near_truth(make_series, method):
    fit = method(make_series(a=pareto(4096, 2.0, 17))).first()
    assert abs(fit["xi"] - 0.5) < max(4 * fit["se"], 0.4)


def test_tail_needs_eight(make_series):
    assert tail.hill(make_series(a=[1, 2, 3, None, -1, 4, 5])).count() == 0


def test_extremal_index_of_max_ar(make_series):
    phi = simulate.phi_of("frechet_max_ar", 0.4, 1.0)
    x = simulate.draw("frechet_max_ar", 1.0, phi, 8000, np.random.default_rng(4))
    v = persistence.prepared(make_series(a=x))
    theta = persistence.pooled(persistence.stable(persistence.path(v, "northrop", True))).first()["theta"]
    assert abs(theta - 0.4) < 0.12
    assert abs(persistence.k_gaps(v).first()["theta"] - 0.4) < 0.12
    assert abs(persistence.ferro_segers(v).first()["theta"] - 0.4) < 0.15


def test_paths_depend_on_ranks_only(make_series):
    x = pareto(300, 1.5, 6)
    v = persistence.prepared(make_series(a=x, b=np.log(x) + 1))
    got = persistence.path(v, "bb", False).groupBy("b").agg(F.count_distinct(F.round("z", 9)).alias("n")).collect()
    assert {r["n"] for r in got} == {1}


def test_z_path_kernel_equals_query(make_series):
    x = pareto(400, 2.0, 9)
    v = persistence.prepared(make_series(a=x))
    for base, is_sliding in persistence.PATHS:
        got = dict(rows(persistence.path(v, base, is_sliding), "b", "z"))
        sizes = np.array(sorted(got))
        assert resample.z_path(x, sizes, base, is_sliding) == pytest.approx([got[b] for b in sizes])


def test_gls_equals_ols_for_equal_variances():
    x = np.column_stack((np.ones(4), np.arange(1.0, 5)))
    beta, _ = resample.gls(x, x @ [0.5, 2.0], 0.1 * np.eye(4))
    assert beta == pytest.approx([0.5, 2.0])


def test_fgls_and_partitions(spark, make_series):
    s = make_series(a=pareto(365, 2.0, 3), b=pareto(40, 2.0, 4))
    one = rows(resample.estimate(s, reps=30), "series_id", "xi", "ci_variant")
    two = rows(resample.estimate(s.repartition(7), reps=30), "series_id", "xi", "ci_variant")
    assert [r[0] for r in one] == ["a", "b"] and {r[0]: r[2] for r in one} == {"a": "bootstrap_cov", "b": "ols"}
    assert [r[1] for r in one] == pytest.approx([r[1] for r in two])


def test_bootstrap_covariance_is_symmetric(make_series):
    s = make_series(a=pareto(365, 2.0, 3))
    got = {(r["b1"], r["b2"]): r["cov"] for r in resample.bootstrap_covariance(s, grid_table(s), reps=20).collect()}
    assert all(got[b, a] == pytest.approx(v) for (a, b), v in got.items()) and all(got[a, a] >= 0 for a, _ in got)


def test_resamples_are_wrapped_blocks(make_series):
    x = np.arange(50.0)
    got = resample.resamples(make_series(a=x), 3, 10).toPandas()
    for _, g in got.groupby("rep"):
        v = g.sort_values("pos")["value"].to_numpy()
        assert len(v) == 50 and all(((v[k : k + 10] - v[k]) % 50 == np.arange(10)).all() for k in range(0, 50, 10))


@pytest.mark.parametrize("family", [*simulate.FAMILIES, simulate.STRESS])
def test_theta_and_phi_are_inverse(family):
    assert simulate.theta_of(family, simulate.phi_of(family, 0.4, 0.7), 0.7) == pytest.approx(0.4, abs=1e-6)
    assert np.isfinite(simulate.draw(family, 0.7, 0.2, 40, np.random.default_rng(0))).all()


def test_profile_interval_is_where_the_likelihood_falls(spark):
    n, total = 30.0, 45.0
    ll = lambda t: n * F.ln(t) - t * total
    lo, hi = spark.range(1).select(*intervals.profile_interval(ll, F.lit(n / total), F.lit(1e-8), F.lit(1 - 1e-8))).first()
    f = lambda t: n * math.log(t) - t * total
    for t in (lo, hi):
        assert t == pytest.approx(1 - 1e-8) or f(t) == pytest.approx(f(n / total) - 3.841458820694124 / 2, abs=1e-5)


def test_gev_levels_rise(spark):
    m = spark.createDataFrame([("a", 2000 + i, float(v)) for i, v in enumerate([10, 12, 15, 20, 30, 42, 55, 70])], "series_id string, year int, max_value double")
    assert severity.gev_return_level(m, 50).first()["level"] > severity.gev_return_level(m, 10).first()["level"] > 0


def test_gamma_expression(spark):
    for x in (0.51, 1.0, 1.7, 4.2):
        assert spark.range(1).select(severity.gamma(F.lit(x))).first()[0] == pytest.approx(math.gamma(x), rel=1e-12)


def test_order_is_kept_by_compress(make_series):
    assert rows(series.compress(make_series(a=[None, 3, 0, -1, 2])), "pos", "value") == [(0, 3.0), (1, 2.0)]
    assert rows(series.compress(make_series(a=[None, 3, 0, -1, 2]), zeros=True), "value") == [(0.0,), (2.0,), (3.0,)]


@pytest.mark.parametrize("is_sliding", [True, False])
def test_engines_agree(make_series, is_sliding):
    x = [None if i % 50 == 7 else v for i, v in enumerate(pareto(700, 2.0, 2))]
    s = make_series(a=x, b=pareto(90, 1.0, 3), c=[1.0, 2.0])
    grid = grid_table(s)
    for target in ("quantile", "mean"):
        a, b = (rows(curves.curve(s, grid, is_sliding, target, 0.7, e), "series_id", "b", "n_blocks", "value") for e in ("native", "arrow"))
        assert [r[:3] for r in a] == [r[:3] for r in b] and [r[3] for r in a] == pytest.approx([r[3] for r in b])
    v = persistence.prepared(s)
    for base in ("northrop", "bb"):
        a, b = (rows(persistence.path(v, base, is_sliding, engine=e), "series_id", "b", "n_stat", "z") for e in ("native", "arrow"))
        assert [r[:3] for r in a] == [r[:3] for r in b] and [r[3] for r in a] == pytest.approx([r[3] for r in b])


def test_pieces_of_series_join_without_a_seam(make_series, monkeypatch):
    """Chunks, ranges and pieces so small that every series has many of them."""
    from tailspark.operators import kernels

    monkeypatch.setattr(kernels, "CHUNK", 40)
    monkeypatch.setattr(windows, "CHUNK", 16)
    monkeypatch.setattr(series, "CHUNK", 50)
    x = [None if i % 61 == 9 else round(v, 1) for i, v in enumerate(pareto(700, 1.0, 5))]
    s = make_series(a=x, b=pareto(90, 1.0, 3))
    kept = [v for v in x if v is not None and v > 0]
    assert [r[1] for r in sorted(rows(series.compress(s).filter("series_id = 'a'"), "pos", "value"))] == kept
    f = {r[0]: r[1] for r in rows(windows.ecdf_values(s).filter("series_id = 'a'"), "value", "f")}
    assert f == pytest.approx({v: sum(w <= v for w in kept) / (len(kept) + 1) for v in kept})
    grid = grid_table(s)
    for target, tau in (("quantile", 0.7), ("mean", 0.5)):
        a, b = (rows(curves.curve(s, grid, True, target, tau, e), "series_id", "b", "n_blocks", "value") for e in ("native", "arrow"))
        assert [r[:3] for r in a] == [r[:3] for r in b] and [r[3] for r in a] == pytest.approx([r[3] for r in b])
    v = persistence.prepared(s)
    for is_sliding in (True, False):
        a, b = (rows(persistence.path(v, "northrop", is_sliding, engine=e), "series_id", "b", "n_stat", "z") for e in ("native", "arrow"))
        assert [r[:3] for r in a] == [r[:3] for r in b] and [r[3] for r in a] == pytest.approx([r[3] for r in b])


def test_wide_windows_meet_chunk_ends(make_series):
    x = pareto(70_000, 1.0, 8)
    s = make_series(a=x)
    grid = s.sparkSession.createDataFrame([("a", 10), ("a", 500)], "series_id string, b long")
    got = {r[0]: (r[1], r[2]) for r in rows(curves.curve(s, grid, True, "mean"), "b", "n_blocks", "value")}
    import numpy as np

    for b in (10, 500):
        m = np.lib.stride_tricks.sliding_window_view(np.array(x), b).max(axis=1)
        assert got[b] == (len(m), pytest.approx(m.mean()))

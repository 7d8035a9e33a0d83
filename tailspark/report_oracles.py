"""DuckDB SQL of the queries of provider files, registries, summaries and report cells."""

from __future__ import annotations

from tailspark.operators.score import FAMILIES
from tailspark.oracles import _DAYS, _FILLED, _RESULTS, _STATUS, _events, _grid, _maxima, _summary, _with
from tailspark.sources.providers import APPLICATIONS, FIRST_YEAR, PRICE_INDEX, SITES

SQL: dict[str, str] = {}

_PARTIAL = "(SELECT *, count(*) OVER (PARTITION BY series_id, year(ts)) AS n_year, max(year(ts)) OVER (PARTITION BY series_id) AS last_year FROM {src}) WHERE year(ts) < last_year OR n_year >= 0.9 * 365"
SQL["q_station_rain"] = (
    "WITH day AS (SELECT CAST(o_orderdate AS DATE) AS ts, CAST(10 * count(*) AS INTEGER) AS v FROM orders GROUP BY 1), "
    "r AS (SELECT ts, v, 0 AS k FROM day WHERE dayofyear(ts) % 13 <> 0 UNION ALL SELECT ts, v + 1, 1 FROM day WHERE day(ts) = 5), "
    "l AS (SELECT 'USW1' AS series_id, ts, arg_max(v, k) / 10 AS value FROM r GROUP BY ts) "
    f"SELECT series_id, ts, round(greatest(value, 0.0), 6) AS value FROM {_PARTIAL.format(src='l')} AND true"
).replace("WHERE year(ts) < last_year OR n_year >= 0.9 * 365 AND true", "WHERE (year(ts) < last_year OR n_year >= 0.9 * 365) AND month(ts) BETWEEN 6 AND 11")
SQL["q_streamflow"] = (
    "WITH r AS (SELECT CAST(o_orderdate AS DATE) AS ts, CASE o_orderstatus WHEN 'F' THEN '02236000' WHEN 'O' THEN '8066500' ELSE '123456789' END AS series_id, max(o_totalprice) AS value FROM orders GROUP BY 1, 2), "
    f"g AS (SELECT * FROM r WHERE dayofyear(ts) % 17 <> 0) SELECT series_id, ts, round(value, 6) AS value FROM {_PARTIAL.format(src='g')}"
)
_CPI = ", ".join(f"({FIRST_YEAR + i}, {c}::DOUBLE)" for i, c in enumerate(PRICE_INDEX))
SQL["q_claims"] = (
    f"WITH cpi AS (SELECT * FROM (VALUES {_CPI}) v(y, c)), "
    "days AS (SELECT 'TX' AS series_id, CAST(o_orderdate AS DATE) AS ts, sum(o_totalprice * 100 / c) AS value FROM orders JOIN cpi ON year(CAST(o_orderdate AS DATE)) = y WHERE o_custkey % 2 = 0 AND o_orderkey % 29 <> 0 GROUP BY 2), "
    f"{_FILLED} SELECT series_id, ts, round(value, 4) AS value FROM filled"
)
SQL["q_stream_json"] = _with(_DAYS) + "SELECT 'River' AS series_id, ts, round(value, 2) AS value FROM days WHERE day(ts) NOT IN (3, 4)"
SQL["q_records"] = "SELECT o_custkey % 40 AS page, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY 1"
SQL["q_request_windows"] = (
    "WITH s AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders) "
    'SELECT state, CAST(y AS INTEGER) AS year, greatest(make_date(y, 1, 1), a) AS "from", least(make_date(y + 1, 1, 1), b + 1) AS until FROM (SELECT a, b, unnest(range(year(a), year(b) + 1)) AS y FROM s), (VALUES (\'TX\'), (\'FL\')) t(state)'
)
SQL["q_history"] = "SELECT count(*) AS n_rows, CAST(max(ts) - min(ts) AS INTEGER) AS span_days FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ts FROM orders)"
SQL["q_default_tables"] = (
    f"SELECT state_code, site_no, CAST(y AS INTEGER) AS year, c AS cpi_2025_base FROM (VALUES {', '.join(f'({s[0]!r}, {s[1]!r})' for s in SITES if s[3])}) s(state_code, site_no), (VALUES {_CPI}) v(y, c) WHERE y % 10 = 5"
)
SQL["q_roles_registry"] = (
    _with(_DAYS, _FILLED, _STATUS.replace("days AS", "st AS"))
    + "SELECT series_id, role, count(*) AS n_obs, min(ts) AS start, max(ts) AS \"end\" FROM (SELECT series_id, ts, unnest(['display', 'ei']) AS role FROM filled UNION ALL SELECT series_id, ts, 'evi' FROM filled WHERE value > 0 "
    "UNION ALL SELECT series_id, ts, unnest(['display', 'evi', 'ei']) FROM st) GROUP BY 1, 2"
)
_FORMAL = [a[0] for a in APPLICATIONS if a[2]]
SQL["q_application_order"] = (
    f"WITH a AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a[0]!r}, {a[1]!r})' for i, a in enumerate(APPLICATIONS))}) v(place, application, provider)) "
    f"SELECT application, provider, n, CAST(list_position({_FORMAL}, application) - 1 AS INTEGER) AS application_order FROM (SELECT o_custkey % 7 AS place, count(*) AS n FROM orders GROUP BY 1) JOIN a USING (place) WHERE list_position({_FORMAL}, application) > 0"
)
_LABEL = "'universal_' || family || '_xi' || printf('%.2f', xi_true) || '_theta' || printf('%.2f', theta_true) AS scenario"
SQL["q_external_summary"] = (
    _with(_RESULTS)
    + f"SELECT {_LABEL}, family, round(xi_true, 9) AS xi_true, method, ci_method, 'k' AS tuning_axis, n_rep, n_cover, round(coverage, 9) AS coverage, round(mape, 9) AS mape, round(rm, 9) AS relative_error_median, round(wq, 9) AS interval_width_q75, round(sc, 9) AS interval_score_mean, "
    "selected_k, stable_k_lo, stable_k_hi, CAST(NULL AS DOUBLE) AS fixed_upper_level FROM (SELECT family, xi_true, theta_true, method, CASE WHEN rep % 3 = 0 THEN 'wald' ELSE 'bootstrap' END AS ci_method, count(DISTINCT rep) AS n_rep, count(*) FILTER (WHERE covered) AS n_cover, "
    "avg(covered::INT) AS coverage, avg(relative_error) AS mape, quantile_cont(relative_error, 0.5) AS rm, quantile_cont(interval_width, 0.75) AS wq, avg(interval_score) AS sc, quantile_cont((n_obs % 50)::DOUBLE, 0.5) AS selected_k, quantile_cont(n_obs::DOUBLE - 5, 0.5) AS stable_k_lo, "
    "quantile_cont(n_obs::DOUBLE, 0.5) FILTER (WHERE rep % 2 = 0) AS stable_k_hi FROM re GROUP BY ALL)"
)
SQL["q_ei_summary"] = (
    _with(_RESULTS)
    + f"SELECT {_LABEL}, family, method, n_rep, round(coverage, 9) AS coverage, round(m, 9) AS theta_hat_mean, round(sd / sqrt(n_rep), 9) AS theta_hat_se, round(bias, 9) + 0.0 AS bias, round(mae, 9) AS mae, selected_level, stable_level_hi, CAST(NULL AS DOUBLE) AS selected_run_k, "
    "'sliding' AS block_scheme, 'bb' AS base_path, 'fgls' AS regression, CASE WHEN variants = 0 THEN 'default' WHEN variants = 1 THEN variant ELSE 'mixed' END AS ci_variant FROM (SELECT family, xi_true, theta_true, method, count(DISTINCT rep) AS n_rep, avg(covered::INT) AS coverage, avg(xi_hat) AS m, "
    "coalesce(stddev_samp(xi_hat), 0) AS sd, avg(signed_error) AS bias, avg(abs_error) AS mae, quantile_cont((n_obs % 40)::DOUBLE, 0.5) AS selected_level, quantile_cont(n_obs::DOUBLE, 0.5) AS stable_level_hi, count(DISTINCT v) AS variants, max(v) AS variant FROM ("
    "SELECT *, CASE WHEN family LIKE 'p%' THEN CASE WHEN rep % 2 = 0 THEN 'bootstrap_cov' ELSE 'ols' END WHEN family LIKE 'c%' THEN 'ols' END AS v FROM re) GROUP BY 1, 2, 3, 4)"
)
_NAMES = [f[0] for f in FAMILIES]
SQL["q_family_order"] = (
    f"SELECT coalesce(({_NAMES})[k + 1], 'family' || k) AS family, n, CAST(CASE WHEN k < {len(_NAMES)} THEN k ELSE 999 END AS INTEGER) AS family_order, coalesce(({[f[1] for f in FAMILIES]})[k + 1], 'family' || k) AS label "
    "FROM (SELECT user_id % 6 AS k, count(*) AS n FROM events GROUP BY 1)"
)
_G3 = "replace(replace(format('{{:.3g}}', {x}), 'e+0', 'e'), 'e+', 'e')"
_COMPACT = "CASE WHEN {x} IS NULL THEN 'NA' WHEN abs({x}) = 0 THEN '0' WHEN abs({x}) >= 1e4 OR abs({x}) < 1e-2 THEN " + _G3 + " WHEN abs({x}) >= 100 THEN printf('%.0f', {x}) WHEN abs({x}) >= 1 THEN printf('%.2f', {x}) ELSE printf('%.3f', {x}) END"
_SCALED = "CASE WHEN abs({x}) >= 100 THEN {big} WHEN abs({x}) >= 10 THEN printf('%.1f', {x}) WHEN abs({x}) >= 1 THEN printf('%.2f', {x}) ELSE format('{{:.3g}}', {x}) END"
SQL["q_display_cells"] = (
    "WITH u AS (SELECT user_id, avg(value) * pow(10.0, user_id % 9 - 5) * 1.2345678901 AS x, count(*) AS n FROM events GROUP BY 1), m AS (SELECT *, CASE WHEN user_id % 10 <> 0 THEN x END AS y FROM u) "
    f"SELECT user_id, {_COMPACT.format(x='y')} AS compact, {_SCALED.format(x='(x / 10)', big='format(chr(123) || chr(58) || chr(44) || chr(46) || chr(48) || chr(102) || chr(125), x / 10)')} AS scaled, "
    "CASE WHEN y IS NULL THEN 'NA' ELSE printf('%.2f [%.2f, %.2f]', x, x / 2, y * 2) END AS interval, CASE WHEN user_id % 4 <> 0 THEN n || '-' || (n + 7) ELSE 'NA' END AS stable, "
    "CASE WHEN user_id % 5 = 0 THEN 'NA' WHEN user_id % 2 = 0 THEN 'yes' ELSE 'no' END AS flag, CASE WHEN x * 1.02 <= 0.5 THEN 0.5 WHEN x * 1.02 <= 2 THEN 2 WHEN x * 1.02 <= 20 THEN 20 ELSE 500 END::DOUBLE AS axis, "
    "CASE user_id % 3 WHEN 0 THEN 'Texas' WHEN 1 THEN 'Florida' ELSE 'LA' END AS state FROM m"
)
SQL["q_percentile_interval"] = "SELECT user_id, CASE WHEN count(*) >= 5 THEN round(quantile_cont(value, 0.025), 6) END AS lo, CASE WHEN count(*) >= 5 THEN round(quantile_cont(value, 0.975), 6) END AS hi FROM events GROUP BY 1"
SQL["q_kept_counts"] = (
    _with(_events("user_id", True))
    + "SELECT series_id, n, n_kept, CASE WHEN n_kept < 25 THEN 'at least 25 values are needed, ' || n_kept || ' are left' END AS reason FROM (SELECT series_id, count(*) AS n, count(*) FILTER (WHERE value > 0) AS n_kept FROM s GROUP BY 1)"
)
SQL["q_aligned_curve"] = _with(_events(), _grid(), _maxima(False), _summary("mean")) + "SELECT g.series_id, g.b, round(c.value, 6) AS value FROM grid g JOIN cv c ON g.series_id = c.series_id AND g.b = c.b WHERE g.b % 2 = 0"
SQL["q_scenarios"] = (
    "SELECT 'universal' AS benchmark_set, family, xi_true, theta_true, round(pow(1 - theta_true, xi_true), 9) AS phi, 365 AS n_obs, 100 AS reps FROM (VALUES ('frechet_max_ar'), ('pareto_additive_ar1')) f(family), "
    "(VALUES (0.01::DOUBLE), (0.5), (1.0), (5.0)) x(xi_true), (VALUES (0.1::DOUBLE), (0.15), (0.25), (0.4), (0.6), (0.8), (1.0)) t(theta_true)"
)


def frozen(ranked: str) -> str:
    return f"SELECT * EXCLUDE (rank) FROM ({ranked}) WHERE rank = 1"

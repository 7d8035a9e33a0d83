"""DuckDB SQL of the registered queries, put together from shared table expressions."""

from __future__ import annotations

SQL: dict[str, str] = {}


def _events(key: str = "event_type", gaps: bool = False) -> str:
    value = "CASE WHEN event_id % 97 <> 0 THEN value END" if gaps else "value"
    return f"s AS (SELECT CAST({key} AS VARCHAR) AS series_id, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) - 1 AS pos, {value} AS value FROM events)"


_DAYS = "days AS (SELECT 'orders' AS series_id, CAST(o_orderdate AS DATE) AS ts, sum(o_totalprice) AS value FROM orders GROUP BY 2)"
_STATUS = "days AS (SELECT o_orderstatus AS series_id, CAST(o_orderdate AS DATE) AS ts, max(o_totalprice) AS value FROM orders GROUP BY 1, 2)"
_FILLED = (
    "cal AS (SELECT series_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS ts FROM (SELECT series_id, min(ts) AS a, max(ts) AS b FROM days GROUP BY 1)), "
    "filled AS (SELECT c.series_id, c.ts, coalesce(d.value, 0.0) AS value FROM cal c LEFT JOIN days d ON c.series_id = d.series_id AND c.ts = d.ts)"
)


def _grid(source: str = "s", name: str = "grid") -> str:
    return (
        f"{name} AS (SELECT DISTINCT series_id, n, CAST(round_even(lo * pow(hi / lo, i / (k - 1)), 0) AS BIGINT) AS b FROM (SELECT *, unnest(range(0, k)) AS i FROM ("
        f"SELECT *, CAST(least(32, greatest(10, hi - lo + 1)) AS BIGINT) AS k FROM (SELECT *, greatest(lo + 4, least(floor(pow(n, 0.55)), floor(n / 15))) AS hi FROM ("
        f"SELECT series_id, count(*) AS n, greatest(5.0, ceil(pow(count(*), 0.2))) AS lo FROM {source} GROUP BY 1 HAVING count(*) >= 32)))))"
    )


def _maxima(sliding: bool, source: str = "s", grid: str = "grid", f: str = "max", name: str = "mx") -> str:
    if sliding:
        return (
            f"{name}_v AS (SELECT series_id, list(value ORDER BY pos) AS v, count(*) AS n FROM {source} GROUP BY 1), "
            f"{name} AS (SELECT series_id, b, pos, list_{f}(w) AS m FROM (SELECT series_id, b, pos, v[pos + 1:pos + b] AS w FROM ("
            f"SELECT g.series_id, g.b, x.v, unnest(range(0, x.n - g.b + 1)) AS pos FROM {grid} g JOIN {name}_v x ON g.series_id = x.series_id)) WHERE len(list_filter(w, lambda y: y IS NOT NULL)) = b)"
        )
    return (
        f"{name} AS (SELECT s.series_id, g.b, s.pos // g.b AS pos, {f}(s.value) AS m FROM {source} s JOIN {grid} g ON s.series_id = g.series_id "
        f"GROUP BY 1, 2, 3 HAVING count(*) = g.b AND count(s.value) = g.b)"
    )


def _summary(target: str, tau: float = 0.5, name: str = "cv", keys: str = "series_id, b") -> str:
    if target == "mean":
        return f"{name} AS (SELECT {keys}, count(*) AS n_blocks, avg(m) AS value FROM mx GROUP BY ALL)"
    return (
        f"{name} AS (SELECT {keys}, n_blocks, o[CAST(floor(h) AS BIGINT)] * (1 - (h - floor(h))) + coalesce(o[CAST(floor(h) AS BIGINT) + 1], 0) * (h - floor(h)) AS value FROM ("
        f"SELECT {keys}, count(*) AS n_blocks, list_sort(list(m)) AS o, least(greatest((count(*) + 1.0 / 3) * {tau} + 1.0 / 3, 1), count(*))::DOUBLE AS h FROM mx GROUP BY ALL))"
    )


_CURVE = (
    "SELECT g.series_id, g.b, CAST(coalesce(c.n_blocks, 0) AS BIGINT) AS n_blocks, round(c.value, 6) AS value, coalesce(c.value > 0, false) AS is_positive "
    "FROM grid g LEFT JOIN cv c ON g.series_id = c.series_id AND g.b = c.b"
)
_MODE = (
    "md_p AS (SELECT series_id, {b} AS b, ln(1 + m) AS l, m FROM {src} WHERE m > 0), "
    "md_s AS (SELECT series_id, b, count(*) AS n, stddev_samp(l) AS sd, quantile_cont(l, 0.75) - quantile_cont(l, 0.25) AS iqr, min(l) AS lo, max(l) AS hi, min(m) AS one FROM md_p GROUP BY 1, 2), "
    "md_h AS (SELECT *, greatest(1.059 * CASE WHEN sg > 0 THEN sg ELSE greatest(sd, 1e-3) END * pow(n, -0.2), 1e-3) AS h FROM (SELECT *, least(sd, CASE WHEN iqr > 0 THEN iqr / 1.349 ELSE sd END) AS sg FROM md_s WHERE n > 1)), "
    "md_g AS (SELECT *, lo + (hi - lo) * i / 255 AS g FROM (SELECT *, unnest(range(0, 256)) AS i FROM md_h)), "
    "md_d AS (SELECT g.series_id, g.b, g.i, g.g, sum(exp(-0.5 * pow((g.g - p.l) / g.h, 2))) * exp(-g.g) AS d FROM md_g g JOIN md_p p ON g.series_id = p.series_id AND g.b = p.b GROUP BY g.series_id, g.b, g.i, g.g), "
    "md AS (SELECT series_id, b, exp(g) - 1 AS value FROM (SELECT *, row_number() OVER (PARTITION BY series_id, b ORDER BY d DESC, i) AS r FROM md_d) WHERE r = 1 UNION ALL SELECT series_id, b, one FROM md_s WHERE n = 1)"
)


def _windows(points: str, least: int, pull: bool) -> str:
    lo = f"least(cut, greatest(n - {least}, 0))" if pull else "cut"
    return (
        f"wn AS (SELECT series_id, start, unnest(range(start + {least}, hi + 1)) AS stop FROM (SELECT series_id, hi, unnest(range(lo, hi - {least} + 1)) AS start FROM ("
        f"SELECT series_id, CASE WHEN n - cut - lo < {least} THEN 0 ELSE lo END AS lo, CASE WHEN n - cut - lo < {least} THEN n ELSE n - cut END AS hi FROM ("
        f"SELECT *, {lo} AS lo FROM (SELECT series_id, count(*) AS n, CAST(floor(count(*) * 0.15) AS BIGINT) AS cut FROM {points} GROUP BY 1 HAVING count(*) >= {least})))))"
    )


_PLATEAU = (
    "p AS (SELECT series_id, b, ln(b) AS x, ln(value) AS y, row_number() OVER (PARTITION BY series_id ORDER BY b) - 1 AS i FROM cv WHERE value > 0), "
    "pb AS (SELECT *, abs((lead(y, 2) OVER w - lead(y) OVER w) / (lead(x, 2) OVER w - lead(x) OVER w) - (lead(y) OVER w - y) / (lead(x) OVER w - x)) AS bend FROM p WINDOW w AS (PARTITION BY series_id ORDER BY i)), "
    + _windows("p", 5, True)
    + ", sc AS (SELECT w.series_id, w.start, w.stop, (greatest(var_pop(y) - pow(covar_pop(y, x), 2) / var_pop(x), 0) + 2 * coalesce(avg(bend) FILTER (WHERE i < w.stop - 2), 0)) / sqrt(count(*)) AS score "
    "FROM wn w JOIN pb ON w.series_id = pb.series_id AND pb.i >= w.start AND pb.i < w.stop GROUP BY ALL), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score, start, stop) AS rank FROM sc)"
)


def _fits(where: str = "rank = 1") -> str:
    return (
        f"fp AS (SELECT r.series_id, r.rank, p.b, p.x, p.y FROM rk r JOIN p ON r.series_id = p.series_id AND p.i >= r.start AND p.i < r.stop WHERE {where}), "
        "f0 AS (SELECT series_id, rank, count(*) AS n_points, min(b) AS b_lo, max(b) AS b_hi, regr_slope(y, x) AS xi, regr_intercept(y, x) AS intercept, avg(x) AS mx, var_pop(x) * count(*) AS sxx FROM fp GROUP BY 1, 2), "
        "fu AS (SELECT p.series_id, p.rank, p.y - f.intercept - f.xi * p.x AS e, 1.0 / f.n_points - f.mx * (p.x - f.mx) / f.sxx AS u, (p.x - f.mx) / f.sxx AS v FROM fp p JOIN f0 f ON p.series_id = f.series_id AND p.rank = f.rank), "
        "fc AS (SELECT series_id, rank, sum(e * e * u * u) AS c00, sum(e * e * u * v) AS c01, sum(e * e * v * v) AS c11 FROM fu GROUP BY 1, 2), "
        "fit AS (SELECT f.*, c.c00, c.c01, c.c11, sqrt(c.c11) AS se FROM f0 f JOIN fc c ON f.series_id = c.series_id AND f.rank = c.rank)"
    )


_FIT = (
    "SELECT series_id, b_lo, b_hi, n_points, round(intercept, 6) AS intercept, round(xi, 6) AS xi, round(se, 6) AS se, round(xi - 1.96 * se, 6) AS xi_lo, round(xi + 1.96 * se, 6) AS xi_hi, "
    "round(c00, 6) AS c00, round(c01, 6) AS c01, round(c11, 6) AS c11 FROM fit"
)


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


# -- series preparation ---------------------------------------------------------------------

SQL["q_calendar_fill"] = _with(_DAYS, _FILLED) + "SELECT series_id, ts, round(value, 6) AS value FROM filled"
SQL["q_annual_max"] = _with(_DAYS) + "SELECT series_id, CAST(year(ts) AS INTEGER) AS year, round(max(value), 6) AS max_value FROM days GROUP BY 1, 2"
SQL["q_seasonality"] = (
    _with(_DAYS, _FILLED)
    + "SELECT a.series_id, round(stddev_pop(m.mean) / abs(any_value(a.mean)), 6) AS seasonality FROM (SELECT series_id, avg(value) AS mean FROM filled GROUP BY 1) a "
    "JOIN (SELECT series_id, month(ts), avg(value) AS mean FROM filled GROUP BY 1, 2) m ON a.series_id = m.series_id GROUP BY 1"
)
SQL["q_compress"] = _with(_events(gaps=True)) + "SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS pos, round(value, 6) AS value FROM s WHERE value > 0"
SQL["q_keep_last"] = "SELECT event_type, CAST(ts AS DATE) AS ts, max(event_id) AS event_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1, 2"
SQL["q_partial_year"] = (
    _with(_STATUS)
    + "SELECT series_id, ts, round(value, 6) AS value FROM (SELECT *, count(*) OVER (PARTITION BY series_id, year(ts)) AS n, max(year(ts)) OVER (PARTITION BY series_id) AS last FROM days) WHERE year(ts) < last OR n >= 328.5"
)
_ROLL = "CASE WHEN count(value) OVER w >= 10 THEN sum(value) OVER w END"
SQL["q_rolling_sum"] = _with(_DAYS, _FILLED) + f"SELECT series_id, ts, round({_ROLL}, 3) AS value FROM filled WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
_ANOMALY = "(value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0)"
SQL["q_doy_anomaly"] = _with(_DAYS, _FILLED) + f"SELECT series_id, ts, round({_ANOMALY}, 6) AS value FROM filled WINDOW w AS (PARTITION BY series_id, dayofyear(ts))"
SQL["q_hot_dry"] = (
    _with(
        _STATUS,
        "h AS (SELECT ts, value FROM days WHERE series_id = 'F')",
        "r AS (SELECT ts, value FROM days WHERE series_id = 'O')",
        "c0 AS (SELECT CAST(unnest(generate_series(greatest(a1, a2), least(b1, b2), INTERVAL 1 DAY)) AS DATE) AS ts FROM (SELECT min(ts) AS a1, max(ts) AS b1 FROM h), (SELECT min(ts) AS a2, max(ts) AS b2 FROM r))",
        "c AS (SELECT ts FROM (SELECT ts, count(*) OVER (PARTITION BY year(ts)) AS n, max(year(ts)) OVER () AS last FROM c0) WHERE year(ts) < last OR n >= 328.5)",
        *(
            f"{x}1 AS (SELECT ts, {_ROLL} AS value FROM (SELECT c.ts, {x}.value FROM c LEFT JOIN {x} ON c.ts = {x}.ts) WINDOW w AS (ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)), "
            f"{x}2 AS (SELECT ts, {_ANOMALY} AS value FROM {x}1 WHERE month(ts) BETWEEN 4 AND 10 WINDOW w AS (PARTITION BY dayofyear(ts)))"
            for x in "hr"
        ),
    )
    + "SELECT * FROM (SELECT 'x' AS series_id, h2.ts, round(greatest(coalesce(h2.value, 0), 0) + greatest(coalesce(-r2.value, 0), 0), 6) AS value FROM h2 JOIN r2 ON h2.ts = r2.ts "
    "WHERE greatest(coalesce(h2.value, 0), 0) + greatest(coalesce(-r2.value, 0), 0) > 0)"
)
SQL["q_cpi_deflate"] = _with(_DAYS) + "SELECT series_id, ts, round(value * 100 / (60.0::DOUBLE + (year(ts) - 1995) * 2.5), 6) AS value FROM days WHERE year(ts) BETWEEN 1995 AND 2000"
SQL["q_diagnostics"] = (
    _with(_events(gaps=True)) + "SELECT series_id, count(*) AS n, count(*) - count(value) AS n_missing, count(*) FILTER (WHERE value < 0) AS n_negative, count(*) FILTER (WHERE value <= 0) AS n_nonpositive FROM s GROUP BY 1"
)

# -- windows and curves ---------------------------------------------------------------------

SQL["q_block_grid"] = (
    _with(_events("user_id"), _events().replace("s AS", "s2 AS"), _grid(), _grid("s2", "grid2")) + "SELECT series_id, n, b FROM grid UNION ALL SELECT series_id, n, b FROM grid2"
)
_TAIL_GRID = (
    "tn AS (SELECT series_id, count(*) AS n FROM {src} GROUP BY 1), "
    "tg AS (SELECT DISTINCT series_id, n, CAST(round_even(lo * pow(hi / lo, i / 23), 0) AS BIGINT) AS k FROM (SELECT *, least(8, hi)::DOUBLE AS lo, unnest(range(0, 24)) AS i FROM "
    "(SELECT *, least(greatest(10, floor(0.25 * n)), n - 3)::DOUBLE AS hi FROM tn)))"
)
SQL["q_tail_grid"] = (
    _with(_events("user_id"), _TAIL_GRID.format(src="s"))
    + "SELECT series_id, n, k FROM tg UNION ALL SELECT series_id, n, -j AS k FROM (SELECT *, unnest(range(1, 40)) AS j FROM tn) WHERE floor(n / pow(2, j)) >= 2"
)
SQL["q_disjoint_curve"] = _with(_events(gaps=True), _grid(), _maxima(False), _summary("quantile")) + _CURVE
SQL["q_sliding_curve"] = _with(_events(gaps=True), _grid(), _maxima(True), _summary("mean")) + _CURVE
SQL["q_hf8_quantile"] = _with(_events("user_id"), _grid(), _maxima(False), _summary("quantile", 0.9)) + _CURVE
SQL["q_hf7_quantile"] = (
    _with(_events(gaps=True)) + "SELECT series_id, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.9), 6) AS q90, round(quantile_cont(value, 0.95), 6) AS q95 FROM s GROUP BY 1"
)
SQL["q_sliding_minima"] = (
    _with(_events(gaps=True))
    + "SELECT series_id, pos, m FROM (SELECT series_id, pos, min(value) OVER w AS m, count(*) OVER w AS n, count(value) OVER w AS ok FROM s WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)) WHERE n = 13 AND ok = 13"
)
SQL["q_sliding_wide"] = (
    _with(_events(gaps=True))
    + " UNION ALL ".join(
        f"SELECT series_id, CAST({b} AS BIGINT) AS b, count(*) AS n, round(sum(m), 4) AS total, min(pos) AS first_pos, max(pos) AS last_pos FROM (SELECT series_id, pos, max(value) OVER w AS m, count(*) OVER w AS n, count(value) OVER w AS ok "
        f"FROM s WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {b - 1} FOLLOWING)) WHERE n = {b} AND ok = {b} GROUP BY 1"
        for b in (150, 333)
    )
)
SQL["q_circular_max"] = (
    _with(
        _events("user_id", True),
        "n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1)",
        "u AS (SELECT s.*, n.n FROM s JOIN n ON s.series_id = n.series_id UNION ALL SELECT s.series_id, s.pos + n.n, s.value, n.n FROM s JOIN n ON s.series_id = n.series_id WHERE s.pos < 12)",
    )
    + "SELECT series_id, pos, m FROM (SELECT series_id, pos, n, CASE WHEN count(value) OVER w = 13 THEN max(value) OVER w END AS m FROM u WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)) WHERE pos < n"
)
SQL["q_kde_mode"] = _with(_events(), "mm AS (SELECT series_id, value AS m FROM s)", _MODE.format(b="0", src="mm")) + "SELECT series_id, round(value, 6) AS value FROM md"
SQL["q_target_stability"] = (
    _with(_events(), _grid(), _maxima(False), _summary("quantile"), _summary("mean", name="me"), _MODE.format(b="b", src="mx"))
    + "SELECT g.series_id, g.b, round(cv.value, 9) AS median, round(me.value, 9) AS mean, round(md.value, 9) AS mode FROM grid g LEFT JOIN cv ON g.series_id = cv.series_id AND g.b = cv.b "
    "LEFT JOIN me ON g.series_id = me.series_id AND g.b = me.b LEFT JOIN md ON g.series_id = md.series_id AND g.b = md.b"
)
_ECDF = "(SELECT series_id, pos, value, count(value) OVER (PARTITION BY series_id ORDER BY value RANGE UNBOUNDED PRECEDING) / (count(value) OVER (PARTITION BY series_id) + 1) AS f FROM {src} WHERE value IS NOT NULL)"
SQL["q_ecdf"] = _with(_events(gaps=True)) + f"SELECT series_id, pos, round(value, 6) AS value, round(f, 6) AS f FROM {_ECDF.format(src='s')}"
SQL["q_ecdf_at"] = (
    _with(_events(gaps=True))
    + "SELECT s.series_id, round(q.q, 6) AS q, round(count(*) FILTER (WHERE value <= q.q) / (count(value) + 1), 6) AS f FROM s, (VALUES (-1.0::DOUBLE), (10.0), (50.0), (100.5), (1000.0)) q(q) GROUP BY 1, q.q"
)

# -- severity -------------------------------------------------------------------------------

_DISJOINT = (_events(), _grid(), _maxima(False), _summary("quantile"), _PLATEAU)
_SLIDING = (_events(), _grid(), _maxima(True), _summary("quantile"), _PLATEAU)
SQL["q_plateau"] = _with(*_DISJOINT) + "SELECT series_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, round(score, 6) AS score FROM rk WHERE rank = 1"
SQL["q_top3_plateau"] = _with(*_DISJOINT) + "SELECT series_id, CAST(rank AS INTEGER) AS rank, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, round(score, 6) AS score FROM rk WHERE rank <= 3"
SQL["q_evi_ols"] = _with(*_SLIDING, _fits()) + _FIT
SQL["q_evi_disjoint_mean"] = _with(_events(), _grid(), _maxima(False), _summary("mean"), _PLATEAU, _fits()) + _FIT


def _levels(years: tuple[float, ...], columns: str) -> str:
    values = ", ".join(f"({float(y)}::DOUBLE)" for y in years)
    return f"SELECT series_id, years, {columns} FROM (SELECT *, intercept + xi * x AS mu, 1.96 * sqrt(greatest(c00 + 2 * c01 * x + c11 * x * x, 0)) AS half FROM (SELECT fit.*, y.years, ln(365.25 * y.years) AS x FROM fit, (VALUES {values}) y(years)))"


SQL["q_design_life"] = _with(*_SLIDING, _fits()) + _levels((1, 10, 25, 50), "round(exp(mu), 4) AS level")
SQL["q_dll_interval"] = _with(*_SLIDING, _fits()) + _levels((10, 50), "round(exp(mu), 4) AS level, round(exp(mu - half), 4) AS level_lo, round(exp(mu + half), 4) AS level_hi")
SQL["q_shared_tau"] = (
    _with(*_SLIDING, _fits(), *(_summary("quantile", t, f"c{i}") for i, t in enumerate((0.5, 0.9, 0.95, 0.99))))
    + "SELECT series_id, tau, years, round(exp(a + xi * ln(365.25 * years)), 4) AS level FROM (SELECT c.series_id, c.tau, f.xi, avg(ln(c.value) - f.xi * ln(c.b)) AS a FROM ("
    + " UNION ALL ".join(f"SELECT *, {t}::DOUBLE AS tau FROM c{i}" for i, t in enumerate((0.5, 0.9, 0.95, 0.99)))
    + ") c JOIN fit f ON c.series_id = f.series_id AND c.b BETWEEN f.b_lo AND f.b_hi WHERE c.value > 0 GROUP BY ALL), (VALUES (1.0::DOUBLE), (10.0)) y(years)"
)
SQL["q_window_envelope"] = (
    _with(*_DISJOINT, _fits("rank <= 3")) + "SELECT series_id, round(min(exp(intercept + xi * ln(3652.5))), 4) AS level_min, round(max(exp(intercept + xi * ln(3652.5))), 4) AS level_max FROM fit GROUP BY 1"
)
SQL["q_gev_lmoment"] = (
    _with(
        _STATUS,
        "am AS (SELECT series_id, max(value) AS v FROM days GROUP BY series_id, year(ts))",
        "ar AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS n FROM am)",
        "ab AS (SELECT series_id, avg(v) AS b0, avg(r / (n - 1) * v) AS b1, avg(r * (r - 1) / ((n - 1) * (n - 2)) * v) AS b2 FROM ar WHERE n >= 4 GROUP BY 1)",
        "al AS (SELECT *, 2 * b1 - b0 AS l2, 2 / (3 + (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0)) - ln(2) / ln(3) AS c FROM ab WHERE 2 * b1 - b0 > 0)",
        "ak AS (SELECT *, 7.8590 * c + 2.9554 * c * c AS k FROM al)",
        "asc_ AS (SELECT *, l2 * k / (gamma(1 + k) * (1 - pow(2, -k))) AS scale FROM ak)",
        "aloc AS (SELECT *, b0 - scale * (1 - gamma(1 + k)) / k AS location FROM asc_)",
    )
    + "SELECT series_id, round(k, 4) AS shape, round(scale, 4) AS scale, round(location, 4) AS location, round(location + scale / k * (1 - pow(-ln(0.9), k)), 4) AS level FROM aloc"
)

# -- tail -----------------------------------------------------------------------------------

_RANKS = (
    "od AS (SELECT series_id, value, row_number() OVER w AS r, sum(ln(value)) OVER w AS s1, sum(ln(value) * ln(value)) OVER w AS s2, lead(ln(value)) OVER w AS t FROM s WHERE value > 0 "
    "WINDOW w AS (PARTITION BY series_id ORDER BY value DESC, pos))"
)
_HILL = "path AS (SELECT o.series_id, g.k AS level, o.s1 / g.k - o.t AS xi FROM tg g JOIN od o ON g.series_id = o.series_id AND o.r = g.k)"


def _stable(width: int, path: str = "path") -> str:
    return (
        f"q AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY level) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM {path} WHERE xi IS NOT NULL), "
        "q2 AS (SELECT *, abs(lead(xi, 2) OVER w - 2 * lead(xi) OVER w + xi) AS bend FROM q WINDOW w AS (PARTITION BY series_id ORDER BY i)), "
        f"sw AS (SELECT a.series_id, a.i AS start, var_pop(b.xi) + 0.5 * coalesce(avg(b.bend) FILTER (WHERE b.i < a.i + {width} - 2), 0) AS score, any_value(a.n) AS n, min(b.level) AS lo, max(b.level) AS hi, median(b.level) AS mid "
        f"FROM q2 a JOIN q2 b ON a.series_id = b.series_id AND b.i >= a.i AND b.i < a.i + {width} WHERE a.i + {width} <= a.n GROUP BY 1, 2), "
        "sb AS (SELECT series_id, lo, hi, CAST(round_even(mid, 0) AS BIGINT) AS level FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score, start) AS r FROM sw) WHERE r = 1), "
        "sx AS (SELECT b.*, p.xi FROM sb b JOIN (SELECT b.series_id, p.xi, row_number() OVER (PARTITION BY b.series_id ORDER BY abs(p.level - b.level), p.level) AS r FROM sb b JOIN q p ON b.series_id = p.series_id) p ON b.series_id = p.series_id AND p.r = 1)"
    )


def _tail(method: str, se: str) -> str:
    return (
        f"SELECT series_id, '{method}' AS method, CASE WHEN round(xi, 6) = 0 THEN 0.0 ELSE round(xi, 6) END AS xi, level, lo AS window_lo, hi AS window_hi, round(se, 6) AS se, round(xi - 1.959963984540054 * se, 6) AS xi_lo, round(xi + 1.959963984540054 * se, 6) AS xi_hi "
        f"FROM (SELECT *, {se} AS se FROM sx)"
    )


SQL["q_hill"] = _with(_events(), _TAIL_GRID.format(src="s"), _RANKS, _HILL, _stable(4)) + _tail("hill_raw", "abs(xi) / sqrt(level)")
SQL["q_hill_path"] = _with(_events("user_id"), _TAIL_GRID.format(src="s"), _RANKS, _HILL) + "SELECT series_id, level, round(xi, 6) AS xi FROM path"
SQL["q_dedh"] = (
    _with(
        _events(),
        _TAIL_GRID.format(src="s"),
        "od AS (SELECT series_id, ln(value) AS l, row_number() OVER (PARTITION BY series_id ORDER BY value DESC, pos) AS r FROM s WHERE value > 0)",
        "me AS (SELECT g.series_id, g.k AS level, avg(a.l - t.l) AS m1, avg(pow(a.l - t.l, 2)) AS m2 FROM tg g JOIN od t ON g.series_id = t.series_id AND t.r = g.k + 1 JOIN od a ON a.series_id = g.series_id AND a.r <= g.k GROUP BY 1, 2)",
        "path AS (SELECT series_id, level, CASE WHEN m2 > 0 AND abs(1 - m1 * m1 / m2) >= 1e-10 THEN m1 + 1 - 0.5 / (1 - m1 * m1 / m2) END AS xi FROM me)",
        _stable(4),
    )
    + _tail("dedh_moment_raw", "sqrt(1 + xi * xi) / sqrt(level)")
)
SQL["q_pickands"] = (
    _with(
        _events(),
        _TAIL_GRID.format(src="s"),
        "od AS (SELECT series_id, value AS v, row_number() OVER (PARTITION BY series_id ORDER BY value DESC, pos) AS r FROM s WHERE value > 0)",
        "path AS (SELECT g.series_id, g.k AS level, CASE WHEN a.v > b.v AND b.v > c.v THEN ln((a.v - b.v) / (b.v - c.v)) / ln(2) END AS xi FROM tg g JOIN od a ON a.series_id = g.series_id AND a.r = g.k "
        "JOIN od b ON b.series_id = g.series_id AND b.r = 2 * g.k JOIN od c ON c.series_id = g.series_id AND c.r = 4 * g.k)",
        _stable(4),
    )
    + _tail(
        "pickands_raw",
        "CASE WHEN abs(xi) < 1e-8 THEN sqrt(3) / (2 * pow(ln(2), 2) * sqrt(level)) ELSE abs(xi) * sqrt(pow(2, 2 * xi + 1) + 1) / abs(2 * (pow(2, xi) - 1) * ln(2) * sqrt(level)) END",
    )
)
SQL["q_max_spectrum"] = (
    _with(
        _events(),
        "vn AS (SELECT series_id, count(*) AS n FROM s WHERE value > 0 GROUP BY 1)",
        "vc AS (SELECT series_id, value, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS pos FROM s WHERE value > 0)",
        "js AS (SELECT * FROM (SELECT *, unnest(range(1, 40)) AS j FROM vn) WHERE floor(n / pow(2, j)) >= 2)",
        "bl AS (SELECT v.series_id, j.j, v.pos // (1 << j.j) AS bk, max(v.value) AS m FROM vc v JOIN js j ON v.series_id = j.series_id GROUP BY 1, 2, 3 HAVING count(*) = any_value(1 << j.j))",
        "sp AS (SELECT series_id, j, avg(log2(m)) AS y, count(*) AS w FROM bl GROUP BY 1, 2)",
        "ss AS (SELECT a.series_id, a.j AS level, b.j, b.y, b.w FROM sp a JOIN sp b ON a.series_id = b.series_id AND b.j >= a.j)",
        "sm AS (SELECT series_id, level, count(*) AS n, sum(w * j) / sum(w) AS mj, sum(w * y) / sum(w) AS my FROM ss GROUP BY 1, 2 HAVING count(*) >= 3)",
        "sl AS (SELECT s.series_id, s.level, any_value(m.n) AS n, any_value(m.mj) AS mj, any_value(m.my) AS my, sum(w * pow(j - mj, 2)) AS sxx, sum(w * (j - mj) * (y - my)) / sum(w * pow(j - mj, 2)) AS xi "
        "FROM ss s JOIN sm m ON s.series_id = m.series_id AND s.level = m.level GROUP BY 1, 2)",
        "se AS (SELECT s.series_id, s.level, sqrt(sum(pow((y - my - xi * (j - mj)) * w * (j - mj) / sxx, 2)) * any_value(n) / (any_value(n) - 2)) AS se FROM ss s JOIN sl l ON s.series_id = l.series_id AND s.level = l.level GROUP BY 1, 2)",
        "path AS (SELECT series_id, level, xi FROM sl)",
        _stable(3).replace("sx AS", "sx0 AS"),
        "sx AS (SELECT a.*, e.se AS se0 FROM sx0 a LEFT JOIN se e ON a.series_id = e.series_id AND a.level = e.level)",
    )
    + _tail("max_spectrum_raw", "se0")
)

# -- persistence ----------------------------------------------------------------------------

_VALUES = (
    _events(gaps=True).replace("s AS", "s0 AS"),
    "v AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS pos, value FROM s0 WHERE value > 0)",
    _grid("v"),
    f"cdf AS (SELECT series_id, pos, least(greatest(f, 1e-8), 1 - 1e-8) AS f FROM {_ECDF.format(src='v')})",
)


def _path(base: str, sliding: bool, name: str = "pt") -> str:
    score = "-ln(f)" if base == "northrop" else "1 - f"
    eir = "greatest(mean_stat, 1.0)" if base == "northrop" else "1 / least(greatest(1 / greatest(mean_stat, 1e-8) - 1 / b, 1e-8), 1)"
    return (
        f"{name}_s AS (SELECT series_id, pos, {score} AS value FROM cdf), "
        + _maxima(sliding, f"{name}_s", "grid", "min", f"{name}_m")
        + f", {name} AS (SELECT *, {eir} AS eir, 1 / ({eir}) AS theta, ln({eir}) AS z FROM (SELECT series_id, b, count(*) AS n_stat, avg(b * m) AS mean_stat FROM {name}_m GROUP BY 1, 2))"
    )


_STABLE = (
    "pz AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY b) - 1 AS i FROM pt), "
    "p AS (SELECT *, abs(lead(z) OVER w - z) AS d1, abs(lead(z, 2) OVER w - 2 * lead(z) OVER w + z) AS d2 FROM pz WINDOW w AS (PARTITION BY series_id ORDER BY i)), "
    + _windows("p", 4, False)
    + ", sc AS (SELECT w.series_id, w.start, w.stop, (var_pop(z) + 0.75 * avg(d1) FILTER (WHERE i < w.stop - 1) + 0.5 * avg(d2) FILTER (WHERE i < w.stop - 2)) / sqrt(count(*)) AS score, "
    "min(b) AS window_lo, max(b) AS window_hi FROM wn w JOIN p ON w.series_id = p.series_id AND p.i >= w.start AND p.i < w.stop GROUP BY ALL), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score, start, stop) AS rank FROM sc)"
)
_KEYS = [(base, s) for base in ("northrop", "bb") for s in (False, True)]
SQL["q_ei_paths"] = _with(*_VALUES, *(_path(b, s, f"p{i}") for i, (b, s) in enumerate(_KEYS))) + " UNION ALL ".join(
    f"SELECT series_id, '{b}' AS base_path, {str(s).lower()} AS sliding, b, n_stat, round(mean_stat, 6) AS mean_stat, round(theta, 6) AS theta, round(eir, 6) AS eir, round(z, 6) AS z FROM p{i}" for i, (b, s) in enumerate(_KEYS)
)
SQL["q_ei_stable"] = _with(*_VALUES, _path("bb", True), _STABLE) + "SELECT series_id, window_lo, window_hi, window_lo AS selected_level, round(score, 6) AS score FROM rk WHERE rank = 1"
SQL["q_ei_top3"] = (
    _with(*_VALUES, _path("northrop", False), _STABLE) + "SELECT series_id, CAST(rank AS INTEGER) AS rank, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, round(score, 6) AS score FROM rk WHERE rank <= 3"
)
SQL["q_ei_pooled_ols"] = (
    _with(*_VALUES, _path("northrop", True), _STABLE)
    + "SELECT series_id, round(exp(-z), 6) AS theta, round(exp(-(z + 1.96 * se)), 6) AS theta_lo, round(exp(-(z - 1.96 * se)), 6) AS theta_hi, round(se, 6) AS z_se, n AS n_levels FROM ("
    "SELECT r.series_id, avg(p.z) AS z, stddev_samp(p.z) / sqrt(count(*)) AS se, count(*) AS n FROM rk r JOIN p ON r.series_id = p.series_id AND p.i >= r.start AND p.i < r.stop WHERE r.rank = 1 GROUP BY 1)"
)


def _native(base: str) -> tuple[str, ...]:
    return (*_VALUES, _path(base, False), _STABLE, "st AS (SELECT m.series_id, m.b, m.b * m.m AS s FROM pt_m m JOIN rk r ON r.rank = 1 AND m.series_id = r.series_id AND m.b = r.window_lo WHERE m.m > 0)")


SQL["q_bb_native"] = (
    _with(*_native("bb"))
    + "SELECT series_id, b, round(t, 6) AS theta, round(greatest(t - 1.96 * se, 0), 6) AS theta_lo, round(least(t + 1.96 * se, 1), 6) AS theta_hi, round(se, 6) AS se FROM ("
    "SELECT series_id, b, least(greatest(1 / avg(s) - 1 / b, 1e-8), 1) AS t, stddev_samp(s) / sqrt(count(*)) / pow(avg(s), 2) AS se FROM st GROUP BY 1, 2 HAVING count(*) >= 2)"
)


def _root(f: str, lo: str, hi: str, rising: bool) -> str:
    """Sixty halvings; ``f`` is an expression of ``{t}``."""
    side = "<" if rising else ">="
    mid = "((a.lo + a.hi) / 2)"
    return (
        f"list_reduce(list_prepend({{'lo': {lo}::DOUBLE, 'hi': {hi}::DOUBLE}}, list_transform(range(60), lambda i: {{'lo': 0.0::DOUBLE, 'hi': 0.0::DOUBLE}})), "
        f"lambda a, i: CASE WHEN {f.replace('{t}', mid)} {side} 0 THEN {{'lo': {mid}, 'hi': a.hi}} ELSE {{'lo': a.lo, 'hi': {mid}}} END)"
    )


def _northrop(scale: str, variant: str) -> str:
    ll = "(CASE WHEN t + k * ({t} - t) BETWEEN 1e-8 AND 1 THEN n * ln(greatest(t + k * ({t} - t), 1e-300)) - (t + k * ({t} - t)) * total ELSE -1e300 END - (n * ln(t) - t * total - 3.841458820694124 / 2))"
    return (
        _with(
            *_native("northrop"),
            "f0 AS (SELECT series_id, b, count(*)::DOUBLE AS n, sum(s) AS total, sum(s * s) AS sq, least(greatest(count(*) / sum(s), 1e-8), 1) AS t FROM st GROUP BY 1, 2 HAVING count(*) >= 2)",
            f"f1 AS (SELECT *, {scale} AS k FROM f0)",
            f"f2 AS (SELECT *, {_root(ll, '1e-8', 't', True)} AS rl, {_root(ll, 't', '(1 - 1e-8)', False)} AS rh, {ll.replace('{t}', '1e-8')} AS vl, {ll.replace('{t}', '(1 - 1e-8)')} AS vh FROM f1)",
            "f3 AS (SELECT series_id, b, t, CASE WHEN vl >= 0 THEN 1e-8 ELSE (rl.lo + rl.hi) / 2 END AS lo, CASE WHEN vh >= 0 THEN 1 - 1e-8 ELSE (rh.lo + rh.hi) / 2 END AS hi FROM f2)",
        )
        + f"SELECT series_id, b, round(t, 6) AS theta, round(lo, 6) AS theta_lo, round(hi, 6) AS theta_hi, '{variant}' AS ci_variant, round((hi - lo) / 3.92, 6) AS se FROM f3"
    )


SQL["q_northrop_native"] = _northrop("1.0::DOUBLE", "profile")
SQL["q_northrop_adjusted"] = _northrop("sqrt(n / (t * t) / (n / (t * t) - 2 * total / t + sq))", "chandwich_adjusted")
_EXC = (
    "u AS (SELECT series_id, count(*) AS n, unnest([{'tau': 0.9::DOUBLE, 'u': quantile_cont(value, 0.9)}, {'tau': 0.95::DOUBLE, 'u': quantile_cont(value, 0.95)}]) AS q FROM v GROUP BY 1), "
    "ex AS (SELECT v.series_id, u.q.tau AS tau, u.q.u AS u, u.n, v.pos, v.pos - lag(v.pos) OVER (PARTITION BY v.series_id, u.q.tau ORDER BY v.pos) AS gap FROM v JOIN u ON v.series_id = u.series_id WHERE v.value > u.q.u)"
)
SQL["q_exceed_gaps"] = _with(*_VALUES[:2], _EXC) + "SELECT series_id, round(tau, 6) AS tau, round(u, 6) AS u, n, pos, gap FROM ex"


def _fold(candidates: str, out: str, keys: str = "series_id", order: str = "tau") -> str:
    """Of at most two candidates the first, unless the second's interval lies apart from it."""
    return (
        f"{out} AS (SELECT a.* FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS r, lead(lo) OVER (PARTITION BY {keys} ORDER BY {order}) AS lo2, lead(hi) OVER (PARTITION BY {keys} ORDER BY {order}) AS hi2, "
        f"lag(lo) OVER (PARTITION BY {keys} ORDER BY {order}) AS lo1, lag(hi) OVER (PARTITION BY {keys} ORDER BY {order}) AS hi1 FROM {candidates}) a "
        "WHERE (r = 1 AND NOT coalesce(lo > hi2 OR lo2 > hi, false)) OR (r = 2 AND (lo1 > hi OR lo > hi1)))"
    )


SQL["q_ferro_segers"] = (
    _with(
        *_VALUES[:2],
        _EXC,
        "xy AS (SELECT series_id, tau, u, CASE WHEN most <= 2 THEN gap ELSE gap - 1 END::DOUBLE AS x, CASE WHEN most <= 2 THEN gap * gap ELSE (gap - 1) * (gap - 2) END::DOUBLE AS y FROM (SELECT *, max(gap) OVER (PARTITION BY series_id, tau) AS most, count(*) OVER (PARTITION BY series_id, tau) AS c FROM ex) WHERE gap IS NOT NULL AND c >= 3)",
        "fm AS (SELECT series_id, tau, u, avg(x) AS a, avg(y) AS b, var_samp(x) AS va, var_samp(y) AS vb, covar_samp(x, y) AS c, count(*) AS n FROM xy GROUP BY 1, 2, 3)",
        "ff AS (SELECT *, least(greatest(2 * a * a / b, 1e-8), 1) AS theta, sqrt((pow(4 * a / b, 2) * va + 2 * (4 * a / b) * (-2 * a * a / (b * b)) * c + pow(2 * a * a / (b * b), 2) * vb) / n) AS se FROM fm)",
        "fi AS (SELECT *, greatest(theta - 1.96 * se, 0) AS lo, least(theta + 1.96 * se, 1) AS hi FROM ff)",
        _fold("fi", "fo"),
    )
    + "SELECT series_id, round(tau, 6) AS tau, round(u, 6) AS u, round(theta, 6) AS theta, round(lo, 6) AS theta_lo, round(hi, 6) AS theta_hi, round(se, 6) AS se FROM fo"
)
_KLL = "(n0 * ln(greatest(1 - {t}, 1e-8)) + 2 * n1 * ln({t}) - {t} * s - (n0 * ln(greatest(1 - t, 1e-8)) + 2 * n1 * ln(t) - t * s - 3.841458820694124 / 2))"
SQL["q_kgaps"] = (
    _with(
        *_VALUES[:2],
        _EXC,
        "kg AS (SELECT series_id, tau, u, any_value(n) AS n, k.k AS run_k, count(*) AS c, count(*) FILTER (WHERE gap <= k.k)::DOUBLE AS n0, count(*) FILTER (WHERE gap > k.k)::DOUBLE AS n1, sum(greatest(gap - k.k, 0))::DOUBLE AS total FROM ex, (VALUES (1), (2)) k(k) GROUP BY ALL HAVING count(*) >= 3)",
        "ks AS (SELECT *, total * c / n AS s FROM kg)",
        "kt AS (SELECT *, least(greatest(((n0 + 2 * n1 + s) - sqrt(pow(n0 + 2 * n1 + s, 2) - 8 * n1 * s)) / (2 * s), 1e-8), 1 - 1e-8) AS t FROM ks)",
        f"kr AS (SELECT *, {_root(_KLL, '1e-8', 't', True)} AS rl, {_root(_KLL, 't', '(1 - 1e-8)', False)} AS rh, {_KLL.replace('{t}', '1e-8')} AS vl, {_KLL.replace('{t}', '(1 - 1e-8)')} AS vh FROM kt)",
        "ki AS (SELECT series_id, tau, u, run_k, t AS theta, CASE WHEN vl >= 0 THEN 1e-8 ELSE (rl.lo + rl.hi) / 2 END AS lo, CASE WHEN vh >= 0 THEN 1 - 1e-8 ELSE (rh.lo + rh.hi) / 2 END AS hi FROM kr)",
        _fold("ki", "k1", "series_id, tau", "run_k"),
        "k2 AS (SELECT series_id, tau, u, run_k, theta, lo, hi FROM k1)",
        _fold("k2", "k3"),
    )
    + "SELECT series_id, round(tau, 6) AS tau, round(u, 6) AS u, run_k, round(theta, 6) AS theta, round(lo, 6) AS theta_lo, round(hi, 6) AS theta_hi, round((hi - lo) / 3.92, 6) AS se FROM k3"
)

# -- intervals ------------------------------------------------------------------------------

SQL["q_wilson"] = (
    _with(_events("user_id"))
    + "SELECT series_id, round(greatest((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 0), 6) AS lo, round(least((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 1), 6) AS hi "
    "FROM (SELECT series_id, count(*) AS n, count(*) FILTER (WHERE value > 200) / count(*) AS p FROM s GROUP BY 1)"
)
SQL["q_winkler"] = (
    _with(_events("user_id"))
    + "SELECT series_id, round(hi - lo + 40 * CASE WHEN m < lo THEN lo - m WHEN m > hi THEN m - hi ELSE 0 END, 6) AS score, m BETWEEN lo AND hi AS covered, round(hi - lo, 6) AS width "
    "FROM (SELECT series_id, avg(value) AS m, quantile_cont(value, 0.4) AS lo, quantile_cont(value, 0.5) AS hi FROM s GROUP BY 1)"
)

# -- scoring, screening, tables -------------------------------------------------------------

_LABELS = ["disjoint_median_ols", "disjoint_median_fgls", "disjoint_mean_ols", "disjoint_mean_fgls"]
_RESULTS = (
    "r0 AS (SELECT event_type AS family, user_id, avg(value) / 100 AS xi_hat, quantile_cont(value, 0.25) / 100 AS ci_lo, quantile_cont(value, 0.75) / 100 AS ci_hi, count(*) AS n_obs FROM events GROUP BY 1, 2), "
    f"r1 AS (SELECT 'universal' AS benchmark_set, family, CASE WHEN user_id % 2 = 0 THEN 0.3 ELSE 0.6 END::DOUBLE AS xi_true, 0.5::DOUBLE AS theta_true, ({_LABELS})[(user_id // 2) % 4 + 1] AS method, user_id AS rep, n_obs, xi_hat, ci_lo, ci_hi FROM r0), "
    "re AS (SELECT *, xi_hat - xi_true AS signed_error, abs(xi_hat - xi_true) AS abs_error, abs(xi_hat - xi_true) / xi_true AS relative_error, xi_true BETWEEN ci_lo AND ci_hi AS covered, ci_hi - ci_lo AS interval_width, "
    "ci_hi - ci_lo + 40 * CASE WHEN xi_true < ci_lo THEN ci_lo - xi_true WHEN xi_true > ci_hi THEN xi_true - ci_hi ELSE 0 END AS interval_score FROM r1)"
)
SQL["q_benchmark_errors"] = _with(_RESULTS) + "SELECT benchmark_set, family, method, rep, n_obs, covered, " + ", ".join(
    f"round({c}, 9) + 0.0 AS {c}" for c in ("xi_true", "theta_true", "xi_hat", "ci_lo", "ci_hi", "signed_error", "abs_error", "relative_error", "interval_width", "interval_score")
) + " FROM re"
_SUMMARY = (
    "sm AS (SELECT family, xi_true, method, count(DISTINCT rep) AS n_rep, count(*) FILTER (WHERE covered) AS n_cover, avg(covered::INT) AS coverage, avg(relative_error) AS mape, quantile_cont(relative_error, 0.5) AS relative_error_median, "
    "quantile_cont(relative_error, 0.25) AS relative_error_q25, quantile_cont(interval_width, 0.5) AS w, quantile_cont(interval_score, 0.5) AS sc, avg(interval_score) AS interval_score_mean, quantile_cont(interval_score, 0.75) AS interval_score_q75, coalesce(stddev_samp(xi_hat), 0) AS sd FROM re GROUP BY 1, 2, 3)"
)
_WILSON = "(coverage + 3.8416 / (2 * n_rep) {sign} 1.96 * sqrt(coverage * (1 - coverage) / n_rep + 3.8416 / (4 * n_rep * n_rep))) / (1 + 3.8416 / n_rep)"
SQL["q_benchmark_summary"] = (
    _with(_RESULTS, _SUMMARY)
    + f"SELECT family, round(xi_true, 9) AS xi_true, method, replace(method, '_', '-') AS method_label, CAST(list_position({_LABELS}, method) - 1 AS INTEGER) AS method_order, n_rep, n_cover, round(coverage, 9) AS coverage, "
    f"round(greatest({_WILSON.format(sign='-')}, 0), 9) AS coverage_lo, round(least({_WILSON.format(sign='+')}, 1), 9) AS coverage_hi, round(mape, 9) AS mape, round(relative_error_median, 9) AS relative_error_median, round(relative_error_q25, 9) AS relative_error_q25, "
    "round(interval_score_mean, 9) AS interval_score_mean, round(interval_score_q75, 9) AS interval_score_q75, round(sd / sqrt(n_rep), 9) AS xi_hat_se FROM sm"
)
SQL["q_story_pivot"] = (
    _with(_RESULTS, _SUMMARY)
    + "SELECT family, "
    + ", ".join(f"max(CASE WHEN method = '{m}' THEN t END) AS {m}" for m in _LABELS)
    + " FROM (SELECT family, method, printf('%.2f [%.2f, %.2f]', quantile_cont(relative_error_median, 0.5), quantile_cont(relative_error_median, 0.25), quantile_cont(relative_error_median, 0.75)) AS t FROM sm GROUP BY 1, 2) GROUP BY 1"
)
SQL["q_interval_sharpness"] = (
    _with(_RESULTS, _SUMMARY)
    + "SELECT family, method, round(median(w), 9) AS width, round(median(coverage), 9) AS coverage, round(median(sc), 9) AS score FROM (SELECT * FROM sm WHERE method LIKE '%ols' UNION ALL SELECT * FROM sm WHERE method LIKE '%fgls') GROUP BY 1, 2"
)
SQL["q_rank_candidates"] = (
    "SELECT state_code, site_no, recommended, support, plateau_points, round(xi_lo, 6) AS xi_lo, n_years, CAST(row_number() OVER (PARTITION BY state_code ORDER BY recommended DESC, support DESC, plateau_points DESC, n_years DESC, xi_lo DESC, user_id) AS INTEGER) AS rank FROM ("
    "SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'TX' ELSE 'FL' END AS state_code, CAST(user_id AS VARCHAR) AS site_no, count(*) > 60 AS recommended, round(avg(value), 3) > 50 AS support, count(*) AS plateau_points, round(avg(value), 3) AS xi_lo, "
    "CAST(date_diff('day', min(ts)::DATE, max(ts)::DATE) AS INTEGER) AS n_years FROM events GROUP BY 1)"
)
SQL["q_stream_daily"] = (
    "SELECT event_type AS series_id, CAST(ts AS DATE) AS ts, round(max(value), 6) AS value, count(*) AS n FROM events GROUP BY 1, 2 HAVING CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 7 DAY FROM events)"
)
_SCREEN_VALUES = (
    _DAYS,
    _FILLED,
    "v AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos, value FROM filled WHERE value > 0)",
    _grid("v"),
    f"cdf AS (SELECT series_id, pos, least(greatest(f, 1e-8), 1 - 1e-8) AS f FROM {_ECDF.format(src='v')})",
)
_KGAPS = SQL["q_kgaps"].split("kg AS", 1)[1].rsplit("SELECT series_id, round(tau, 6)", 1)[0]
SQL["q_screen_ei"] = (
    _with(*_SCREEN_VALUES, _path("bb", True), _STABLE, _EXC)
    + ", kg AS"
    + _KGAPS
    + ", bb AS (SELECT r.series_id, exp(-avg(p.z)) AS theta, any_value(r.window_lo) AS lo, any_value(r.window_hi) AS hi FROM rk r JOIN p ON r.series_id = p.series_id AND p.i >= r.start AND p.i < r.stop WHERE r.rank = 1 GROUP BY 1) "
    "SELECT f.series_id, f.n_obs, round(f.ps, 6) AS positive_share, round(f.zs, 6) AS zero_share, round(bb.theta, 6) AS theta_bb, round(k3.theta, 6) AS theta_kg, bb.lo AS stable_lo, bb.hi AS stable_hi, f.years >= 5 AND bb.lo > 0 AND k3.theta IS NOT NULL AS recommended "
    "FROM (SELECT series_id, count(*) AS n_obs, avg((value > 0)::INT) AS ps, avg((value = 0)::INT) AS zs, (max(ts) - min(ts)) / 365.25 AS years FROM filled GROUP BY 1) f LEFT JOIN bb ON f.series_id = bb.series_id LEFT JOIN k3 ON f.series_id = k3.series_id"
)

SQL["q_ei_window_variants"] = (
    _with(*_SCREEN_VALUES, _path("northrop", True), _STABLE)
    + "SELECT series_id, rank, window_lo, window_hi, round(exp(-z), 6) AS theta, round(exp(-(z + 1.96 * se)), 6) AS theta_lo, round(exp(-(z - 1.96 * se)), 6) AS theta_hi FROM ("
    "SELECT r.series_id, CAST(r.rank AS INTEGER) AS rank, r.window_lo, r.window_hi, avg(p.z) AS z, stddev_samp(p.z) / sqrt(count(*)) AS se FROM rk r JOIN p ON r.series_id = p.series_id AND p.i >= r.start AND p.i < r.stop WHERE r.rank <= 3 GROUP BY ALL)"
)


def _more() -> None:
    from tailspark import report_oracles

    SQL.update(report_oracles.SQL)
    SQL["q_frozen_sites"] = report_oracles.frozen(SQL["q_rank_candidates"])


_more()

"""Formatters, fetching, caches, defaults, candidates, application outputs and the command line."""

import json
from urllib.error import HTTPError

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tailspark import contracts
from tailspark.operators import curves, persistence, score, screen, simulate
from tailspark.plans import application, benchmark
from tailspark.sources import fetch, providers

RNG = np.random.default_rng(23)


def plain_compact(x):
    if x is None or not np.isfinite(x):
        return "NA"
    a = abs(x)
    if a == 0:
        return "0"
    if a >= 1e4 or a < 1e-2:
        return f"{x:.3g}".replace("e+0", "e").replace("e+", "e")
    return f"{x:.0f}" if a >= 100 else f"{x:.2f}" if a >= 1 else f"{x:.3f}"


def test_cells(spark):
    values = [None, float("nan"), float("inf"), 0.0, 1.0, -3.14159, 123.4567, 98765.4321, 1e12, 0.012345, 0.0098765, -0.0001234567, 0.00001234, 9999.6, 12000.0, 99960.0]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = {r["i"]: r for r in d.select("i", score.compact(F.col("x")).alias("c"), score.scaled(F.col("x"), 1.0).alias("s"), score.interval_text(F.col("x"), F.lit(1.0), F.col("x")).alias("t"), score.axis_limit(F.col("x"), (0.5, 5.0, 100.0)).alias("a")).collect()}
    for i, v in enumerate(values):
        assert got[i]["c"] == plain_compact(v)
        assert (got[i]["t"] == "NA") == (plain_compact(v) == "NA")
    assert [got[i]["s"] for i in (3, 4, 6, 7, 9)] == ["0", "1.00", "123", "98,765", "0.0123"]
    assert [got[i]["a"] for i in (0, 3, 4, 6, 7)] == [None, 0.5, 5.0, 100.0, 100.0]
    flags = spark.createDataFrame([(None,), ("TRUE",), ("no",), ("0",), ("x",)], "f string").select(score.yes_no(F.col("f")).alias("f")).collect()
    assert [r["f"] for r in flags] == ["NA", "yes", "no", "no", "yes"]
    assert spark.range(1).select(score.yes_no(F.lit(False)).alias("f"), score.window_text(F.lit(3), F.lit(None)).alias("w")).first() == ("no", "NA")


def test_fetch_tries_again_and_gives_up():
    asked, slept = [], []

    def opener(url):
        asked.append(url)
        if len(asked) == 1:
            raise HTTPError(url, 503, "busy", None, None)
        return "no json" if len(asked) == 2 else '{"ok": 1}'

    assert json.loads(fetch.fetch("u", opener, sleep=slept.append)) == {"ok": 1} and slept == [2.0, 2.0]

    def missing(url):
        raise HTTPError(url, 404, "gone", None, None)

    with pytest.raises(HTTPError):
        fetch.fetch("u", missing, sleep=slept.append)
    with pytest.raises(json.JSONDecodeError):
        fetch.fetch("u", lambda url: "<html>", sleep=lambda s: None)


def test_pages_of_claims(spark):
    windows = fetch.year_windows(spark, ["tx"], "2019-03-01", "2021-02-10")
    assert [(r["year"], str(r["from"]), str(r["until"])) for r in windows.orderBy("year").collect()] == [(2019, "2019-03-01", "2020-01-01"), (2020, "2020-01-01", "2021-01-01"), (2021, "2021-01-01", "2021-02-11")]

    def opener(url):
        import json
        from urllib.parse import parse_qs, urlparse

        q = parse_qs(urlparse(url).query)
        year, skip, page = int(q["$filter"][0].split("ge '")[1][:4]), int(q["$skip"][0]), int(q["$top"][0])
        rows = [{"state": "TX", "dateOfLoss": f"{year}-05-01T00:00:00Z", "amountPaidOnBuildingClaim": i} for i in range(year - 2014)]
        return json.dumps({"metadata": {}, "FimaNfipClaims": rows[skip : skip + page]})

    got = fetch.fetch_claims(windows, opener, page=3, sleep=lambda s: None)
    assert {r["year"]: r["n"] for r in got.groupBy("year").agg(F.count("*").alias("n"), F.count("dateOfLoss").alias("d")).collect()} == {2019: 5, 2020: 6, 2021: 7}
    assert "startDT=1980-01-01" in fetch.discharge_url("0123") and "endDT" not in fetch.discharge_url("0123")


def test_records_of_payloads(spark):
    texts = ['{"a": 1, "data": [{"x": 1}, 5, {"x": 2}]}', '{"note": "[x", "zz": [{"x": 3}]}', '{"results": "none", "FimaNfipClaims": [{"x": 4}]}', '{"a": 1}', "broken"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fetch.records(F.col("t")).alias("r"))
    got = {r["i"]: None if r["r"] is None else [json.loads(x)["x"] for x in r["r"]] for r in d.collect()}
    assert got == {0: [1, 2], 1: [3], 2: [4], 3: None, 4: None}
    assert fetch.listed(json.loads(texts[0])) == [{"x": 1}, {"x": 2}]
    with pytest.raises(ValueError):
        fetch.listed({"a": 1})


def test_cached_claims_are_judged(spark, tmp_path):
    good = tmp_path / "tx.csv"
    good.write_text("state,dateOfLoss,amountPaidOnBuildingClaim\n" + "TX,2020-01-01,5\n" * 4)
    assert not providers.claims_need_refresh(spark, str(good), "tx") and providers.claims_need_refresh(spark, str(good), "FL")
    small, lacking = tmp_path / "s.csv", tmp_path / "l.csv"
    small.write_text("state\nTX\n")
    lacking.write_text("state,dateOfLoss\n" + "TX,2020-01-01\n" * 9)
    assert all(providers.claims_need_refresh(spark, str(p), "TX") for p in (small, lacking, tmp_path / "none.csv"))
    days = spark.range(2_000).selectExpr("date_add(DATE'2010-01-01', CAST(id AS INT)) AS date")
    assert providers.discharge_valid(days) and not providers.discharge_valid(days.limit(900)) and not providers.discharge_valid(days.toDF("day"))


def test_default_tables_are_written_once(spark, tmp_path):
    paths = providers.ensure_defaults(spark, str(tmp_path))
    index = spark.read.parquet(paths["price_index"])
    assert index.count() == 48 and index.filter("year = 2025").first()["cpi_2025_base"] == 100 and spark.read.parquet(paths["frozen_sites"]).count() == 2
    spark.range(1).write.mode("overwrite").parquet(paths["candidate_sites"])
    providers.ensure_defaults(spark, str(tmp_path))
    assert spark.read.parquet(paths["candidate_sites"]).columns == ["id"]


def test_caches_are_rebuilt_when_they_do_not_fit(spark, tmp_path):
    path, built = str(tmp_path / "t"), []

    def build():
        built.append(1)
        return spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")

    for version, expected in ((1, ["a", "b"]), (1, ["b", "a"]), (2, ["a", "b"]), (2, ["a", "b"])):
        assert benchmark.load_or_build(spark, path, {"k", "v"}, {"k": expected}, build, version).count() == 2
    assert len(built) == 2
    for f in (tmp_path / "t").glob("*.parquet"):
        f.write_bytes(b"damaged")
    assert benchmark.load_or_build(spark, path, {"k", "v"}, {"k": ["a", "b"]}, build, 2).count() == 2 and len(built) == 3


def test_aligned_curves_want_every_size(spark):
    curve = spark.createDataFrame([("a", 5, 1.0), ("a", 6, None)], "series_id string, b long, value double")
    wanted = spark.createDataFrame([("a", 5), ("a", 6)], "series_id string, b long")
    assert sorted((r["b"], r["value"]) for r in curves.aligned(curve, wanted).collect()) == [(5, 1.0), (6, None)]
    with pytest.raises(PySparkException, match="no block size 7"):
        curves.aligned(curve, wanted.union(spark.createDataFrame([("a", 7)], wanted.schema))).collect()


def test_positive_finite(make_series):
    s = make_series(a=[1, 0, -1, None, 2], b=[1])
    assert sorted((r["series_id"], r["value"]) for r in contracts.positive_finite(s, 2).collect()) == [("a", 1.0), ("a", 2.0)]
    assert contracts.positive_finite(s, 3, zeros=True).count() == 3
    assert {r["series_id"]: r["reason"] for r in contracts.kept_counts(s, 2).collect()} == {"a": None, "b": "at least 2 values are needed, 1 are left"}


@pytest.fixture(scope="module")
def days(spark):
    rows = [(k, i, float(v)) for k, n in (("u", 900), ("v", 20)) for i, v in enumerate(RNG.pareto(3, n) + 0.5)]
    return spark.createDataFrame(rows, "series_id string, day int, value double").selectExpr("series_id", "date_add(DATE'2001-01-01', day) AS ts", "value")


def test_candidates_that_fail_stay(spark, days):
    sites = spark.createDataFrame([("TX", "u"), ("TX", "v"), ("FL", "w")], "state_code string, site_no string")
    got = {r["site_no"]: r for r in screen.candidates(sites, days, reps=6, min_years=1).collect()}
    assert got["u"]["error"] is None and got["u"]["xi_lo"] > screen.FAILED
    assert (got["v"]["error"], got["w"]["error"]) == ("too few observations", "no observations")
    assert all(got[k]["xi_lo"] == screen.FAILED and got[k]["recommended"] is False for k in "vw")


def test_build_writes_all_tables(spark, days, tmp_path):
    one = days.filter("series_id = 'u'")
    paths = application.build(providers.shared_roles(one), str(tmp_path / "out"), reps=6)
    assert spark.read.parquet(str(tmp_path / "out" / "manifest")).count() == len(paths) == 7
    assert all(spark.read.parquet(p).count() > 0 for p in paths.values())
    sens = spark.read.parquet(paths["selection"]).first()
    assert sens["xi_min"] <= sens["xi"] <= sens["xi_max"] and sens["theta_min"] <= sens["theta"] <= sens["theta_max"]


def test_path_plot_rows(make_series):
    values = persistence.prepared(make_series(a=RNG.pareto(2, 300)))
    rows = application.path_plot_data(values).collect()
    inside = [r["b"] for r in rows if r["in_window"]]
    stable = persistence.stable(persistence.path(values, "northrop", True)).first()
    assert rows and min(inside) == stable["window_lo"] and max(inside) == stable["window_hi"] and all(r["x"] == pytest.approx(np.log(r["b"])) for r in rows)


def test_scenario_grids(spark):
    assert (simulate.default_evi(spark).count(), simulate.default_ei(spark).count(), simulate.stress(spark).count()) == (84, 84, 9)
    groups = simulate.expected_groups(simulate.stress(spark))
    assert groups["xi_true"] == [0.1, 0.3, 1.0] and groups["n_obs"] == [365]


def test_inputs_and_registry(spark, tmp_path):
    claims = spark.createDataFrame([("TX", "2024-01-01", "10"), ("TX", "2024-01-03", "5"), ("FL", "2024-02-01", "1")], "state string, day string, amountPaidOnBuildingClaim string").withColumn("dateOfLoss", F.col("day").cast("timestamp"))
    rows = providers.application_inputs(spark, claims=claims)
    got = {(r["series_id"], r["role"]): r["n_obs"] for r in providers.write_inputs(rows, str(tmp_path / "in")).collect()}
    assert got["tx_nfip_claims", "display"] == 3 and got["tx_nfip_claims", "evi"] == 2 and len(got) == 6
    with pytest.raises(ValueError):
        providers.application_inputs(spark)


def test_command_line(spark, tmp_path):
    from tailspark.__main__ import main

    main(["q_history", "/root/testdata/sf0.001", str(tmp_path / "o")])
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1

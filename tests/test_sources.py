"""Provider files, the stream, and SQL functions."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tailspark.functions.register import register
from tailspark.sources import providers as p

DAY = datetime.date


def test_station_keeps_last_and_skips_flagged(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text("X,20200101,PRCP,12,,,S,\nX,20200101,PRCP,15,,,S,\nX,20200102,PRCP,99,,G,S,\nX,20200101,TMAX,301,,,S,\n")
    st = p.read_station(spark, str(f))
    assert [(r["ts"], r["value"]) for r in p.element(st, "PRCP", 10.0).collect()] == [(DAY(2020, 1, 1), 1.5)]
    assert not p.station_valid(st, ["PRCP"])
    assert p.station_valid(st, ["PRCP", "TMAX"], rows=4, days=0)
    assert not p.station_valid(st, ["SNOW"], rows=4, days=0)


def test_hot_dry(spark, tmp_path):
    lines, d = [], DAY(2020, 1, 1)
    while d < DAY(2022, 1, 1):
        lines += [f"X,{d:%Y%m%d},TMAX,{450 if d == DAY(2021, 7, 15) else 300},,,S,", f"X,{d:%Y%m%d},PRCP,10,,,S,"]
        d += datetime.timedelta(1)
    f = tmp_path / "h.csv"
    f.write_text("\n".join(lines) + "\n")
    got = p.hot_dry(p.read_station(spark, str(f))).collect()
    assert got and all(r["value"] > 0 and r["ts"].year == 2021 for r in got) and min(r["ts"] for r in got) >= DAY(2021, 7, 15)


def test_streamflow(spark, tmp_path):
    f = tmp_path / "q.csv"
    f.write_text("date,discharge_cfs,site_no,station_name\n" + "".join(f"{DAY(2020, 1, 1) + datetime.timedelta(i)},{10 + i % 5},02236000,St\n" for i in range(365)) + "2020-12-30,-5,02236000,St\n")
    got = p.streamflow(p.read_discharge(spark, str(f)), "02236000")
    assert got.count() == 365 and got.agg(F.min("value")).first()[0] == 10


def test_stream_json_prefers_the_daily_mean(spark, tmp_path):
    one = lambda code, v: {"name": f"USGS:1:00060:{code}", "sourceInfo": {"siteName": "River"}, "values": [{"value": [{"dateTime": "2020-01-01T00:00", "value": "1"}, {"dateTime": "2020-01-01T00:00", "value": v}, {"dateTime": "2020-01-02T00:00", "value": ""}, {"dateTime": "2020-01-03", "value": "-9"}]}]}
    f = tmp_path / "d.json"
    f.write_text(json.dumps({"value": {"timeSeries": [one("00001", "99"), one("00003", "10")]}}))
    assert [tuple(r) for r in p.read_stream_json(spark, str(f)).collect()] == [("River", DAY(2020, 1, 1), 10.0)]


def test_claims(spark, tmp_path):
    f, c = tmp_path / "n.csv", tmp_path / "c.csv"
    f.write_text("state,dateOfLoss,amountPaidOnBuildingClaim\nTX,2024-01-01,100\nTX,2024-01-01,50\nTX,2024-01-03,0\ntx,2024-01-05,200\nFL,2024-01-02,999\nTX,2024-01-04,bad\n")
    c.write_text("year,cpi_2025_base\n2024,97.4\n2025,100\n")
    claims = p.read_claims(spark, str(f))
    full, positive = p.claim_days(claims, p.read_index(spark, str(c)), "tx")
    assert full.count() == 5 and positive.count() == 2
    assert full.orderBy("ts").first()["value"] == pytest.approx(150 * 100 / 97.4)
    assert not p.claims_valid(claims, "TX")
    assert p.claims_valid(claims.filter("upper(state) = 'TX'"), "tx")
    r = p.registry(p.roles(full, positive, full))
    assert {(x["role"], x["n_obs"]) for x in r.collect()} == {("display", 5), ("evi", 2), ("ei", 5)}


def test_index_columns_are_checked(spark, tmp_path):
    f = tmp_path / "bad.csv"
    f.write_text("jahr,x\n1,2\n")
    with pytest.raises(ValueError, match="lacks"):
        p.read_index(spark, str(f))


def test_site_numbers(spark):
    a = spark.createDataFrame([("TX", "2236000.0"), ("TX", "123456789")], "state_code string, site_no string")
    b = spark.createDataFrame([("TX", "02236000", 1)], "state_code string, site_no string, n int")
    assert {(r["site_no"], r["n"]) for r in p.site_audit(a, b).collect()} == {("02236000", 1), ("123456789", None)}


def test_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", DAY(2020, 1, 1), 1.0), ("b", DAY(2020, 1, 2), 2.0)], "series_id string, ts date, value double")
    p.write_series(rows, str(tmp_path / "s"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "s")).select("series_id", "ts", "value").collect()} == {tuple(r) for r in rows.collect()}
    p.write_csv_gz(rows, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def test_late_rows_change_only_open_days(spark, tmp_path):
    from tailspark.streaming.maintain import daily_maxima, refit

    src = tmp_path / "in"
    schema = "series_id string, ts timestamp, value double"
    at = lambda d, h=1: datetime.datetime(2024, 1, d, h)
    for k, part in enumerate(([("a", at(1), 1.0), ("a", at(9), 5.0)], [("a", at(1), 99.0), ("a", at(8), 7.0), ("a", at(25), 1.0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        days = daily_maxima(spark.readStream.schema(schema).parquet(str(src)))
        q = refit(days, str(tmp_path / "days"), str(tmp_path / "cp"), lambda d: d.groupBy("series_id").agg(F.max("value").alias("m")), str(tmp_path / "fits")).trigger(availableNow=True).start()
        q.awaitTermination()
        del k
    got = {(r["ts"].day, r["value"]) for r in spark.read.parquet(str(tmp_path / "days")).collect()}
    assert got == {(1, 1.0), (8, 7.0), (9, 5.0)}


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "k string, v double").createOrReplaceTempView("ten")
    r = spark.sql("SELECT hf8_quantile(v, 0.9D) AS q FROM ten GROUP BY k").first()[0]
    assert r == pytest.approx(9.6333333)
    assert spark.sql("SELECT winkler_score(5D, 1D, 3D)").first()[0] == pytest.approx(82)
    assert spark.sql("SELECT wilson_lo(0D, 10D), wilson_hi(10D, 10D)").first()[1] == pytest.approx(1)
    assert [x[0] for x in spark.sql("SELECT * FROM block_grid(64)").collect()] == [5, 6, 7, 8, 9]

"""Files of the three data providers: schemas, readers, preparation, validity checks, writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailspark import series

STATION = "station_id string, date string, element string, value int, mflag string, qflag string, sflag string, obstime string"
DISCHARGE = "date date, discharge_cfs double, site_no string, station_name string"
CLAIMS = "state string, dateOfLoss timestamp, amountPaidOnBuildingClaim string"
INDEX = "year int, cpi_2025_base double"
_OPTION = "array<struct<name:string,optionCode:string>>"
_STREAM = (
    "value struct<timeSeries:array<struct<name:string,sourceInfo:struct<siteName:string>,"
    f"variable:struct<options:struct<option:{_OPTION}>>,values:array<struct<value:array<struct<dateTime:string,value:string>>>>>>>"
)


def _placed(rows: DataFrame) -> DataFrame:
    """Adds ``ordinal``: file, start of the split in it, and row within the split; the same however splits are dealt to tasks."""
    return rows.withColumn("ordinal", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")))


def read_station(spark: SparkSession, path: str) -> DataFrame:
    """Daily station files without header; an empty flag is none.  ``ordinal`` keeps file order for keep-last."""
    raw = _placed(spark.read.csv(path, schema=STATION, header=False))
    return raw.select("station_id", F.try_to_date("date", "yyyyMMdd").alias("ts") if hasattr(F, "try_to_date") else F.to_date("date", "yyyyMMdd").alias("ts"), "element", "value", F.nullif(F.trim("qflag"), F.lit("")).alias("qflag"), "ordinal")


def element(station: DataFrame, name: str, scale: float) -> DataFrame:
    """One element's daily values in units, quality-flagged rows left out, the last row of a day."""
    good = station.filter((F.col("element") == name) & F.col("qflag").isNull())
    last = series.keep_last(good, ["station_id", "ts"], ["ordinal"])
    return last.select(F.col("station_id").alias("series_id"), "ts", (F.col("value") / scale).alias("value"))


def precipitation(station: DataFrame, months: tuple[int, ...] = tuple(range(6, 12)), least: float = 0.0) -> DataFrame:
    """Wet-season rain in mm from complete years, raised to ``least``."""
    days = series.drop_partial_year(element(station, "PRCP", 10.0)).filter(F.month("ts").isin(*months))
    return days.select("series_id", "ts", F.greatest("value", F.lit(float(least))).alias("value"))


def hot_dry(station: DataFrame, width: int = 30) -> DataFrame:
    return series.hot_dry(element(station, "TMAX", 10.0), element(station, "PRCP", 10.0), width=width)


def site_number(c: Column) -> Column:
    """Site number as text without a trailing .0; leading zeros stay."""
    return F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")


def read_discharge(spark: SparkSession, path: str) -> DataFrame:
    return _placed(spark.read.csv(path, schema=DISCHARGE, header=True))


def streamflow(rows: DataFrame, site: str | None = None) -> DataFrame:
    """Finite non-negative discharge by site from complete years."""
    named = rows.withColumn("series_id", site_number(F.col("site_no"))).withColumn("ts", F.col("date")).withColumn("value", F.col("discharge_cfs"))
    if site is not None:
        named = named.filter(F.col("series_id") == site)
    good = named.filter(~F.isnan("value") & (F.col("value") < float("inf")) & (F.col("value") >= 0))
    return series.drop_partial_year(series.keep_last(good, ["series_id", "ts"], ["ordinal"]).select("series_id", "ts", "value"))


def read_stream_json(spark: SparkSession, path: str) -> DataFrame:
    """Daily-values JSON: the first series of statistic 00003, else the first; its first block of values."""
    payload = spark.read.json(path, schema=_STREAM, multiLine=True).withColumn("file", F.input_file_name())

    def code(t: Column) -> Column:
        parts = F.split(t["name"], ":")
        named = F.when((F.size(parts) >= 4) & (F.element_at(parts, -1) != ""), F.element_at(parts, -1))
        listed = F.filter(t["variable"]["options"]["option"], lambda o: o["name"] == "Statistic")
        return F.coalesce(named, F.get(listed, F.lit(0))["optionCode"])

    mean = F.filter("value.timeSeries", lambda t: code(t) == "00003")
    chosen = F.when(F.size(mean) > 0, F.get(mean, F.lit(0))).otherwise(F.get("value.timeSeries", F.lit(0)))
    one = payload.select("file", chosen.alias("t"))
    records = one.select("file", F.coalesce("t.sourceInfo.siteName", F.lit("USGS streamgage")).alias("station_name"), F.posexplode(F.get("t.values", F.lit(0))["value"]).alias("ordinal", "r"))
    days = records.select("file", "station_name", "ordinal", F.substring("r.dateTime", 1, 10).try_cast("date").alias("ts"), F.col("r.value").try_cast("double").alias("value"))
    good = days.filter(F.col("ts").isNotNull() & ~F.isnan("value") & (F.col("value") >= 0) & (F.col("value") < float("inf")))
    return series.keep_last(good, ["file", "ts"], ["ordinal"]).select(F.col("station_name").alias("series_id"), "ts", "value")


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=CLAIMS, header=True)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    index = spark.read.csv(path, header=True)
    missing = {"year", "cpi_2025_base"} - set(index.columns)
    if missing:
        raise ValueError(f"CPI table lacks {sorted(missing)}")
    return index.select(F.col("year").cast("int").alias("year"), F.col("cpi_2025_base").cast("double").alias("cpi_2025_base"))


def claim_days(claims: DataFrame, index: DataFrame, state: str) -> tuple[DataFrame, DataFrame]:
    """Deflated daily payouts of a state: on the whole calendar, and positive days only."""
    amount = F.col("amountPaidOnBuildingClaim").try_cast("double")
    own = claims.filter(F.upper("state") == state.upper()).select(F.col("dateOfLoss").alias("ts"), amount.alias("value"))
    own = own.filter(F.col("ts").isNotNull() & ~F.isnan("value") & (F.col("value") >= 0) & (F.col("value") < float("inf")))
    real = series.deflated(own, index)
    filled = series.zero_filled(series.daily(real, F.lit(state.upper()), F.col("ts"), F.col("value")))
    return filled, filled.filter("value > 0")


def state_label(state: Column) -> Column:
    """Name of a state; others keep their code."""
    return F.when(state == "FL", "Florida").when(state == "TX", "Texas").otherwise(state)


def roles(display: DataFrame, evi: DataFrame, ei: DataFrame) -> DataFrame:
    """One long table of a series in its three roles."""
    parts = [df.select(F.lit(name).alias("role"), "series_id", "ts", "value") for name, df in (("display", display), ("evi", evi), ("ei", ei))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def shared_roles(days: DataFrame) -> DataFrame:
    """A series that serves all three roles."""
    return days.select(F.explode(F.array(*map(F.lit, ("display", "evi", "ei")))).alias("role"), "series_id", "ts", "value")


#: Applications in report order, with provider, whether they take part in the formal extremal-index work, and the unit of levels.
APPLICATIONS = (
    ("houston_hobby_precipitation", "ghcn", False, 1.0), ("phoenix_hot_dry_severity", "ghcn", False, 1.0),
    ("tx_streamflow", "usgs", True, 1e3), ("fl_streamflow", "usgs", True, 1e3), ("tx_nfip_claims", "fema", True, 1e6), ("fl_nfip_claims", "fema", True, 1e6),
)


def specifications(spark: SparkSession) -> DataFrame:
    """(application, provider, formal_ei, scale, place): what is known of each application, by key."""
    return spark.createDataFrame([(*a, i) for i, a in enumerate(APPLICATIONS)], "application string, provider string, formal_ei boolean, scale double, place int")


def application_inputs(spark: SparkSession, rain: DataFrame | None = None, heat: DataFrame | None = None, flows: dict[str, DataFrame] | None = None, claims: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """(role, series_id, ts, value) of all applications whose raw tables are given; claims alone have roles of their own.

    ``rain`` and ``heat`` are station rows, ``flows`` discharge rows by state, ``claims`` claim rows.
    """
    named = lambda days, key: days.select(F.lit(key).alias("series_id"), "ts", "value")
    parts = []
    if rain is not None:
        parts.append(shared_roles(named(precipitation(rain), "houston_hobby_precipitation")))
    if heat is not None:
        parts.append(shared_roles(named(hot_dry(heat), "phoenix_hot_dry_severity")))
    for state, rows in (flows or {}).items():
        parts.append(shared_roles(named(streamflow(rows), f"{state.lower()}_streamflow")))
    if claims is not None:
        for state in ("TX", "FL"):
            filled, positive = claim_days(claims, default_index(spark) if index is None else index, state)
            key = f"{state.lower()}_nfip_claims"
            parts.append(roles(named(filled, key), named(positive, key), named(filled, key)))
    if not parts:
        raise ValueError("No raw table is given.")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def registry(role_rows: DataFrame) -> DataFrame:
    return role_rows.groupBy("series_id", "role").agg(F.count("*").alias("n_obs"), F.min("ts").alias("start"), F.max("ts").alias("end"))


def write_inputs(role_rows: DataFrame, folder: str) -> DataFrame:
    """Write series by role and id, and their registry beside them; the registry."""
    role_rows.write.mode("overwrite").partitionBy("role", "series_id").parquet(f"{folder}/series")
    spark = role_rows.sparkSession
    registry(spark.read.parquet(f"{folder}/series")).write.mode("overwrite").parquet(f"{folder}/registry")
    return spark.read.parquet(f"{folder}/registry")


#: Price index by year from 1978 on, 2025 as 100.
FIRST_YEAR = 1978
PRICE_INDEX = (
    20.252, 22.550, 25.596, 28.237, 29.978, 30.941, 32.266, 33.414, 34.035, 35.277, 36.736, 38.514, 40.597, 42.305, 43.579, 44.883,
    46.026, 47.327, 48.723, 49.841, 50.618, 51.734, 53.470, 54.991, 55.860, 57.137, 58.657, 60.641, 62.594, 64.379, 66.853, 66.615,
    67.707, 69.837, 71.287, 72.342, 73.511, 73.598, 74.527, 76.114, 77.973, 79.387, 80.366, 84.142, 90.956, 94.700, 97.493, 100.000,
)
#: Candidate gauges by state; the second of Texas and the third of Florida are the frozen ones.
SITES = (
    ("TX", "08114000", "Brazos River at Richmond, TX", False), ("TX", "08066500", "Trinity River at Romayor, TX", True), ("TX", "08158000", "Colorado River at Austin, TX", False),
    ("FL", "02236000", "St. Johns River near Deland, FL", False), ("FL", "02320500", "Suwannee River at Branford, FL", False), ("FL", "02366500", "Choctawhatchee River near Bruce, FL", True),
)


def default_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(FIRST_YEAR + i, c) for i, c in enumerate(PRICE_INDEX)], INDEX)


def default_sites(spark: SparkSession) -> DataFrame:
    """(state_code, site_no, station_name, frozen)."""
    return spark.createDataFrame(list(SITES), "state_code string, site_no string, station_name string, frozen boolean")


def ensure_defaults(spark: SparkSession, folder: str) -> dict[str, str]:
    """Write the default tables that are not there yet; the paths of all."""
    from pyspark.errors import AnalysisException

    sites = default_sites(spark)
    tables = {"candidate_sites": sites.drop("frozen"), "frozen_sites": sites.filter("frozen").drop("frozen"), "price_index": default_index(spark)}
    paths = {name: f"{folder}/{name}" for name in tables}
    for name, rows in tables.items():
        try:
            spark.read.parquet(paths[name]).schema  # noqa: B018
        except AnalysisException:
            rows.coalesce(1).write.mode("overwrite").parquet(paths[name])
    return paths


def history(rows: DataFrame, date: str = "ts") -> DataFrame:
    """One row (n_rows, span_days) of a table of dated rows."""
    return rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.datediff(F.max(date), F.min(date)), F.lit(0)).alias("span_days"))


def station_valid(station: DataFrame, elements: list[str], rows: int = 365, days: int = 1825) -> bool:
    """Whether a station's cached rows are long enough and hold all elements."""
    missing = F.size(F.array_except(F.array(*map(F.lit, elements)), F.collect_set("element"))) if elements else F.lit(0)
    held = history(station).first()
    return held["n_rows"] >= rows and held["span_days"] >= days and station.agg(missing.alias("m")).first()["m"] == 0


def discharge_valid(discharge: DataFrame, rows: int = 5 * 365, days: int = 5 * 365) -> bool:
    """Whether a gauge's cached rows are long enough, in number and in span."""
    if "date" not in discharge.columns:
        return False
    held = history(discharge, "date").first()
    return held["n_rows"] >= rows and held["span_days"] >= days


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files of a cached table."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def claims_valid(claims: DataFrame, state: str, sample: int = 128) -> bool:
    """Whether the head of a cached file has the columns, is of one expected state and holds a finite amount (a check of the file, not a result)."""
    if not {"state", "dateOfLoss", "amountPaidOnBuildingClaim"} <= set(claims.columns):
        return False
    amount = F.col("amountPaidOnBuildingClaim").try_cast("double")
    finite = amount.isNotNull() & ~F.isnan(amount) & (F.abs(amount) < float("inf"))
    r = claims.limit(sample).agg(F.count_distinct(F.upper("state")), F.max(F.upper("state")), F.count_if(finite)).first()
    return r[0] == 1 and r[1] == state.upper() and r[2] > 0


def claims_need_refresh(spark: SparkSession, path: str, state: str, least_bytes: int = 32) -> bool:
    """Whether a cached claims file is missing, unreadable, too small or not what its name says."""
    from pyspark.errors import PySparkException

    try:
        if file_sizes(spark, path).agg(F.sum("length")).first()[0] < least_bytes:
            return True
        return not claims_valid(spark.read.csv(path, header=True), state)
    except (PySparkException, TypeError):
        return True


def write_series(rows: DataFrame, path: str) -> None:
    """Parquet by series; the output committer makes the write atomic."""
    rows.write.mode("overwrite").partitionBy("series_id").parquet(path)


def write_csv_gz(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def site_audit(sites: DataFrame, screened: DataFrame) -> DataFrame:
    """Shortlisted sites with their screening; numbers are padded to eight digits, longer ones stay."""
    pad = lambda c: F.when(F.length(site_number(F.col(c))) < 8, F.lpad(site_number(F.col(c)), 8, "0")).otherwise(site_number(F.col(c)))
    a, b = sites.withColumn("site_no", pad("site_no")), screened.withColumn("site_no", pad("site_no"))
    return a.join(b, ["state_code", "site_no"], "left")

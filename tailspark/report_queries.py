"""Registered queries of provider files, registries, summaries and report cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tailspark import contracts, series
from tailspark.functions.grid import grid_table
from tailspark.operators import curves, resample, score, screen, simulate
from tailspark.plans import application
from tailspark.plans.base import events, order_days, scratch, status_days, table
from tailspark.queries import _results, query, rounded
from tailspark.sources import fetch, providers

# -- provider files: written from the orders, then read as the providers' files are -----------


@query
def q_station_rain(spark, d):
    """Rain of the wet season from a station file with flagged and repeated rows."""
    days = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg((10 * F.count("*")).cast("int").alias("v"))
    first = days.select("day", "v", F.when(F.dayofyear("day") % 13 == 0, "G").alias("flag"), F.lit(0).alias("k"))
    rows = first.unionByName(days.filter(F.dayofmonth("day") == 5).select("day", F.col("v") + 1, F.lit(None).cast("string").alias("flag"), F.lit(1).alias("k")).toDF("day", "v", "flag", "k"))
    text = rows.coalesce(1).sortWithinPartitions("day", "k").select(F.lit("USW1"), F.date_format("day", "yyyyMMdd"), F.lit("PRCP"), "v", F.lit(None).cast("string").alias("m"), "flag", F.lit("S"), F.lit(None).cast("string").alias("o"))
    path = scratch(spark, "station")
    text.write.option("compression", "gzip").csv(path)
    return rounded(providers.precipitation(providers.read_station(spark, path)))


@query
def q_streamflow(spark, d):
    """Discharge by gauge from a file whose site numbers are text, some with a trailing .0."""
    site = F.when(F.col("o_orderstatus") == "F", "02236000").when(F.col("o_orderstatus") == "O", " 8066500.0").otherwise("123456789")
    rows = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date"), site.alias("site_no")).agg(F.max("o_totalprice").alias("q"))
    flow = F.when(F.dayofyear("date") % 17 == 0, -5.0).otherwise(F.col("q"))
    path = scratch(spark, "discharge")
    rows.select("date", flow.alias("discharge_cfs"), "site_no", F.lit("Gauge").alias("station_name")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("compression", "gzip").csv(path)
    return rounded(providers.streamflow(providers.read_discharge(spark, path)))


@query
def q_claims(spark, d):
    """Deflated daily payouts of one state from a claims file with unreadable amounts."""
    o = table(spark, d, "orders")
    amount = F.when(F.col("o_orderkey") % 29 == 0, "bad").otherwise(F.col("o_totalprice").cast("string"))
    path = scratch(spark, "claims")
    o.select(F.when(F.col("o_custkey") % 2 == 0, "tx").otherwise("FL").alias("state"), F.col("o_orderdate").cast("date").alias("dateOfLoss"), amount.alias("amountPaidOnBuildingClaim")).write.option("header", True).csv(path)
    filled, _ = providers.claim_days(providers.read_claims(spark, path), providers.default_index(spark), "tx")
    return rounded(filled, 4)


@query
def q_stream_json(spark, d):
    """A daily-values answer with two statistics, of which the mean is taken; bad and negative values go."""
    days = order_days(spark, d)
    cell = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("dateTime"), F.when(F.dayofmonth("ts") == 3, "").when(F.dayofmonth("ts") == 4, "-9").otherwise(F.round("value", 2).cast("string")).alias("value"))
    one = days.groupBy().agg(F.array_sort(F.collect_list(cell)).alias("v"))  # one day a row: some thousands
    made = lambda code, v: F.struct(F.lit(f"USGS:1:00060:{code}").alias("name"), F.struct(F.lit("River").alias("siteName")).alias("sourceInfo"), F.array(F.struct(v.alias("value"))).alias("values"))
    low = F.slice(F.col("v"), 1, 3)
    path = scratch(spark, "stream")
    one.select(F.to_json(F.struct(F.struct(F.array(made("00001", low), made("00003", F.col("v"))).alias("timeSeries")).alias("value")))).coalesce(1).write.text(path)
    return rounded(providers.read_stream_json(spark, path))


@query
def q_records(spark, d):
    """Records of service payloads, wherever they are kept."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("page"), F.struct("o_orderkey", "o_totalprice").alias("r"))
    pages = o.groupBy("page").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    key = F.element_at(F.array(*(F.lit(k) for k in ("results", "data", "elsewhere"))), (F.col("page") % 3 + 1).cast("int"))
    body = F.concat(F.lit('{"meta":{"n":1},"note":"[x","'), key, F.lit('":'), F.to_json("rows"), F.lit(',"zz":[]}'))
    each = pages.select("page", F.explode(fetch.records(body)).alias("r"))
    return rounded(each.groupBy("page").agg(F.count("*").alias("n"), F.sum(F.get_json_object("r", "$.o_totalprice").cast("double")).alias("total")), 4)


@query
def q_request_windows(spark, d):
    """Yearly request windows of two states over the span of the orders."""
    span = table(spark, d, "orders").agg(F.min("o_orderdate").cast("date").cast("string"), F.max("o_orderdate").cast("date").cast("string")).first()
    return fetch.year_windows(spark, ["tx", "FL"], span[0], span[1])


@query
def q_history(spark, d):
    """Length and span of the daily orders, by which cached files are judged."""
    return providers.history(order_days(spark, d))


@query
def q_default_tables(spark, d):
    """Default price index joined to the frozen gauges."""
    return rounded(providers.default_sites(spark).filter("frozen").crossJoin(F.broadcast(providers.default_index(spark).filter("year % 10 = 5"))).select("state_code", "site_no", "year", "cpi_2025_base"))


@query
def q_roles_registry(spark, d):
    days = series.zero_filled(order_days(spark, d))
    own = providers.roles(days, days.filter("value > 0"), days)
    shared = providers.shared_roles(status_days(spark, d))
    return providers.registry(own.unionByName(shared.select(*own.columns)))


@query
def q_application_order(spark, d):
    """Rows of the formal applications in report order."""
    spec = providers.specifications(spark)
    formal = [a[0] for a in providers.APPLICATIONS if a[2]]
    made = table(spark, d, "orders").groupBy((F.col("o_custkey") % 7).alias("place")).agg(F.count("*").alias("n")).join(spec, "place", "left")
    return application.reported(made.select("application", "provider", "n"), formal, "application")


# -- summaries and cells ----------------------------------------------------------------------


@query
def q_external_summary(spark, d):
    made = _results(spark, d).withColumns(
        {
            "ci_method": F.when(F.col("rep") % 3 == 0, "wald").otherwise("bootstrap"), "tuning_axis": F.lit("k"), "selected_k": (F.col("n_obs") % 50).cast("double"),
            "stable_k_lo": F.col("n_obs").cast("double") - 5, "stable_k_hi": F.when(F.col("rep") % 2 == 0, F.col("n_obs").cast("double")), "fixed_upper_level": F.lit(None).cast("double"),
        }
    )
    keep = ["scenario", "family", "xi_true", "method", "ci_method", "tuning_axis", "n_rep", "n_cover", "coverage", "mape", "relative_error_median", "interval_width_q75", "interval_score_mean", "selected_k", "stable_k_lo", "stable_k_hi", "fixed_upper_level"]
    return rounded(score.external_summary(made).select(*keep), 9)


@query
def q_ei_summary(spark, d):
    base = _results(spark, d)
    variant = F.when(F.col("family").startswith("p"), F.when(F.col("rep") % 2 == 0, "bootstrap_cov").otherwise("ols")).when(F.col("family").startswith("c"), "ols")
    made = base.withColumnRenamed("xi_hat", "theta_hat").withColumns(
        {
            "ci_method": F.lit("wald"), "selected_level": (F.col("n_obs") % 40).cast("double"), "stable_level_lo": F.lit(5.0), "stable_level_hi": F.col("n_obs").cast("double"), "selected_threshold_quantile": F.lit(0.95),
            "selected_run_k": F.lit(None).cast("double"), "block_scheme": F.lit("sliding"), "base_path": F.lit("bb"), "regression": F.lit("fgls"), "ci_variant": variant,
        }
    )
    keep = ["scenario", "family", "method", "n_rep", "coverage", "theta_hat_mean", "theta_hat_se", "bias", "mae", "selected_level", "stable_level_hi", "selected_run_k", "block_scheme", "base_path", "regression", "ci_variant"]
    return rounded(score.ei_summary(made).select(*keep), 9)


@query
def q_family_order(spark, d):
    """Families in display order with their labels; unknown ones come last and keep their names."""
    known = F.array(*(F.lit(f[0]) for f in score.FAMILIES))
    rows = table(spark, d, "events").groupBy((F.col("user_id") % 6).alias("k")).agg(F.count("*").alias("n"))
    named = rows.select(F.coalesce(F.get(known, F.col("k").cast("int")), F.concat(F.lit("family"), F.col("k").cast("string"))).alias("family"), "n")
    return score.in_order(named, "family", [f[0] for f in score.FAMILIES]).withColumn("label", score.family_label(F.col("family")))


@query
def q_display_cells(spark, d):
    """Report cells of numbers of all magnitudes."""
    u = table(spark, d, "events").groupBy("user_id").agg((F.avg("value") * F.pow(F.lit(10.0), F.col("user_id") % 9 - 5) * 1.2345678901).alias("x"), F.count("*").alias("n"))
    x = F.col("x")
    missing = F.when(F.col("user_id") % 10 != 0, x)
    return u.select(
        "user_id", score.compact(missing).alias("compact"), score.scaled(x, 10.0).alias("scaled"), score.plain_interval(x, x / 2, missing * 2).alias("interval"), score.window_text(F.col("n"), F.when(F.col("user_id") % 4 != 0, F.col("n") + 7)).alias("stable"),
        score.yes_no(F.when(F.col("user_id") % 5 != 0, F.when(F.col("user_id") % 2 == 0, "True").otherwise("no"))).alias("flag"), F.round(score.axis_limit(x, (0.5, 2.0, 20.0, 500.0)), 6).alias("axis"),
        providers.state_label(F.when(F.col("user_id") % 3 == 0, "TX").when(F.col("user_id") % 3 == 1, "FL").otherwise("LA")).alias("state"),
    )


@query
def q_frozen_sites(spark, d):
    from tailspark.queries import QUERIES

    return score.frozen(QUERIES["q_rank_candidates"](spark, d).drop("rank"))


@query
def q_percentile_interval(spark, d):
    e = table(spark, d, "events").select("user_id", "value")
    return rounded(resample.percentile_interval(e, ["user_id"], "value"))


@query
def q_kept_counts(spark, d):
    """What the positive-value filter leaves of series with gaps, and which are too short."""
    return contracts.kept_counts(events(spark, d, "user_id", gaps=True), 25)


@query
def q_aligned_curve(spark, d):
    e = events(spark, d)
    grid = grid_table(e)
    wanted = grid.filter("b % 2 = 0").select("series_id", "b")
    return rounded(curves.aligned(curves.curve(e, grid, False, "mean"), wanted))


@query
def q_scenarios(spark, d):
    """The persistence grid's autoregressive families with their construction parameter."""
    rows = simulate.default_ei(spark).filter("family NOT LIKE '%moving_maxima%'")
    return rounded(rows.select("benchmark_set", "family", "xi_true", "theta_true", "phi", "n_obs", "reps"), 9)


# -- fits without SQL: held against plain NumPy in the tests -----------------------------------


@query
def q_candidates(spark, d):
    """Screening of candidate gauges, one of which has no observations."""
    days = status_days(spark, d)
    sites = spark.createDataFrame([("TX", "F"), ("TX", "O"), ("FL", "P"), ("FL", "none")], "state_code string, site_no string")
    return screen.candidates(sites, days, reps=20, min_years=5)


@query
def q_application_ei(spark, d):
    return application.ei_fits(series.zero_filled(order_days(spark, d)), reps=20)


@query
def q_method_rows(spark, d):
    return application.method_rows(status_days(spark, d), reps=20)


@query
def q_selection_sensitivity(spark, d):
    days = status_days(spark, d)
    return application.selection_sensitivity(days, days, reps=20)

"""Series of the benchmark tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailspark import series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, key: str = "event_type", gaps: bool = False) -> DataFrame:
    """Event values by type or user in time order; with ``gaps`` every 97th event is missing."""
    df = table(spark, sf_dir, "events").select(F.col(key).alias("k"), "ts", "event_id", "value")
    value = F.when(F.col("event_id") % 97 != 0, F.col("value")) if gaps else F.col("value")
    return series.ordered(df, F.col("k"), ["ts", "event_id"], value)


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value by day, days without orders left out."""
    df = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    return series.daily(df, F.lit("orders"), F.col("o_orderdate"), F.col("o_totalprice"))


def status_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest order by status and day."""
    df = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderdate", "o_totalprice")
    return series.daily(df, F.col("o_orderstatus"), F.col("o_orderdate"), F.col("o_totalprice"), F.max)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared folder; where none is named, as in tests, below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"

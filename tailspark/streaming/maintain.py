"""Keeping daily series up to date from a stream of observations (an addition of this library).

Days close when the watermark passes them; closed days can be fitted in batches.  Sliding
windows, plateaus and resampling stay batch operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_maxima(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """(series_id, ts, value, total, n): each day's maximum, sum and count, once the day can no longer change."""
    days = stream.withWatermark("ts", late).groupBy("series_id", F.window("ts", "1 day").alias("day"))
    return days.agg(F.max("value").alias("value"), F.sum("value").alias("total"), F.count("*").alias("n")).select("series_id", F.col("day.start").cast("date").alias("ts"), "value", "total", "n")


def refit(days: DataFrame, path: str, checkpoint: str, fit: Callable[[DataFrame], DataFrame], out: str):
    """Append closed days to a table and write new fits of it after every batch.

    Each batch writes a folder of its own, so a repeated batch after a failure changes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        everything = batch.sparkSession.read.parquet(path)
        fit(everything).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return days.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(step)

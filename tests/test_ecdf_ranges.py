"""Ranges of the empirical distribution do not hang on the order in which partial results meet."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tailspark.operators import windows


def test_ranges_are_the_same_each_time_they_are_read(spark, monkeypatch):
    """Approximate quantiles may come out otherwise at the second reading; here they always do."""
    monkeypatch.setattr(windows, "CHUNK", 16)
    monkeypatch.setattr(windows, "RANGES", 8)
    others = F.udf(lambda _: sorted(random.SystemRandom().uniform(0, 500) for _ in range(7)), "array<double>")
    monkeypatch.setattr(F, "percentile_approx", lambda value, shares, accuracy: others(F.max(value)))
    x = np.random.default_rng(5).integers(0, 500, 2000).astype(float)
    series = spark.createDataFrame(pd.DataFrame({"series_id": "a", "pos": range(x.size), "value": x}))
    got = {r["value"]: r["f"] for r in windows.ecdf_values(series).collect()}
    assert got.keys() == set(x)
    assert max(abs(f - (x <= v).sum() / (x.size + 1)) for v, f in got.items()) < 1e-12

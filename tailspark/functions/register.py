"""Functions for SQL: call ``register(spark)`` once a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession) -> None:
    """hf8_quantile and kde_mode (grouped aggregates), and block_grid (a table function).

    Scalar formulas (winkler_score, wilson_lo, wilson_hi) are SQL functions and stay in the JVM.
    """
    from tailspark.operators.resample import mode_of

    @F.pandas_udf("double")
    def hf8_quantile(v: pd.Series, tau: pd.Series) -> float:
        v = v.dropna()
        return float(v.quantile(0.5)) if len(v) == 1 else float(__import__("numpy").quantile(v, tau.iloc[0], method="median_unbiased")) if len(v) else None

    @F.pandas_udf("double")
    def kde_mode(v: pd.Series) -> float:
        return mode_of(v.to_numpy(dtype=float))

    @F.udtf(returnType="b long")
    class BlockGrid:
        def eval(self, n: int):
            import numpy as np

            if n is None or n < 32:
                return
            lo = max(5, int(np.ceil(n**0.2)))
            hi = max(lo + 4, min(int(n**0.55), n // 15))
            for b in np.unique(np.rint(np.geomspace(lo, hi, min(32, max(10, hi - lo + 1)))).astype(int)):
                yield (int(b),)

    spark.udf.register("hf8_quantile", hf8_quantile)
    spark.udf.register("kde_mode", kde_mode)
    spark.udtf.register("block_grid", BlockGrid)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION winkler_score(t DOUBLE, lo DOUBLE, hi DOUBLE) RETURNS DOUBLE RETURN hi - lo + 40 * CASE WHEN t < lo THEN lo - t WHEN t > hi THEN t - hi ELSE 0 END")
    for name, sign in (("wilson_lo", "-"), ("wilson_hi", "+")):
        bound = "greatest({}, 0D)" if sign == "-" else "least({}, 1D)"
        body = bound.format(f"(x / n + 3.8416D / (2 * n) {sign} 1.96D * sqrt(x / n * (1 - x / n) / n + 3.8416D / (4 * n * n))) / (1 + 3.8416D / n)")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x DOUBLE, n DOUBLE) RETURNS DOUBLE RETURN {body}")

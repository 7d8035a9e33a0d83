"""Times the headline queries: python bench.py prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the threads.
Every query runs once to warm up and then three times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = (
    "q_calendar_fill", "q_disjoint_curve", "q_sliding_curve", "q_sliding_wide", "q_evi_ols", "q_design_life", "q_hill", "q_max_spectrum",
    "q_ei_paths", "q_ferro_segers", "q_kgaps", "q_evi_fgls", "q_benchmark_summary",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from tailspark.queries import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        own = []
        for k in range(runs + 1):
            began = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spark.catalog.clearCache()
            if k:
                own.append(time.time() - began)
        times[name] = round(statistics.median(own), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(folder).name}))
    spark.stop()


if __name__ == "__main__":
    main()

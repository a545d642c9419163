"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the number of cores. Each
query runs once to warm up and then BENCH_RUNS times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from skyledger.operators import marts, quality  # noqa: E402
from skyledger.operators.staging import staging_view  # noqa: E402
from skyledger.plans import monthly  # noqa: E402
from skyledger.session import configure  # noqa: E402
from skyledger.sources import tables  # noqa: E402
from verification import fixture  # noqa: E402
from verification.registry import QUERIES  # noqa: E402

HEADLINE = [
    "silver",
    *marts.MARTS,
    "flight_base",
    "kpi",
    "monthly_trend",
    "top_routes",
    "airport_card",
    "null_profile",
    "describe",
    "distinct_counts",
    "hist_distance",
    "delay_corr",
    "sample_pairs",
    "stored_sample_pairs",
    "clustered_scan",
    "dq_unique",
]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)

    silver = tables.work_folder(spark, "bench-silver")
    folder = tables.work_folder(spark, "bench-marts")
    tables.replace_months(fixture.silver(spark, sf_dir), silver, gather=True)

    def stored_silver() -> DataFrame:
        return staging_view(tables.read_silver(spark, silver))

    def six_direct() -> None:
        for name, build in marts.MARTS.items():
            tables.write_mart(build(stored_silver()), f"{folder}/direct/{name}")

    jobs = {name: (lambda n=name: run(QUERIES[n](spark, sf_dir))) for name in HEADLINE}
    # The same from the stored silver table, the way marts are built in use.
    for name, build in marts.MARTS.items():
        jobs[f"stored_{name}"] = lambda b=build: run(b(stored_silver()))
    jobs["six_marts_direct"] = six_direct
    jobs["six_marts_from_cells"] = lambda: monthly.rebuild_marts(spark, silver, f"{folder}/cells")
    jobs["six_marts_with_checks"] = lambda: monthly.rebuild_marts(
        spark, silver, f"{folder}/checked", quality.WriteChecks()
    )
    jobs["six_marts_from_base"] = lambda: monthly.refresh_marts(spark, silver, f"{folder}/base")

    times = {}
    for name, job in jobs.items():
        job()
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            job()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "flight_analytics_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(Path(sf_dir).name.removeprefix("sf") or 0),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()

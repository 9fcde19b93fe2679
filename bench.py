"""Headline queries at one scale: cold and warm seconds, as one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import registry  # noqa: E402
from tidemark.session import settings  # noqa: E402

HEADLINES = [
    "answer_requests",
    "adjusted_query",
    "compact_month",
    "rows_digest_tree",
    "range_scan",
    "first_n_rows",
    "coverage_frontier",
    "suspension_filter",
    "adjust_cumulative",
    "adjust_affine",
    "build_catalog",
    "block_stats",
    "gap_profile",
    "rows_digest",
    "exact_rows_diff",
    "round2",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        settings(SparkSession.builder.master(f"local[{cpus}]").appName("tidemark-bench"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    names = sys.argv[1:] or HEADLINES
    cold, warm = {}, {}
    spark.read.parquet(f"{folder}/events.parquet").groupBy("user_id").count().count()
    for name in names:
        for times in (cold, warm):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    bars = spark.read.parquet(f"{folder}/events.parquet").count()
    report = {
        "metric": "headline_queries_warm_seconds",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "events_per_second": {n: int(bars / t) for n, t in warm.items()},
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(report))


if __name__ == "__main__":
    main()

"""Headline timings: one JSON line.  BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set data, cores and repeats."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import catalog  # noqa: E402

HEADLINE = [
    "map_containment",
    "map_unified",
    "map_rowwise",
    "map_hybrid",
    "map_longguard",
    "map_weighted",
    "map_fastpath",
    "map_tagged",
    "candidates_weighted_orders",
    "map_containment_documents",
    "merge_duplicates",
    "tfidf_idf",
    "threshold_sweep",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("colweave-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Class loading and Python workers, on the smallest data.
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    catalog.QUERIES["map_tagged"](spark, small if os.path.isdir(small) else sf_dir).collect()
    seconds = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
    print(
        json.dumps(
            {
                "metric": "column_matching_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

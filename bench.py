"""Times of the headline queries, as one line of JSON.

Each query is run once to warm up and then timed to a full write to a sink that
keeps nothing.  ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the threads.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracelake.plans.catalog import QUERIES
from tracelake.sources.adapters import transcript_lines

HEADLINE = (
    "aggregate_by_tool", "aggregate_by_tool_status", "aggregate_top_errors", "search_runs", "run_filters_all", "inspect_context_window", "compare_cohorts",
    "errors_classified", "health_sessions", "health_project", "sequences_ngrams", "sequences_recovery", "read_scores", "content_search", "derive_runs_roundtrip",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            spark.catalog.clearCache()
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
    runs = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    lines, size = transcript_lines(spark, sf_dir).agg(F.count(F.lit(1)), F.sum(F.octet_length("value") + 1)).first()
    print(
        json.dumps(
            {
                "metric": "sum of warm headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "events": runs,
                "runs_per_sec_search": round(runs / took["search_runs"]), "lines_per_sec_derive": round(lines / took["derive_runs_roundtrip"]),
                "mib_per_sec_derive": round(size / 2**20 / took["derive_runs_roundtrip"], 2),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

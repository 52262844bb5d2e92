"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from tidemark.session import RECOMMENDED, prepare  # noqa: E402
from tidemark.workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "features_all",
    "user_features_all",
    "count_sliding",
    "distinct_sliding",
    "merge_partials",
    "decode_events",
    "event_outcomes",
    "dedup_retention",
    "history_append",
    "materialize_rows",
    "latest_alias",
    "read_point",
    "read_batch",
    "baseline_latency",
    "baseline_window",
    "parity_summary",
    "phase_summary",
    "availability_latency",
    "lag_quantiles",
    "registry_upsert",
)


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = prepare(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(map=RECOMMENDED)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    timings = {}
    for name in wanted:
        seconds(spark, name, sf_dir)  # warm-up
        timings[name] = round(min(seconds(spark, name, sf_dir) for _ in range(2)), 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Headline queries at one scale; prints one JSON line.

Each query is built and run to the end (a sink that drops the rows) once to
warm up and three times on the clock; its figure is the median.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from workload.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "feature_frame",
    "telemetry_weather_join",
    "rolling_features",
    "rolling_features_sliced",
    "latest_per_entity",
    "point_in_time_snapshot",
    "nearest_asof",
    "latest_year_join",
    "weather_json_flatten",
    "poi_within_radius",
    "infra_counts",
    "soft_labels",
    "effects",
    "grid_context",
    "consequence_score",
    "dispatch_queue",
    "global_rank",
    "kpis",
    "best_threshold",
    "classification_report",
    "upsert_replace",
    "upsert_partial",
]

RUNS = 3


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Small tables: keep all cores busy instead of merging partitions to 1 MB.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # Call sites of every column expression: costly to collect, not needed here.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        timed(spark, name, sf_dir)
        seconds[name] = round(
            statistics.median(timed(spark, name, sf_dir) for _ in range(RUNS)), 3
        )
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

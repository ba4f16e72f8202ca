"""Feature build on replicated corridors, plain, partitioned once, and sliced.

    python tools/scale.py [copies] [share of all rows moved to one corridor]

Copies the sf0.1 events under shifted corridor ids into a new temporary folder
and times the feature table in each form. A second figure puts a share of the
rows on one corridor, as a dominant key.
"""

import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import bench  # noqa: E402
from stromlage.plans.features import build_feature_table, engineer_features  # noqa: E402
from stromlage.session import tune  # noqa: E402
from stromlage.sources.writers import overwrite_table  # noqa: E402
from workload import bindings as b  # noqa: E402

SF_DIR = "/root/testdata/sf0.1"


def main() -> None:
    copies = int(sys.argv[1]) if len(sys.argv) > 1 else 50
    share = float(sys.argv[2]) if len(sys.argv) > 2 else 0.0
    spark = tune(bench.session("8"))
    folder = tempfile.mkdtemp(prefix="scale-")
    span = 1_000_000

    def copied(df, key):
        numbers = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")
        rows = df.select("*", numbers)
        return rows.withColumn(key, F.col(key) + F.col("copy") * span)

    def dominated(df):
        """The same rows, a share of the copies moved to corridor 0, a little apart in time."""
        moved = F.col("copy") < int(copies * share)
        apart = F.make_dt_interval(secs=(F.col("copy") * 0.001003).cast("decimal(18,6)"))
        return df.withColumn(
            "timestamp", F.when(moved, F.col("timestamp") + apart).otherwise(F.col("timestamp"))
        ).withColumn("corridor_id", F.when(moved, F.lit(0)).otherwise(F.col("corridor_id")))

    paths = {}
    for name, df, key in (
        ("telemetry", b.telemetry(spark, SF_DIR), "corridor_id"),
        ("weather", b.weather(spark, SF_DIR), "corridor_id"),
        ("corridors", b.corridors(spark, SF_DIR), "id"),
    ):
        rows = copied(df, key)
        if key == "corridor_id" and share:
            rows = dominated(rows)
        paths[name] = f"{folder}/{name}"
        rows.drop("copy").repartition(16).write.parquet(paths[name])
    overwrite_table(b.performance(spark, SF_DIR), f"{folder}/performance")

    t, w, c, p = (spark.read.parquet(f"{folder}/{n}")
                  for n in ("telemetry", "weather", "corridors", "performance"))
    print(f"{t.count()} rows, longest corridor "
          f"{t.groupBy('corridor_id').count().agg(F.max('count')).head()[0]}")

    def timed(name, run):
        start = time.perf_counter()
        run()
        print(f"{name}: {time.perf_counter() - start:.1f} s", flush=True)

    timed("three shuffles", lambda: overwrite_table(engineer_features(t, w, c, p), f"{folder}/f3"))
    timed("two shuffles", lambda: build_feature_table(t, w, c, p, f"{folder}/f2"))
    timed("long corridors sliced",
          lambda: build_feature_table(t, w, c, p, f"{folder}/fs", slices=64))
    sums = [
        spark.read.parquet(f"{folder}/{n}").agg(
            F.count("*"), F.round(F.sum("freq_volatility_6h"), 1), F.round(F.sum("volt_lag_2h"), 1)
        ).head()
        for n in ("f3", "f2", "fs")
    ]
    print("equal" if len(set(sums)) == 1 else f"DIFFERENT {sums}")
    spark.stop()


if __name__ == "__main__":
    main()

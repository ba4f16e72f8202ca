"""Latest and point-in-time rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from stromlage.operators import snapshots
from stromlage.sources.readers import calm_rows, rows_at
from tests.conftest import rows

SCHEMA = "corridor_id BIGINT, timestamp TIMESTAMP_NTZ, failure_event DOUBLE"
TARGETS = "corridor_id BIGINT, timestamp TIMESTAMP_NTZ, fallback STRING"


def test_latest(spark, at):
    df = spark.createDataFrame([(1, at(10, 1), 0.0), (1, at(10, 2), 0.1), (2, at(10, 1), 0.2)], SCHEMA)
    assert rows(snapshots.latest_per_entity(df)) == [(1, at(10, 2), 0.1), (2, at(10, 1), 0.2)]


def test_latest_cuts_rows_before_the_shuffle(spark, at):
    df = spark.createDataFrame([(1, at(10, 1), 0.0)], SCHEMA)
    plan = snapshots.latest_per_entity(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_nearest_on_a_tie_takes_the_earlier(spark, at):
    df = spark.createDataFrame([(1, at(10, 1, 4), 0.0), (1, at(10, 1, 8), 0.1), (2, at(10, 9), 0.2)],
                               SCHEMA)
    targets = spark.createDataFrame([(1, at(10, 1, 6), "nearest"), (2, at(10, 1), "nearest"),
                                     (3, at(10, 1), "nearest")], TARGETS)
    found = snapshots.nearest_asof(df, targets)
    assert rows(found) == [(1, at(10, 1, 4), 0.0), (2, at(10, 9), 0.2)]


def test_demo_snapshot_exact_nearest_calm(spark, at):
    df = spark.createDataFrame(
        [(1, at(10, 1), 1.0), (2, at(10, 2, 3), 0.9), (3, at(10, 1), 0.5), (3, at(10, 2), 0.4),
         (3, at(10, 3), 0.1), (4, at(10, 1), 0.9)], SCHEMA)
    targets = spark.createDataFrame(
        [(1, at(10, 1), "nearest"), (2, at(10, 2), "nearest"), (3, at(10, 9), "calm"),
         (4, at(10, 9), "calm")], TARGETS)
    assert rows(snapshots.demo_snapshot(df, targets)) == [
        (1, at(10, 1), 1.0), (2, at(10, 2, 3), 0.9), (3, at(10, 2), 0.4)]


def test_demo_snapshot_without_missing_targets(spark, at):
    df = spark.createDataFrame([(1, at(10, 1), 1.0), (1, at(10, 2), 0.0)], SCHEMA)
    targets = spark.createDataFrame([(1, at(10, 2), "calm")], TARGETS)
    assert rows(snapshots.demo_snapshot(df, targets)) == [(1, at(10, 2), 0.0)]


def test_builtin_targets(spark, at):
    found = snapshots.replay_targets(spark)
    assert found.count() == 8
    assert found.filter("corridor_id = 1").head().timestamp == at(12, 29, 14)


def test_trailing_includes_both_ends(spark, at):
    df = spark.createDataFrame([(1, at(10, 31), 0.0), (1, at(10, 1), 0.0), (1, at(9, 30, 23), 0.0)],
                               SCHEMA)
    assert snapshots.trailing(df).count() == 2


def test_trailing_filter_reaches_the_scan(spark, at, tmp_path):
    spark.createDataFrame([(1, at(10, 31), 0.0)], SCHEMA).write.parquet(str(tmp_path / "t"))
    df = snapshots.trailing(spark.read.schema(SCHEMA).parquet(str(tmp_path / "t")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp,ScalarSubquery" in plan


def test_point_reads(spark, at):
    df = spark.createDataFrame([(1, at(10, 1), 0.5), (1, at(10, 2), 0.4), (2, at(10, 1), 0.0)], SCHEMA)
    assert rows(rows_at(df, 1, "2025-10-02 00:00:00")) == [(1, at(10, 2), 0.4)]
    assert rows(calm_rows(df, 1)) == [(1, at(10, 2), 0.4)]


def test_one_entity_with_most_rows(spark):
    start = F.lit(dt.datetime(2025, 10, 1)).cast("timestamp_ntz")
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("corridor_id"),
        (start + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("timestamp"),
        F.lit(0.0).alias("failure_event"))
    found = snapshots.latest_per_entity(df)
    assert found.count() == 20_001
    assert found.filter("corridor_id = 0").head().timestamp == dt.datetime(2025, 10, 1, 8, 19, 57)


def test_one_scan_for_all_kinds_of_targets(spark, at, tmp_path):
    spark.createDataFrame([(1, at(10, 1), 0.0)], SCHEMA).write.parquet(str(tmp_path / "t"))
    df = spark.read.schema(SCHEMA).parquet(str(tmp_path / "t"))
    targets = spark.createDataFrame([(1, at(10, 2), "nearest")], TARGETS)
    plan = snapshots.demo_snapshot(df, targets)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_several_targets_of_a_corridor(spark, at):
    df = spark.createDataFrame([(1, at(10, d), 0.1 * d) for d in range(1, 8)] + [(1, at(11, 1), None)], SCHEMA)
    targets = spark.createDataFrame(
        [(1, at(10, 3), "calm"), (1, at(10, 2, 13), "nearest"), (1, at(12, 1), "nearest"), (1, at(10, 20), "calm"),
         (1, at(10, 20), "calm"), (2, at(10, 1), "nearest"), (1, at(10, 9), "other")], TARGETS)
    assert sorted(r.timestamp for r in snapshots.demo_snapshot(df, targets).collect()) == [
        at(10, 1), at(10, 3), at(10, 3), at(11, 1)]


def test_merge_same_as_comparing_with_every_row(spark, at):
    rnd = random.Random(5)
    start = at(10, 1)
    when = lambda: start + dt.timedelta(minutes=rnd.randrange(3000))
    # One corridor holds most rows; one has targets only, one rows only.
    data = {(c, when()) for c in [1] * 400 + [2, 2, 3, 5] for _ in range(1)}
    wanted = {(c, when()) for c in [1] * 150 + [2] * 20 + [3, 4]}
    df = spark.createDataFrame([(c, t, float(i)) for i, (c, t) in enumerate(sorted(data))], SCHEMA)
    targets = spark.createDataFrame([(c, t, "nearest") for c, t in [*wanted, *list(wanted)[:5]]] + [(None, start, "x"), (1, None, "x")], TARGETS)
    want = {}
    for c, t in wanted:
        near = sorted((abs(x - t), x) for k, x in data if k == c)
        if near:
            want[c, t] = near[0][1]
    for slices in (None, 1, 13, 60):
        found = snapshots.nearest_of_many(df, targets, slices)
        assert {(r.corridor_id, r.wanted): r.timestamp for r in found.collect()} == want
        assert found.count() == len(want) and found.columns == ["corridor_id", "wanted", "timestamp", "failure_event"]
    assert snapshots.nearest_of_many(df.limit(0), targets).count() == 0

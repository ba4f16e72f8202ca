"""Failure windows, labels and their effect."""

import datetime as dt

from pyspark.sql import functions as F

from stromlage.operators import events
from stromlage.session import settings

WINDOW = "event_seq INT, corridor_id BIGINT, event_ts TIMESTAMP_NTZ"


def labels(df):
    return {(r.corridor_id, r.hour.hour): r.soft_label for r in df.collect()}


def test_one_event(spark, at):
    found = labels(events.event_windows(spark.createDataFrame([(1, 1, at(12, 29, 14))], WINDOW)))
    assert found == {(1, 8): 0.20, (1, 9): 0.28, (1, 10): 0.38, (1, 11): 0.52, (1, 12): 0.68,
                     (1, 13): 0.82, (1, 14): 1.0}


def test_windows_ignore_the_session_zone(spark):
    """Hours around a clock change elsewhere are hours like all others."""
    event = spark.createDataFrame([(1, 1, dt.datetime(2025, 3, 30, 3, 20))], WINDOW)
    t = spark.createDataFrame([(1, dt.datetime(2025, 3, 30, 2, 40))],
                              "corridor_id BIGINT, timestamp TIMESTAMP_NTZ")
    with settings(spark, {"spark.sql.session.timeZone": "Europe/Berlin"}):
        windows = events.event_windows(event)
        assert labels(windows)[1, 2] == 0.82 and windows.count() == 7
        assert events.label_telemetry(t, windows).head().failure_event == 0.82


def test_collapse_beats_a_ramp_and_the_first_event_wins(spark, at):
    both = spark.createDataFrame([(1, 1, at(12, 29, 14)), (2, 1, at(12, 29, 16))], WINDOW)
    found = labels(events.event_windows(both))
    assert (found[1, 13], found[1, 14], found[1, 15], found[1, 16]) == (0.82, 1.0, 0.82, 1.0)
    turned = spark.createDataFrame([(2, 1, at(12, 29, 14)), (1, 1, at(12, 29, 16))], WINDOW)
    assert labels(events.event_windows(turned))[1, 13] == 0.52  # third hour before the first


def test_builtin_events_cover_56_hours(spark):
    windows = events.event_windows(events.builtin_events(spark))
    assert windows.count() == 56
    assert windows.filter("soft_label >= 0.5").count() == 32


def test_labels_event_then_ambient_then_none(spark, at):
    t = spark.createDataFrame(
        [(1, at(12, 29, 14)), (1, at(12, 29, 15)), (5, at(12, 29, 15)), (5, at(10, 22, 15)),
         (5, at(10, 22, 15, 40))], "corridor_id BIGINT, timestamp TIMESTAMP_NTZ")
    found = events.label_telemetry(t, events.event_windows(events.builtin_events(spark)))
    got = {(r.corridor_id, r.timestamp): r.failure_event for r in found.collect()}
    assert got == {(1, at(12, 29, 14)): 1.0, (1, at(12, 29, 15)): 0.0, (5, at(12, 29, 15)): 0.28,
                   (5, at(10, 22, 15)): 0.82, (5, at(10, 22, 15, 40)): 0.82}


def test_effects(spark, at):
    base = spark.createDataFrame(
        [(1, "A 330kV", at(12, 29, 14), 36.0, 85.0, 50.1),   # collapse
         (1, "A 330kV", at(12, 29, 13), 36.0, 85.0, 50.1),   # last ramp hour
         (5, "B 330kV", at(12, 1, 0), 20.0, 50.0, 50.0),     # ambient
         (2, "C 132kV", at(12, 1, 0), None, 90.0, 50.0)],    # nothing
        "corridor_id BIGINT, corridor_name STRING, timestamp TIMESTAMP_NTZ, temperature DOUBLE, "
        "humidity DOUBLE, base_frequency_hz DOUBLE")
    windows = events.event_windows(events.builtin_events(spark))
    found = {(r.corridor_id, r.timestamp.hour): (r.voltage_kv, r.frequency_hz, r.failure_event)
             for r in events.stressed_telemetry(base, windows).collect()}
    assert found[1, 14] == (231.0, 48.2, 1.0)
    assert found[1, 13] == (249.36, 49.6, 0.82)
    assert found[5, 0] == (318.45, 49.92, 0.28)
    assert found[2, 0] == (132.0, 50.0, 0.0)


def test_label_counts_and_balance(spark):
    df = spark.createDataFrame([(1.0,), (0.5,), (0.28,), (0.0,), (0.0,), (None,)],
                               "failure_event DOUBLE")
    assert tuple(events.label_counts(df).head()) == (1, 2)
    assert tuple(events.class_balance(df).head()) == (3, 2, 1.5)
    assert events.class_balance(df.filter("failure_event < 0.5")).head().ratio is None


def test_copies_of_one_event_are_one_window(spark, at):
    """A third of all events may be copies: they shrink to one row per hour."""
    ids = spark.range(3000).select(F.col("id").cast("int").alias("event_seq"))
    hot = ids.withColumn("corridor_id", F.when(F.col("event_seq") % 3 == 0, 0).otherwise(
        F.col("event_seq")).cast("bigint"))
    df = hot.withColumn("event_ts", F.lit(dt.datetime(2025, 10, 5, 12)).cast("timestamp_ntz"))
    assert events.event_windows(df).count() == 7 * 2001

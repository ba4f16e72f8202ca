"""Lags, rolling frames, and their sliced form."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stromlage import fixed_values as fv
from stromlage import schemas
from stromlage.operators import rolling
from stromlage.operators.rolling import roll, roll_sliced
from stromlage.plans import features
from tests.conftest import rows

HOUR = dt.datetime(2025, 10, 1)

GOLDEN = [
    (330.0, 50.0, 31.0), (331.0, 50.1, None), (329.0, 49.9, 33.0), (332.0, 50.2, 34.0),
    (328.0, 49.8, 35.0),
]


def tables(spark, corridors=((1, "Benin-Onitsha 330kV", "Benin"),), perf=(("Benin", 2023, 44.44),)):
    telemetry = spark.createDataFrame(
        [(c[0], HOUR + dt.timedelta(hours=h), v, f, 0.0)
         for c in corridors for h, (v, f, _) in enumerate(GOLDEN)],
        "corridor_id BIGINT, timestamp TIMESTAMP_NTZ, voltage_kv DOUBLE, frequency_hz DOUBLE, "
        "failure_event DOUBLE")
    weather = spark.createDataFrame(
        [(c[0], HOUR + dt.timedelta(hours=h), t, 60.0)
         for c in corridors for h, (_, _, t) in enumerate(GOLDEN)],
        "corridor_id BIGINT, timestamp TIMESTAMP_NTZ, temperature DOUBLE, humidity DOUBLE")
    dim = spark.createDataFrame(
        [(*c, 10) for c in corridors],
        "id BIGINT, name STRING, disco_name STRING, critical_infra_score INT")
    performance = spark.createDataFrame(
        list(perf), "short_name STRING, year INT, economic_loss_per_hr DOUBLE")
    return telemetry, weather, dim, performance


def test_golden_windows(spark):
    t, w, _, _ = tables(spark)
    joined = t.join(w, ["corridor_id", "timestamp"])
    found = roll(joined, "corridor_id", "timestamp", features.window_columns).orderBy("timestamp")
    names = ["volt_lag_1h", "volt_lag_2h", "volt_roll_avg_3h", "freq_lag_1h", "freq_lag_3h",
             "freq_roll_avg_6h", "freq_volatility_6h", "temp_roll_avg_3h"]
    got = [[None if v is None else round(v, 6) for v in r] for r in found.select(*names).collect()]
    assert got == [
        [None] * 8,
        [330, None, 330, 50.0, None, 50.0, None, 31],
        [331, 330, 330.5, 50.1, None, 50.05, 0.070711, 31],
        [329, 331, 330, 49.9, 50.0, 50.0, 0.1, 32],
        [332, 329, 330.666667, 50.2, 50.1, 50.05, 0.129099, 33.5],
    ]


def test_rows_with_unfilled_lags_are_dropped(spark):
    found = features.engineer_features(*tables(spark)).orderBy("timestamp").collect()
    assert [r.timestamp.hour for r in found] == [3, 4]
    assert found[0].economic_loss_per_hr == 44.44 and found[0].voltage_deviation == 332 - 313.5


def test_columns_follow_the_table_schema(spark):
    found = features.engineer_features(*tables(spark))
    assert found.columns == schemas.MODEL_FEATURES.fieldNames()
    assert features.feature_frame(found).columns == fv.FEATURES


def test_ties_in_the_latest_year_multiply_and_older_years_go(spark):
    t, w, c, p = tables(spark, perf=[("Benin", 2022, 1.0), ("Benin", 2023, 2.0),
                                     ("Benin", 2023, 3.0), ("Eko", 2024, 9.0), (None, 2025, 9.0)])
    joined = features.joined_telemetry(t, w, c, p)
    assert sorted({r.economic_loss_per_hr for r in joined.collect()}) == [2.0, 3.0]
    assert joined.count() == 2 * len(GOLDEN)


def test_corridor_without_performance_is_dropped(spark):
    corridors = ((1, "A 330kV", "Benin"), (2, "B 132kV", "Nowhere"))
    found = features.engineer_features(*tables(spark, corridors))
    assert {r.corridor_id for r in found.collect()} == {1}


def test_null_telemetry_drops_the_rows_that_look_back_on_it(spark):
    t, w, c, p = tables(spark)
    gap = t.withColumn("voltage_kv", F.when(F.hour("timestamp") != 1, F.col("voltage_kv")))
    assert [r.timestamp.hour for r in features.engineer_features(gap, w, c, p).collect()] == [4]


def series(spark, seed=7, n=3000):
    """Three corridors, one with most rows, gaps of all sizes, some NULL weather."""
    rnd = random.Random(seed)
    times, data = {1: HOUR, 2: HOUR, 3: HOUR}, []
    for _ in range(n):
        c = rnd.choice([1, 1, 1, 1, 2, 3])
        times[c] += dt.timedelta(minutes=rnd.choice([1, 60, 60, 600]))
        data.append((c, times[c], rnd.uniform(300, 340), rnd.uniform(49, 51),
                     rnd.choice([None, rnd.uniform(20, 40)])))
    return spark.createDataFrame(
        data, "corridor_id BIGINT, timestamp TIMESTAMP_NTZ, voltage_kv DOUBLE, "
        "frequency_hz DOUBLE, temperature DOUBLE")


@pytest.mark.parametrize("slices, n", [(2, 3000), (7, 3000), (40, 120)])
def test_sliced_windows_equal_plain_ones(spark, slices, n):
    df = series(spark, n=n)
    args = ("corridor_id", "timestamp", features.window_columns)
    plain = roll(df, *args)
    cut = roll_sliced(df, *args, features.WINDOW_INPUTS, features.REACH, slices=slices)
    assert rows(cut.select(*plain.columns)) == rows(plain)


@pytest.mark.parametrize("slices", [1, 5, 40])
def test_feature_table_does_not_depend_on_slicing(spark, slices, tmp_path):
    t = series(spark).drop("temperature").withColumn("failure_event", F.lit(0.0))
    w = series(spark).select("corridor_id", "timestamp", "temperature", F.lit(50.0).alias("humidity"))
    _, _, c, p = tables(spark, [(k, f"L{k} 132kV", "Benin") for k in (1, 2, 3)])
    expected = rows(features.engineer_features(t, w, c, p))
    built = features.build_feature_table(t, w, c, p, str(tmp_path / f"f{slices}"), slices)
    assert rows(built) == expected


def test_long_inputs_are_read_and_joined_once(spark):
    t, w, c, p = tables(spark)
    df = features.joined_telemetry(t, w, c, p)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "short_name" not in plan  # the dimension is a table: performance is not read again


def test_split(spark, at):
    df = spark.createDataFrame([(at(11, 30, 23),), (at(12, 1),)], "timestamp TIMESTAMP_NTZ")
    train, test = features.chronological_split(df)
    assert (train.count(), test.count()) == (1, 1)
    assert rows(train.union(test)) == rows(df)


def test_latest_rows_same_as_from_the_whole_table(spark):
    """Series of all lengths, with readings missing near the end."""
    rnd = random.Random(11)
    corridors = [(c, f"L{c} 132kV", "Benin", c) for c in range(60)]
    data = [(c, HOUR + dt.timedelta(hours=h + rnd.choice([0, 1, 2])),
             None if rnd.random() < 0.2 else rnd.uniform(100, 140), None if rnd.random() < 0.2 else rnd.uniform(49, 51), 0.0)
            for c in range(60) for h in range(0, 3 * (c % 12), 3)]
    t = spark.createDataFrame(data, "corridor_id BIGINT, timestamp TIMESTAMP_NTZ, voltage_kv DOUBLE, frequency_hz DOUBLE, failure_event DOUBLE")
    w = t.selectExpr("corridor_id", "timestamp", "voltage_kv / 4 AS temperature", "60.0D AS humidity")
    c = spark.createDataFrame(corridors, "id BIGINT, name STRING, disco_name STRING, critical_infra_score INT")
    p = spark.createDataFrame([("Benin", 2023, 44.44)], "short_name STRING, year INT, economic_loss_per_hr DOUBLE")
    whole = features.latest_per_entity(features.engineer_features(t, w, c, p))
    found = features.latest_features(t, w, c, p)

    def plain(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())

    assert plain(found) == plain(whole) and found.count() > 20
    assert features.latest_features(t.limit(0), w, c, p).count() == 0

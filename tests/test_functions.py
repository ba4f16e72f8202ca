"""Row expressions on worked-out values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stromlage.functions import bands, physics, risk, text
from tests.conftest import rows


def one(spark, value, kind, build):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x"))).head()[0]


@pytest.mark.parametrize("energy, technical, commercial, loss", [
    (7_000_000.0, 10.0, 25.0, 62.93), (4_000_000.0, 8.0, 20.0, 28.77), (0.0, 10.0, 25.0, 0.0)])
def test_economic_loss(spark, energy, technical, commercial, loss):
    df = spark.createDataFrame(
        [(energy, technical, commercial)],
        "energy_received_mwh DOUBLE, technical_losses_pct DOUBLE, commercial_losses_pct DOUBLE")
    assert risk.with_economic_loss(df).head().economic_loss_per_hr == loss


def test_infra_score(spark):
    df = spark.createDataFrame([(405, 476, 132)], "hospital_count INT, school_count INT, market_count INT")
    assert risk.with_infra_score(df).head().critical_infra_score == 3373


def test_score_to_risk(spark):
    df = spark.createDataFrame([(3.0,), (0.0,), (-2.0,)], "margin DOUBLE")
    found = risk.score_to_risk(df, 0.5).orderBy(F.desc("margin")).collect()
    assert [(r.failure_probability_pct, r.at_risk) for r in found] == [
        (95.26, 1), (50.0, 1), (11.92, 0)]


def test_at_risk_uses_the_unrounded_probability(spark):
    df = spark.createDataFrame([(0.499999,)], "probability DOUBLE")
    found = risk.probability_to_risk(df, 0.5).head()
    assert (found.failure_probability_pct, found.at_risk) == (50.0, 0)


def test_exposure_multiplier_score(spark):
    df = spark.createDataFrame(
        [("A", 95.25, 44.44, 3373.0), ("B", 40.0, 60.0, 0.0), ("C", 10.0, 100.0, 1686.5)],
        "name STRING, failure_probability_pct DOUBLE, economic_loss_per_hr DOUBLE, "
        "critical_infra_score DOUBLE")
    found = risk.with_risk_score(risk.with_infra_multiplier(risk.with_exposure(df)))
    assert [(r.name, round(r.risk_exposure_naira, 4), r.infra_multiplier, r.risk_score)
            for r in found.orderBy("name").collect()] == [
        ("A", 42.3291, 1.2, 50.79), ("B", 24.0, 1.0, 24.0), ("C", 10.0, 1.1, 11.0)]


def test_multiplier_is_one_when_all_scores_are_zero(spark):
    df = spark.createDataFrame([(0,), (0,)], "critical_infra_score INT")
    found = risk.with_infra_multiplier(df).collect()
    assert [r.infra_multiplier for r in found] == [1.0, 1.0]


@pytest.mark.parametrize("t, h, kv", [
    (36.0, 85.0, 304.095), (31.0, 50.0, 323.4), (30.0, 90.0, 330.0), (35.0, 81.0, 313.698),
    (None, 90.0, 330.0), (36.0, None, 313.5)])
def test_thermal_derating(spark, t, h, kv):
    df = spark.createDataFrame([(t, h, "X 330kV")],
                               "temperature DOUBLE, humidity DOUBLE, corridor_name STRING")
    found = physics.with_thermal_derating(physics.with_base_voltage(df)).head()
    assert found.derated_voltage_kv == pytest.approx(kv)


def test_frequency_offset_needs_heat_and_humidity(spark):
    df = spark.createDataFrame([(31.0, 81.0), (31.0, 80.0), (30.0, 90.0), (None, 90.0)],
                               "temperature DOUBLE, humidity DOUBLE")
    df = physics.with_freq_offset(df.withColumn("base_frequency_hz", F.lit(50.0)))
    assert [r.offset_frequency_hz for r in df.collect()] == [49.9, 50.0, 50.0, 50.0]


def test_voltage_deviation_takes_the_lower_class_without_a_name(spark):
    df = spark.createDataFrame([("A 330kV", 313.5), ("B 132kV", 125.4), (None, 130.4)],
                               "corridor_name STRING, voltage_kv DOUBLE")
    found = [round(r.voltage_deviation, 6) for r in physics.with_voltage_deviation(df).collect()]
    assert found == [0.0, 0.0, 5.0]


def test_calendar_is_iso(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 12, 29, 14),), (dt.datetime(2025, 12, 28, 0),)],
                               "timestamp TIMESTAMP_NTZ")
    assert [(r.hour_of_day, r.day_of_week) for r in physics.with_calendar(df).collect()] == [
        (14, 1), (0, 7)]


def test_sentinel_and_nan_become_null(spark):
    df = spark.createDataFrame([(-999.0,), (float("nan"),), (0.0,), (None,)], "x DOUBLE")
    assert [r.x for r in physics.clean_sentinel(df, ["x"]).collect()] == [None, None, 0.0, None]


@pytest.mark.parametrize("key, when", [
    ("2025100113", dt.datetime(2025, 10, 1, 13)), ("20251001xx", None), ("2025100125", None),
    ("2025023001", None), ("202510011", None), (None, None)])
def test_hour_key(spark, key, when):
    assert one(spark, key, "STRING", physics.parse_hour_key) == when


def test_hour_key_ignores_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:  # an hour that does not exist there
        assert one(spark, "2025033002", "STRING", physics.parse_hour_key) == dt.datetime(2025, 3, 30, 2)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("band, value, name", [
    (bands.risk_band, 60.0, "high"), (bands.risk_band, 59.99, "medium"),
    (bands.risk_band, 30.0, "medium"), (bands.risk_band, 29.99, "low"),
    (bands.freq_band, 49.5, "warn"), (bands.freq_band, 49.49, "alarm"),
    (bands.freq_band, 50.5, "warn"), (bands.freq_band, 50.51, "alarm"),
    (bands.freq_band, 50.2, "normal"), (bands.freq_band, None, "normal"),
    (bands.voltage_band, 118.8, "warn"), (bands.voltage_band, 118.7, "alarm"),
    (bands.voltage_band, 125.4, "normal"), (bands.voltage_band, None, "normal"),
    (bands.availability_band, 49.9, "alarm"), (bands.availability_band, 50.0, "warn"),
    (bands.availability_band, 70.0, "normal")])
def test_bands(spark, band, value, name):
    assert one(spark, value, "DOUBLE", band) == name


def test_infra_text(spark):
    df = spark.createDataFrame([(405, 0, 132), (0, 0, 0), (1, 2, 3)], "h INT, s INT, m INT")
    found = [r[0] for r in df.select(text.infra_text(F.col("h"), F.col("s"), F.col("m"))).collect()]
    assert found == ["Hospital (405), Market (132)", "Residential",
                     "Hospital (1), School (2), Market (3)"]


@pytest.mark.parametrize("build, value, shown", [
    (text.disco_label, "Benin", "Benin DisCo"), (text.disco_label, "Eko DisCo", "Eko DisCo"),
    (text.strip_class, "Ikeja-Ota 132kV", "Ikeja-Ota"),
    (text.short_name, "Kainji-Birnin Kebbi 330kV", "Kainji-Birnin Kebb"),
    (text.without_last_word, "Egbin-Lagos Island 132kV", "Egbin-Lagos Island"),
    (text.without_last_word, "Single", "Single")])
def test_names(spark, build, value, shown):
    assert one(spark, value, "STRING", build) == shown


def test_crew_names(spark):
    df = spark.createDataFrame([(1,), (8,), (9,)], "p BIGINT")
    assert [r[0] for r in df.select(text.crew_name(F.col("p"))).collect()] == [
        "Alpha", "Theta", "Crew 9"]


@pytest.mark.parametrize("change, invert, direction, shown", [
    (0.3, False, "better", "↑ +0.3Hz vs last hr"), (0.3, True, "worse", "↑ +0.3Hz vs last hr"),
    (-1.0, False, "worse", "↓ -1.0Hz vs last hr"), (0.0, True, "flat", "→ 0.0Hz vs last hr"),
    (None, False, None, "— vs last hour")])
def test_deltas(spark, change, invert, direction, shown):
    assert one(spark, change, "DOUBLE", lambda c: text.delta_direction(c, invert)) == direction
    assert one(spark, change, "DOUBLE", lambda c: text.delta_text(c, "Hz")) == shown


def test_values_with_unit(spark):
    assert one(spark, 50.123, "DOUBLE", lambda c: text.format_value(c, "Hz")) == "50.12 Hz"
    assert one(spark, 97.31, "DOUBLE", lambda c: text.format_value(c, "%", 1)) == "97.3 %"
    assert one(spark, None, "DOUBLE", lambda c: text.format_value(c, "Hz")) == "— unavailable"


@pytest.mark.parametrize("risk_pct, size", [(95.25, 19), (9.99, 10), (10.0, 11)])
def test_marker_size(spark, risk_pct, size):
    assert one(spark, risk_pct, "DOUBLE", text.marker_size) == size


def test_defaults_fill_only_what_is_there(spark):
    df = spark.createDataFrame([(None, None, 1)], "name STRING, lat DOUBLE, other INT")
    assert rows(text.fill_defaults(df)) == [("Unknown", 9.08, 1)]

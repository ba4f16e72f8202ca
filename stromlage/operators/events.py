"""Failure windows and their effect on telemetry."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stromlage import fixed_values as fv
from stromlage.functions.physics import (
    full_hour,
    with_base_voltage,
    with_freq_offset,
    with_thermal_derating,
)
from stromlage.operators.snapshots import first_row


def builtin_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        fv.FAILURE_EVENTS, "event_seq INT, corridor_id BIGINT, event_ts STRING"
    ).withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))


def builtin_ramp() -> list[tuple]:
    """Offset, voltage factor, frequency change, label; the collapse is offset 0."""
    return [*fv.RAMP, (0, fv.COLLAPSE_FACTOR, None, fv.COLLAPSE_LABEL)]


def builtin_ambient(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        fv.AMBIENT, "corridor_id BIGINT, volt_mult DOUBLE, freq_delta DOUBLE, soft_label DOUBLE"
    )


def _ramp_rows(ramp: list[tuple]) -> Column:
    """The ramp as an array constant, to be unfolded beside every event."""
    kinds = ("int", "double", "double", "double")
    names = ("offset", "volt_mult", "freq_delta", "soft_label")
    return F.array(
        *[
            F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(row, kinds, names)])
            for row in ramp
        ]
    )


def event_windows(events: DataFrame, ramp: list[tuple] | None = None) -> DataFrame:
    """Each event as seven labelled hours, one row per (corridor, hour).

    Where windows overlap, a collapse hour wins, then the event listed first.
    """
    unfolded = events.select(
        "corridor_id",
        "event_seq",
        full_hour(F.col("event_ts")).alias("_at"),
        F.inline(_ramp_rows(ramp or builtin_ramp())),
    )
    hours = unfolded.select(
        "corridor_id",
        F.timestamp_add("HOUR", F.col("offset"), F.col("_at")).alias("hour"),
        "event_seq", "offset", "volt_mult", "freq_delta", "soft_label",
    )
    not_collapse = F.col("offset") != 0
    return first_row(
        hours, ["corridor_id", "hour"], not_collapse, F.col("event_seq"), F.col("offset")
    )


def label_telemetry(
    telemetry: DataFrame, windows: DataFrame, ambient: DataFrame | None = None
) -> DataFrame:
    """Add the effect and soft label of an event hour, else of the corridor, else none."""
    if ambient is None:
        ambient = F.broadcast(builtin_ambient(telemetry.sparkSession))
    at_event = windows.select(
        "corridor_id",
        F.col("hour").alias("_hour"),
        F.col("offset").alias("event_offset"),
        F.col("volt_mult").alias("_ev"),
        F.col("freq_delta").alias("_ef"),
        F.col("soft_label").alias("_el"),
    )
    standing = ambient.select(
        "corridor_id",
        F.col("volt_mult").alias("_av"),
        F.col("freq_delta").alias("_af"),
        F.col("soft_label").alias("_al"),
    )
    joined = (
        telemetry.withColumn("_hour", full_hour(F.col("timestamp")))
        .join(at_event, ["corridor_id", "_hour"], "left")
        .join(standing, "corridor_id", "left")
    )
    in_event = F.col("_el").isNotNull()
    return joined.withColumns(
        {
            "volt_mult": F.when(in_event, F.col("_ev")).otherwise(
                F.coalesce(F.col("_av"), F.lit(1.0))),
            "freq_delta": F.when(in_event, F.col("_ef")).otherwise(
                F.coalesce(F.col("_af"), F.lit(0.0))),
            "failure_event": F.coalesce(F.col("_el"), F.col("_al"), F.lit(0.0)),
        }
    ).drop("_hour", "_ev", "_ef", "_el", "_av", "_af", "_al")


def apply_effects(df: DataFrame) -> DataFrame:
    """Voltage and frequency under the labelled effect, to two places.

    A collapse starts from the base voltage and sets the frequency; a ramp or a
    standing stress scales the derated voltage and shifts the frequency.
    """
    collapse = F.coalesce(F.col("event_offset") == 0, F.lit(False))
    return df.withColumns(
        {
            "voltage_kv": F.round(
                F.when(collapse, F.col("base_voltage_kv")).otherwise(F.col("derated_voltage_kv"))
                * F.col("volt_mult"), 2),
            "frequency_hz": F.round(
                F.when(collapse, F.lit(fv.COLLAPSE_HZ)).otherwise(
                    F.col("offset_frequency_hz") + F.col("freq_delta")), 2),
        }
    )


def stressed_telemetry(
    baseline: DataFrame, windows: DataFrame, ambient: DataFrame | None = None
) -> DataFrame:
    """Telemetry rows from weather and a measured frequency, all rules applied.

    ``baseline`` has corridor_id, corridor_name, timestamp, temperature,
    humidity and base_frequency_hz.
    """
    weathered = with_freq_offset(with_thermal_derating(with_base_voltage(baseline)))
    return apply_effects(label_telemetry(weathered, windows, ambient)).select(
        "corridor_id", "timestamp", "voltage_kv", "frequency_hz", "failure_event"
    )


def label_counts(df: DataFrame, label: str = "failure_event") -> DataFrame:
    y = F.col(label)
    return df.agg(
        F.count_if(y == 1.0).alias("hard"),
        F.count_if((y > 0.0) & (y < 1.0)).alias("soft"),
    )


def class_balance(df: DataFrame, label: str = "failure_event", cut: float = 0.5) -> DataFrame:
    y = F.col(label)
    counts = df.agg(
        F.count_if(y < cut).alias("normal"), F.count_if(y >= cut).alias("failures")
    )
    return counts.withColumn("ratio", F.try_divide("normal", "failures"))

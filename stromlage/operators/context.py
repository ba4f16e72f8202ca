"""Live grid context: snapshots, availability, deltas."""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stromlage import fixed_values as fv
from stromlage.operators.snapshots import latest_ts, snapshot_at, trailing
from stromlage.sources.parts import NO_DAY, PartedTable


def is_sagging(kv: Column) -> Column:
    """Below the floor of its class; the class is told from the voltage itself."""
    upper = (kv > fv.CLASS_SPLIT_KV) & (kv < fv.VOLTAGE_FLOOR_330)
    lower = (kv <= fv.CLASS_SPLIT_KV) & (kv < fv.VOLTAGE_FLOOR_132)
    return upper | lower


def _snapshot(prefix: str, chosen: Column) -> list[Column]:
    hz = F.when(chosen, F.col("frequency_hz"))
    kv = F.when(chosen, F.col("voltage_kv"))
    rows = F.count_if(chosen)
    sagging = F.when(rows > 0, F.count_if(is_sagging(kv)))
    return [
        F.round(F.avg(hz), 2).alias(f"{prefix}mean_hz"),
        F.round(F.min(kv), 2).alias(f"{prefix}lowest_kv"),
        sagging.alias(f"{prefix}at_risk"),
    ]


def _availability(chosen: Column) -> Column:
    """Percent of rows labelled exactly 0; unlabelled rows count as not available."""
    rows = F.count_if(chosen)
    up = F.count_if(chosen & (F.col("failure_event") == 0))
    return F.round(F.try_divide(up * F.lit(100.0), rows), 1)


def grid_snapshot(df: DataFrame, at: Column | None = None) -> DataFrame:
    """Mean frequency, lowest voltage and sag count at one instant, the latest by default.

    One row; all NULL when nothing was measured then.
    """
    rows = snapshot_at(df, latest_ts(df) if at is None else at)
    return rows.agg(*_snapshot("", F.lit(True)))


def availability(df: DataFrame, back: str = "30 DAY") -> DataFrame:
    return trailing(df, back).agg(_availability(F.lit(True)).alias("availability_pct"))


def availability_of_days(table: PartedTable, days: int = 30) -> DataFrame:
    """Availability and row count of the last ``days`` calendar days of a table cut by day.

    The latest day is the greatest folder name; no other folder than those of
    the days wanted is scanned.
    """
    days_held = [f for f in table.folders() if f != NO_DAY]
    first = dt.date.fromisoformat(days_held[-1]) - dt.timedelta(days - 1) if days_held else dt.date.max
    kept = table.parts([f for f in days_held if dt.date.fromisoformat(f) >= first])
    return kept.agg(_availability(F.lit(True)).alias("availability_pct"), F.count("*").alias("n_rows"))


def grid_context(df: DataFrame, back: str = "30 DAY", step: str = "1 HOUR") -> DataFrame:
    """Both snapshots, their deltas and availability in one row and one pass.

    ``step`` must not exceed ``back``. The one subquery gives the start of the
    trailing period, a bare value that is pushed into the Parquet scan; the
    other instants follow from it. What is left of the scan is aggregated
    conditionally: one shuffle of one row per task.
    """
    ts = F.col("timestamp")
    start = latest_ts(df, back)
    now = start + F.expr(f"INTERVAL {back}")
    before = now - F.expr(f"INTERVAL {step}")
    one = df.filter(ts >= start).agg(
        F.max(ts).alias("latest_ts"),
        *_snapshot("now_", ts == now),
        *_snapshot("prev_", ts == before),
        _availability(F.lit(True)).alias("plant_availability_pct"),
    )
    return one.select(
        "latest_ts",
        F.col("now_mean_hz").alias("avg_frequency_hz"),
        F.col("now_lowest_kv").alias("min_voltage_kv"),
        F.col("now_at_risk").alias("at_risk"),
        "plant_availability_pct",
        F.round(F.col("now_mean_hz") - F.col("prev_mean_hz"), 3).alias("delta_freq"),
        F.round(F.col("now_lowest_kv") - F.col("prev_lowest_kv"), 2).alias("delta_voltage"),
        (F.col("now_at_risk") - F.col("prev_at_risk")).alias("delta_at_risk"),
    )

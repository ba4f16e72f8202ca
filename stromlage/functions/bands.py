"""Bands of risk, frequency, voltage and availability."""

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH_RISK = 60
MEDIUM_RISK = 30


def risk_band(risk: Column) -> Column:
    return F.when(risk >= HIGH_RISK, "high").when(risk >= MEDIUM_RISK, "medium").otherwise("low")


def freq_band(hz: Column) -> Column:
    return (
        F.when((hz < 49.5) | (hz > 50.5), "alarm")
        .when((hz < 49.8) | (hz > 50.2), "warn")
        .otherwise("normal")
    )


def voltage_band(kv: Column) -> Column:
    return F.when(kv < 118.8, "alarm").when(kv < 125.4, "warn").otherwise("normal")


def availability_band(pct: Column) -> Column:
    return F.when(pct < 50, "alarm").when(pct < 70, "warn").otherwise("normal")

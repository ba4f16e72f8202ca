"""Electrical, thermal and calendar expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stromlage import fixed_values as fv


def is_330(name: Column) -> Column:
    """True for 330 kV corridors; a missing name counts as the lower class."""
    return F.coalesce(name.contains("330kV"), F.lit(False))


def with_freq_deviation(df: DataFrame, nominal: float = fv.NOMINAL_HZ) -> DataFrame:
    off = F.col("frequency_hz") - F.lit(nominal)
    return df.withColumns({"freq_deviation": off, "freq_deviation_abs": F.abs(off)})


def with_voltage_deviation(df: DataFrame, name: str = "corridor_name") -> DataFrame:
    floor = F.when(is_330(F.col(name)), fv.VOLTAGE_FLOOR_330).otherwise(fv.VOLTAGE_FLOOR_132)
    return df.withColumn("voltage_deviation", F.col("voltage_kv") - floor)


def with_calendar(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Hour 0-23 and ISO weekday, Monday = 1."""
    return df.withColumns(
        {"hour_of_day": F.hour(ts), "day_of_week": F.weekday(ts) + F.lit(1)}
    )


def clean_sentinel(
    df: DataFrame, cols: list[str], sentinel: float = fv.WEATHER_SENTINEL
) -> DataFrame:
    """Turn the missing-value flag, and NaN, into NULL."""
    return df.withColumns(
        {c: F.when(~F.isnan(c) & (F.col(c) != sentinel), F.col(c)) for c in cols}
    )


# Four digits of year, then month, day and hour within their ranges.
HOUR_KEY = "^[0-9]{4}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])([01][0-9]|2[0-3])$"


def parse_hour_key(key: Column) -> Column:
    """``YYYYMMDDHH`` as a zone-free timestamp; NULL when malformed.

    Built from its parts, so no session zone (and no daylight-saving gap) is
    ever involved. The pattern keeps all but days such as 30 February from
    being tried, since every failed try costs an exception.
    """
    part = [F.substring(key, at, width).try_cast("int") for at, width in
            ((1, 4), (5, 2), (7, 2), (9, 2))]
    return F.when(
        key.rlike(HOUR_KEY), F.try_make_timestamp_ntz(*part, F.lit(0), F.lit(0))
    )


def full_hour(ts: Column) -> Column:
    """The hour a zone-free timestamp lies in, without a detour through a zone."""
    past = F.make_dt_interval(F.lit(0), F.lit(0), F.minute(ts), F.extract(F.lit("SECOND"), ts))
    return ts - past


def base_voltage(name: Column) -> Column:
    return F.when(is_330(name), fv.BASE_KV_330).otherwise(fv.BASE_KV_132)


def with_base_voltage(df: DataFrame, name: str = "corridor_name") -> DataFrame:
    return df.withColumn("base_voltage_kv", base_voltage(F.col(name)))


def hot_and_humid() -> Column:
    return F.coalesce((F.col("humidity") > 80) & (F.col("temperature") > 30), F.lit(False))


def with_thermal_derating(df: DataFrame, base_col: str = "base_voltage_kv") -> DataFrame:
    """Heat, then humidity on top of heat, lower the voltage; NULL does not."""
    t = F.col("temperature")
    heat = F.when(t > 35, F.lit(0.95)).when(t > 30, F.lit(0.98)).otherwise(F.lit(1.0))
    damp = F.when(hot_and_humid(), F.lit(0.97)).otherwise(F.lit(1.0))
    return df.withColumn("derated_voltage_kv", F.col(base_col) * heat * damp)


def with_freq_offset(df: DataFrame, base_col: str = "base_frequency_hz") -> DataFrame:
    offset = F.when(hot_and_humid(), F.lit(-0.1)).otherwise(F.lit(0.0))
    return df.withColumn("offset_frequency_hz", F.col(base_col) + offset)

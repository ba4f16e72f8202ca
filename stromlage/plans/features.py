"""The model's feature table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from stromlage import fixed_values as fv
from stromlage import schemas
from stromlage.functions.physics import (
    with_calendar,
    with_freq_deviation,
    with_voltage_deviation,
)
from stromlage.operators.joins import join_latest, join_weather
from stromlage.operators.rolling import roll_sliced
from stromlage.operators.snapshots import latest_per_entity
from stromlage.session import stage
from stromlage.sources.readers import read_parquet
from stromlage.sources.writers import overwrite_table

WINDOW_INPUTS = ["voltage_kv", "frequency_hz", "temperature"]
REACH = 6
# Rows of a corridor up to the first one whose lags can be filled.
LEAST_ROWS = 4


def window_columns(w: WindowSpec) -> dict[str, Column]:
    """Lags and means over rows before the current one.

    The frames count rows, not hours: a gap in the series shortens nothing.
    """
    last3, last6 = w.rowsBetween(-3, -1), w.rowsBetween(-6, -1)
    return {
        "volt_lag_1h": F.lag("voltage_kv", 1).over(w),
        "volt_lag_2h": F.lag("voltage_kv", 2).over(w),
        "volt_roll_avg_3h": F.avg("voltage_kv").over(last3),
        "freq_lag_1h": F.lag("frequency_hz", 1).over(w),
        "freq_lag_3h": F.lag("frequency_hz", 3).over(w),
        "freq_roll_avg_6h": F.avg("frequency_hz").over(last6),
        "freq_volatility_6h": F.stddev_samp("frequency_hz").over(last6),
        "temp_roll_avg_3h": F.avg("temperature").over(last3),
    }


def joined_telemetry(
    telemetry: DataFrame,
    weather: DataFrame,
    corridors: DataFrame,
    performance: DataFrame,
) -> DataFrame:
    """Telemetry with weather, corridor and loss, and its row-wise features.

    Corridor and performance meet first, in a table of their own: its size is
    known, so the long table is not shuffled to meet it unless it is large.
    """
    dim = stage(join_latest(
        corridors.select(
            F.col("id").alias("corridor_id"),
            F.col("name").alias("corridor_name"),
            "disco_name",
            "critical_infra_score",
        ),
        performance,
    ), "dimension")
    measured = telemetry.select(
        "corridor_id", "timestamp", "voltage_kv", "frequency_hz", "failure_event"
    )
    rows = join_weather(measured, weather).join(dim, "corridor_id")
    return with_calendar(with_voltage_deviation(with_freq_deviation(rows)))


def engineer_features(
    telemetry: DataFrame,
    weather: DataFrame,
    corridors: DataFrame,
    performance: DataFrame,
    slices: int | None = None,
) -> DataFrame:
    """The feature table: rows whose lag windows are filled.

    Windows run over the joined rows, so a row the joins drop takes no part in
    them. All corridors are cut into slices of time, long and short ones alike.
    """
    joined = joined_telemetry(telemetry, weather, corridors, performance)
    rolled = roll_sliced(joined, "corridor_id", "timestamp", window_columns, WINDOW_INPUTS, REACH, slices)
    filled = rolled.filter(F.col("volt_lag_2h").isNotNull() & F.col("freq_lag_3h").isNotNull())
    return filled.select(*schemas.MODEL_FEATURES.fieldNames())


def latest_features(
    telemetry: DataFrame, weather: DataFrame, corridors: DataFrame, performance: DataFrame
) -> DataFrame:
    """The last row of each corridor in the feature table, without making that table.

    A window reaches ``REACH`` rows back, so the last rows of a corridor, cut in
    each task before they are shuffled, are all that its newest row needs. Only
    corridors whose newest row has an unfilled lag, and enough rows for an
    earlier one, are gone through in full.
    """
    joined = joined_telemetry(telemetry, weather, corridors, performance)
    back, along = (Window.partitionBy("corridor_id").orderBy(o) for o in (F.col("timestamp").desc(), F.col("timestamp")))
    tail = joined.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= REACH + 1)
    newest = stage(
        tail.withColumns(window_columns(along)).withColumn("_n", F.count("*").over(Window.partitionBy("corridor_id")))
        .filter(F.col("_back") == 1), "newest"
    )
    filled = F.col("volt_lag_2h").isNotNull() & F.col("freq_lag_3h").isNotNull()
    found = newest.filter(filled).select(*schemas.MODEL_FEATURES.fieldNames())
    # A first filled row has LEAST_ROWS - 1 rows before it, and the newest one is not it.
    unfilled = stage(newest.filter(~filled & (F.col("_n") > LEAST_ROWS)).select("corridor_id"), "unfilled")
    if unfilled.isEmpty():
        return found
    rest = engineer_features(telemetry.join(unfilled, "corridor_id", "left_semi"), weather, corridors, performance)
    return found.unionByName(latest_per_entity(rest))


def build_feature_table(
    telemetry: DataFrame,
    weather: DataFrame,
    corridors: DataFrame,
    performance: DataFrame,
    path: str,
    slices: int | None = None,
) -> DataFrame:
    """Drop and recreate the feature table at ``path``; returns it."""
    overwrite_table(engineer_features(telemetry, weather, corridors, performance, slices), path)
    return read_parquet(telemetry.sparkSession, path, schemas.MODEL_FEATURES)


def feature_frame(df: DataFrame) -> DataFrame:
    """The model's inputs, in the order of its vector."""
    return df.select(*fv.FEATURES)


def chronological_split(
    df: DataFrame, cutoff: str = fv.TEST_START, ts: str = "timestamp"
) -> tuple[DataFrame, DataFrame]:
    """Rows before the cutoff, and rows from it on."""
    at = F.lit(cutoff).cast("timestamp_ntz")
    return df.filter(F.col(ts) < at), df.filter(F.col(ts) >= at)

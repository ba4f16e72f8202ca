"""Joins of telemetry, dimensions, performance and queue.

Dimensions whose size follows the data carry no broadcast hint: Spark compares
their size with spark.sql.autoBroadcastJoinThreshold, and beyond it sort-merges
with skewed partitions split. Only tables of fixed values are hinted.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stromlage import fixed_values as fv
from stromlage.functions.text import crew_name, disco_label, fill_defaults, infra_text


def join_weather(telemetry: DataFrame, weather: DataFrame) -> DataFrame:
    """Telemetry and weather of the same corridor and instant.

    The composite key spreads even one dominant corridor over all partitions.
    """
    readings = weather.select("corridor_id", "timestamp", "temperature", "humidity")
    return telemetry.join(readings, ["corridor_id", "timestamp"])


def join_corridor(df: DataFrame, corridors: DataFrame) -> DataFrame:
    dim = corridors.select(
        F.col("id").alias("corridor_id"),
        F.col("name").alias("corridor_name"),
        "disco_name",
        "critical_infra_score",
    )
    return df.join(dim, "corridor_id")


def latest_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """All rows at the largest ``order`` of their key; ties stay.

    The maxima are aggregated before they are shuffled and joined back, so no
    key is gathered in one task, not even one whose latest rows are most of the
    table.
    """
    top = df.groupBy(key).agg(F.max(order).alias(order))
    return df.join(top, [key, order])


def join_latest(
    df: DataFrame,
    performance: DataFrame,
    key: str = "disco_name",
    order: str = "year",
    perf_key: str = "short_name",
) -> DataFrame:
    """Each row with its distributor's loss in that distributor's latest year.

    Rows without a match are dropped; several rows in the latest year multiply.
    """
    perf = performance.select(
        F.col(perf_key).alias(key), order, "economic_loss_per_hr"
    )
    latest = latest_rows(perf, key, order).select(key, "economic_loss_per_hr")
    return df.join(latest, key)


def corridor_metadata(corridors: DataFrame, performance: DataFrame) -> DataFrame:
    """What scoring adds to a corridor: distributor, infrastructure, hourly loss."""
    dim = corridors.select(
        F.col("id").alias("corridor_id"), "disco_name", "critical_infra_score"
    )
    return join_latest(dim, performance).select(
        "corridor_id", "disco_name", "critical_infra_score", "economic_loss_per_hr"
    )


def join_metadata(risk: DataFrame, metadata: DataFrame) -> DataFrame:
    return risk.join(metadata, "corridor_id")


def builtin_name_map(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(fv.NAME_MAP, "disco_name STRING, short_name STRING")


def map_names(df: DataFrame, map_df: DataFrame | None = None) -> DataFrame:
    """Add the short name; NULL for a name the map lacks."""
    names = F.broadcast(builtin_name_map(df)) if map_df is None else map_df
    return df.join(names.select("disco_name", "short_name"), "disco_name", "left")


def enrich_queue(queue: DataFrame, corridors: DataFrame) -> DataFrame:
    """Queue rows with the place and surroundings of the corridor of that name.

    Rows whose corridor is unknown stay, with defaults and as "Residential".
    Scores that are not numbered yet keep their corridor_id in place of the
    priority, and have no crew.
    """
    numbered = "priority" in queue.columns
    place_column = "priority" if numbered else "corridor_id"
    counts = ["hospital_count", "school_count", "market_count"]
    place = corridors.select(
        "name",
        "disco_name",
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        *counts,
    )
    rows = queue.select(
        place_column,
        F.col("corridor_name").alias("name"),
        F.col("failure_probability_pct").alias("risk"),
        F.col("economic_loss_per_hr").alias("loss"),
        "risk_score",
    )
    filled = fill_defaults(rows.join(place, "name", "left"))
    crew = [crew_name(F.col("priority")).alias("crew")] if numbered else []
    return filled.select(
        place_column,
        "name",
        "risk",
        "loss",
        "risk_score",
        infra_text(*[F.col(c) for c in counts]).alias("infra"),
        *crew,
        "lat",
        "lon",
        disco_label(F.col("disco_name")).alias("disco"),
    )

"""Loads of corridors, weather, telemetry and performance."""

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stromlage import fixed_values as fv
from stromlage import schemas
from stromlage.functions.risk import with_economic_loss
from stromlage.operators.events import stressed_telemetry
from stromlage.operators.geo import apply_infra_floors, infra_counts, payload_counts
from stromlage.operators.joins import map_names
from stromlage.operators.quality import null_figures, staged_with_figures, unmapped
from stromlage.operators.radius import surroundings
from stromlage.session import stage
from stromlage.sources.landed import read_poi_json, split_malformed, weather_rows
from stromlage.sources.parts import PartedTable
from stromlage.sources.tables import VersionedTable

logger = logging.getLogger(__name__)

KEY = ["corridor_id", "timestamp"]

CORRIDOR_COLUMNS = [
    "name", "disco_name", "latitude", "longitude",
    "hospital_count", "school_count", "market_count", "critical_infra_score",
]


def corridors_with_infra(
    corridors: DataFrame, poi: DataFrame, radius_m: float = fv.POI_RADIUS_M
) -> DataFrame:
    """Corridors with counted surroundings, floors and score.

    A column ``radius_m`` gives corridors a radius of their own; where it is
    NULL the usual one holds.
    """
    base = corridors.select("id", "name", "disco_name", "latitude", "longitude")
    if "radius_m" in corridors.columns:
        own = F.coalesce("radius_m", F.lit(float(radius_m)))
        counts = surroundings(corridors, poi, own).drop("nearest_m", "farthest_m")
    else:
        counts = infra_counts(base, poi, radius_m)
    return apply_infra_floors(base.join(counts.withColumnRenamed("corridor_id", "id"), "id"))


def corridors_from_payloads(corridors: DataFrame, payloads: DataFrame) -> DataFrame:
    """The same from one fetched payload per corridor, already cut to the radius.

    A corridor whose payload is missing or holds nothing that counts gets floors.
    """
    base = corridors.select("id", "name", "disco_name", "latitude", "longitude")
    counts = payload_counts(read_poi_json(payloads)).withColumnRenamed("corridor_id", "id")
    return apply_infra_floors(base.join(counts, "id", "left"))


def load_corridors(table: VersionedTable, corridors: DataFrame) -> int | None:
    """Replace by id; creation times stay, update times move."""
    table.ensure(schemas.CORRIDORS)
    return table.upsert(corridors, ["id"], CORRIDOR_COLUMNS, touch="updated_at")


def staged_hours(payloads: DataFrame) -> tuple[DataFrame, dict[str, object]]:
    """Hours of landed payloads, staged, with the figures of that write.

    ``n_rows``, ``null_timestamp`` (the malformed ones), and how many hours lack a reading.
    """
    figures = {"n_rows": F.count(F.lit(1)), **null_figures(["timestamp", "temperature", "humidity"])}
    return staged_with_figures(weather_rows(payloads), "hours", figures)


def load_weather(table: VersionedTable | PartedTable, payloads: DataFrame) -> int | list[str] | None:
    """Upsert the readable hours of landed payloads; malformed hours are reported.

    In a table cut by day an hourly load touches its day only.
    """
    hours, figures = staged_hours(payloads)
    if figures["null_timestamp"]:
        logger.warning("skipping %d malformed hours", figures["null_timestamp"])
    good, _ = split_malformed(hours)
    table.ensure(schemas.WEATHER)
    return table.upsert(good, KEY, ["temperature", "humidity"])


def load_telemetry(table: VersionedTable | PartedTable, telemetry: DataFrame) -> int | list[str] | None:
    table.ensure(schemas.TELEMETRY)
    return table.upsert(telemetry, KEY, ["voltage_kv", "frequency_hz", "failure_event"])


def stress_baseline(weather: DataFrame, corridors: DataFrame, frequency: DataFrame) -> DataFrame:
    """Weather rows with corridor name and measured frequency, as event rules take them."""
    names = corridors.selectExpr("id AS corridor_id", "name AS corridor_name", "disco_name")
    measured = frequency.selectExpr(*KEY, "frequency_hz AS base_frequency_hz")
    return weather.join(names, "corridor_id").join(measured, KEY)


def telemetry_under_events(
    weather: DataFrame, corridors: DataFrame, frequency: DataFrame, windows: DataFrame
) -> DataFrame:
    """Events are rare: staged, their hours are a table whose size Spark knows, and
    the telemetry is not shuffled to meet them unless they are many.
    """
    baseline = stress_baseline(weather, corridors, frequency)
    return stressed_telemetry(baseline, stage(windows, "windows"))


def performance_with_loss(raw: DataFrame, map_df: DataFrame | None = None) -> DataFrame:
    """Yearly performance with hourly loss and short name, in table order."""
    return map_names(with_economic_loss(raw), map_df).select(
        *schemas.PERFORMANCE.fieldNames()
    )


def report_unmapped(raw: DataFrame, map_df: DataFrame) -> DataFrame:
    """All names that the map lacks, with a warning that counts them."""
    names = stage(unmapped(raw, map_df), "unmapped")
    n = names.count()
    if n:
        logger.warning("%d names without a short name will not join", n)
    return names

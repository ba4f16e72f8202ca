"""Landed JSON payloads as rows.

Fetching is not done here: a payload is a row of text beside the corridor it
belongs to, so that any number of them is parsed by executors.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stromlage import schemas
from stromlage.functions.physics import clean_sentinel, parse_hour_key


def read_weather_json(df_json: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per hour key of the temperature map.

    Humidity is looked up by the same key and is NULL when it has none; hours
    known to the humidity map alone are dropped.
    """
    keep = [c for c in df_json.columns if c != payload]
    maps = df_json.withColumn(
        "_maps", F.from_json(payload, schemas.WEATHER_PAYLOAD)["properties"]["parameter"]
    )
    hours = maps.select(
        *keep,
        F.col("_maps.RH2M").alias("_humidity"),
        F.explode("_maps.T2M").alias("hour_key", "temperature"),
    )
    return hours.select(
        *keep,
        "hour_key",
        "temperature",
        F.try_element_at("_humidity", F.col("hour_key")).alias("humidity"),
    )


def weather_rows(df_json: DataFrame, payload: str = "payload") -> DataFrame:
    """Hour keys parsed and flags cleaned, malformed keys still in."""
    hours = read_weather_json(df_json, payload).withColumn(
        "timestamp", parse_hour_key(F.col("hour_key"))
    )
    return clean_sentinel(hours, ["temperature", "humidity"])


def split_malformed(df: DataFrame, ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """Rows whose time key could be read, and the others."""
    return df.filter(F.col(ts).isNotNull()), df.filter(F.col(ts).isNull())


def read_poi_json(df_json: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per element, absent tags as empty text."""
    keep = [c for c in df_json.columns if c != payload]
    elements = df_json.select(
        *keep,
        F.explode(F.from_json(payload, schemas.POI_PAYLOAD)["elements"]).alias("_element"),
    )
    return elements.select(
        *keep,
        *[
            F.coalesce(F.try_element_at("_element.tags", F.lit(tag)), F.lit("")).alias(tag)
            for tag in ("amenity", "shop", "landuse")
        ],
        F.col("_element.lat").alias("lat"),
        F.col("_element.lon").alias("lon"),
    )

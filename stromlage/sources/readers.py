"""Typed reads of tables and CSV exports."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stromlage import fixed_values as fv
from stromlage import schemas


# Down to microseconds: the default format would cut timestamps to milliseconds.
CSV_TIMESTAMP = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


class MissingInput(FileNotFoundError):
    """An input file or table does not exist."""


class EmptyInput(ValueError):
    """An input exists but holds no row."""


def path_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_parquet(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    except AnalysisException as error:
        if path_missing(error):
            raise MissingInput(path) from error
        raise


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        reader = spark.read.option("timestampNTZFormat", CSV_TIMESTAMP)
        return reader.csv(path, schema=schema, header=True, enforceSchema=True)
    except AnalysisException as error:
        if path_missing(error):
            raise MissingInput(path) from error
        raise


def read_corridors(spark: SparkSession, path: str) -> DataFrame:
    return read_parquet(spark, path, schemas.CORRIDORS)


def builtin_corridors(spark: SparkSession) -> DataFrame:
    """The eight known corridors, before their surroundings are counted."""
    return spark.createDataFrame(
        fv.CORRIDORS,
        "id BIGINT, name STRING, disco_name STRING, latitude DOUBLE, longitude DOUBLE",
    )


def read_performance(spark: SparkSession, path: str) -> DataFrame:
    return read_parquet(spark, path, schemas.PERFORMANCE_RAW)


def read_features_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.MODEL_FEATURES)


def read_scores_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.CONSEQUENCE_SCORES)


def read_queue_csv(spark: SparkSession, path: str) -> DataFrame:
    """The exported queue, under our column names again."""
    return read_csv(spark, path, schemas.DISPATCH_QUEUE)


def rows_at(df: DataFrame, corridor_id: int, timestamp: str) -> DataFrame:
    """Rows of one corridor at one instant, by named SQL parameters."""
    return df.sparkSession.sql(
        "SELECT * FROM {rows} WHERE corridor_id = :corridor "
        "AND timestamp = CAST(:at AS TIMESTAMP_NTZ)",
        args={"corridor": corridor_id, "at": timestamp},
        rows=df,
    )


def calm_rows(df: DataFrame, corridor_id: int, below: float = 0.5) -> DataFrame:
    """Rows of one corridor whose label is below a cut."""
    return df.filter(
        (F.col("corridor_id") == corridor_id) & (F.col("failure_event") < F.lit(below))
    )


def require_non_empty(df: DataFrame, name: str) -> DataFrame:
    if df.isEmpty():
        raise EmptyInput(f"{name} holds no rows")
    return df

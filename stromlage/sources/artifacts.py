"""Model and threshold artifacts."""

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from stromlage import fixed_values as fv
from stromlage import schemas
from stromlage.operators.boosting import NODES, BoostedModel
from stromlage.sources.readers import MissingInput, path_missing

logger = logging.getLogger(__name__)


def save_threshold(spark: SparkSession, value: float, path: str) -> None:
    row = spark.createDataFrame([(float(value),)], schemas.THRESHOLD)
    row.write.mode("overwrite").json(path)


def load_threshold(
    spark: SparkSession, path: str, default: float = fv.DEFAULT_THRESHOLD
) -> float:
    """The saved threshold; ``default`` without an artifact or without its key."""
    try:
        row = spark.read.schema(schemas.THRESHOLD).json(path, multiLine=True).head()
    except AnalysisException as error:
        if not path_missing(error):
            raise
        row = None
    if row is None or row.threshold is None:
        logger.warning("no threshold at %s, using %.2f", path, default)
        return default
    return row.threshold


def save_model(spark: SparkSession, model: BoostedModel, path: str) -> None:
    model.nodes(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, columns: list[str] = fv.FEATURES) -> BoostedModel:
    try:
        nodes = spark.read.schema(NODES).parquet(path)
    except AnalysisException as error:
        if path_missing(error):
            raise MissingInput(path) from error
        raise
    return BoostedModel.from_nodes(nodes, columns)

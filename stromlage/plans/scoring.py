"""From a feature table to the dispatch queue (M5, M6)."""

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stromlage import schemas
from stromlage.functions.risk import (
    probability_to_risk,
    with_exposure,
    with_infra_multiplier,
    with_risk_score,
)
from stromlage.operators.boosting import BoostedModel
from stromlage.operators.joins import corridor_metadata, join_metadata
from stromlage.operators.queue import dispatch_queue
from stromlage.operators.snapshots import demo_snapshot, latest_per_entity
from stromlage.plans.training import with_probability
from stromlage.session import stage
from stromlage.sources.artifacts import load_model, load_threshold
from stromlage.sources.readers import require_non_empty
from stromlage.sources.tables import VersionedTable
from stromlage.sources.writers import export_queue, write_csv

logger = logging.getLogger(__name__)

RISK_COLUMNS = ["corridor_name", "timestamp", "failure_probability_pct", "at_risk"]


def score(snapshot: DataFrame, model: BoostedModel, threshold: float) -> DataFrame:
    """Probability and flag of every snapshot row."""
    risk = probability_to_risk(with_probability(snapshot, model), threshold)
    return risk.select("corridor_id", *RISK_COLUMNS)


def consequence_scores(risk: DataFrame, metadata: DataFrame) -> DataFrame:
    """Risk rows with exposure, infrastructure multiplier and risk score.

    The multiplier is scaled by the largest score among the rows that joined.
    The join is staged: the maximum, the ranking and the export all read it.
    """
    joined = stage(join_metadata(risk, metadata), "scores")
    return with_risk_score(with_infra_multiplier(with_exposure(joined), scale=joined))


@dataclass(frozen=True)
class Paths:
    model: str
    threshold: str
    risk_scores: str
    consequence_csv: str | None = None
    queue_csv: str | None = None


def run(
    spark: SparkSession,
    features: DataFrame,
    corridors: DataFrame,
    performance: DataFrame,
    paths: Paths,
    targets: DataFrame | None = None,
) -> DataFrame:
    """Score the latest rows, or those at ``targets``, and rank what to visit first.

    Keeps the risk scores in their table and returns the queue, both exported
    as CSV where a path is given.
    """
    snapshot = latest_per_entity(features) if targets is None else demo_snapshot(features, targets)
    model = load_model(spark, paths.model)
    threshold = load_threshold(spark, paths.threshold)
    # Read by the upsert and the consequence scores.
    risk = stage(score(snapshot, model, threshold), "risk")
    require_non_empty(risk, "feature snapshot")
    table = VersionedTable(spark, paths.risk_scores).ensure(schemas.RISK_SCORES)
    table.upsert(risk, ["corridor_id"], RISK_COLUMNS, touch="scored_at")

    scores = consequence_scores(risk, corridor_metadata(corridors, performance))
    if scores.isEmpty():
        logger.error("no corridor has metadata: check distributor names")
    if paths.consequence_csv:
        ordered = [F.col("risk_score").desc_nulls_last(), F.col("corridor_id")]
        write_csv(scores.select(*schemas.CONSEQUENCE_SCORES.fieldNames()),
                  paths.consequence_csv, ordered)
    queue = dispatch_queue(scores)
    if paths.queue_csv:
        export_queue(queue, paths.queue_csv)
    return queue

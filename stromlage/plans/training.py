"""Training and evaluation on fractional labels (M1-M4)."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stromlage import fixed_values as fv
from stromlage.functions.risk import binarise
from stromlage.operators.boosting import BoostedModel, Growth, fit, quantile_cuts
from stromlage.operators.curve import best_threshold, classification_report, known_failures
from stromlage.operators.events import class_balance
from stromlage.plans.features import chronological_split
from stromlage.session import stage

@dataclass(frozen=True)
class Params:
    growth: Growth = Growth()
    # Rows labelled at least this count as failures in the class ratio and in reports.
    positive_at: float = 0.5
    # Weight of rows labelled at least ``weight_at``, certain failures; None: normal / failures.
    positive_weight: float | None = None
    weight_at: float = 1.0


def expand_soft_labels(
    df: DataFrame, positive_weight: float = 1.0, weight_at: float = 1.0, label: str = fv.TARGET
) -> DataFrame:
    """Each row as a positive of weight y and a negative of weight 1 - y.

    The weighted log loss of the pair is the loss of the fractional label: the
    form for learners that take whole labels only; ``train`` needs none of it. Halves of weight zero are dropped; unlabelled rows go.
    """
    y = F.col(label)
    factor = F.when(y >= weight_at, F.lit(float(positive_weight))).otherwise(F.lit(1.0))
    halves = F.array(
        F.struct(F.lit(1.0).alias("label"), (y * factor).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), ((F.lit(1.0) - y) * factor).alias("weight")),
    )
    return df.filter(y.isNotNull()).select("*", F.inline(halves)).filter("weight > 0")


def train(features: DataFrame, params: Params = Params(), cuts=quantile_cuts) -> BoostedModel:
    """Fit boosted trees on the fractional labels of ``features``, missing values as they are."""
    weight = params.positive_weight
    if weight is None:
        ratio = class_balance(features, cut=params.positive_at).head().ratio
        weight = 1.0 if ratio is None else ratio
    factor = F.when(F.col(fv.TARGET) >= params.weight_at, F.lit(float(weight))).otherwise(F.lit(1.0))
    return fit(features, fv.FEATURES, fv.TARGET, factor, params.growth, cuts)


def with_probability(df: DataFrame, model: BoostedModel) -> DataFrame:
    """The rows of ``df`` with the model's probability of failure."""
    return model.with_probability(df)


@dataclass(frozen=True)
class Trained:
    model: BoostedModel
    threshold: float


def train_and_tune(
    features: DataFrame, params: Params = Params(), cutoff: str = fv.TEST_START
) -> tuple[Trained, DataFrame]:
    """Model and threshold from the rows before ``cutoff``; and the rows after it.

    The threshold is the one of best F1 on the training rows themselves.
    """
    train_rows, test_rows = chronological_split(features, cutoff)
    train_rows = train_rows.filter(F.col(fv.TARGET).isNotNull())
    model = train(train_rows, params)
    # Staged: the threshold takes several passes, all trees one.
    scored = stage(with_probability(train_rows, model).select(
        F.col("probability").alias("score"),
        binarise(F.col(fv.TARGET), params.positive_at).alias("label"),
    ), "scored")
    best = best_threshold(scored).head()
    return Trained(model, best.threshold), test_rows


def evaluate(
    trained: Trained, test: DataFrame, positive_at: float = 0.5
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reports at 0.5 and at the tuned threshold, and scores of known failures.

    The scored test rows are staged once and read by all three.
    """
    scored = with_probability(test.filter(F.col(fv.TARGET).isNotNull()), trained.model)
    rows = stage(
        scored.select(
            "corridor_id", "corridor_name", "timestamp",
            F.col("probability").alias("score"),
            binarise(F.col(fv.TARGET), positive_at).alias("label"),
        ),
        "scored",
    )
    return (
        classification_report(rows, 0.5),
        classification_report(rows, trained.threshold),
        known_failures(rows),
    )

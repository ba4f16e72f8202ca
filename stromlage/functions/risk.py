"""Money, probability and score expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stromlage import fixed_values as fv


def with_economic_loss(df: DataFrame, tariff: float = fv.TARIFF) -> DataFrame:
    """Hourly loss in millions, from yearly energy and the two loss rates."""
    hourly_mwh = F.col("energy_received_mwh") / F.lit(float(fv.HOURS_PER_YEAR))
    rate = (F.col("technical_losses_pct") + F.col("commercial_losses_pct")) / F.lit(100.0)
    naira = hourly_mwh * F.lit(1000.0) * rate * F.lit(tariff)
    return df.withColumn("economic_loss_per_hr", F.round(naira / F.lit(1_000_000.0), 2))


def infra_score(weights: dict[str, int] | None = None) -> Column:
    weights = weights or fv.INFRA_WEIGHTS
    total = F.lit(0)
    for kind, points in weights.items():
        total = total + F.col(f"{kind}_count") * F.lit(points)
    return total


def with_infra_score(df: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    return df.withColumn("critical_infra_score", infra_score(weights))


def binarise(label: Column, cut: float = 0.5) -> Column:
    return (label >= F.lit(cut)).cast("int")


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def probability_to_risk(
    df: DataFrame, threshold: float, probability: str = "probability"
) -> DataFrame:
    """Percentage to two places; the flag uses the unrounded probability."""
    p = F.col(probability)
    return df.withColumns(
        {
            "failure_probability_pct": F.round(p * F.lit(100.0), 2),
            "at_risk": (p >= F.lit(threshold)).cast("int"),
        }
    )


def score_to_risk(df: DataFrame, threshold: float, margin: str = "margin") -> DataFrame:
    p = df.withColumn("probability", sigmoid(F.col(margin)))
    return probability_to_risk(p, threshold).drop("probability")


def with_exposure(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "risk_exposure_naira",
        F.col("failure_probability_pct") / F.lit(100.0) * F.col("economic_loss_per_hr"),
    )


def with_infra_multiplier(
    df: DataFrame, bonus: float = fv.INFRA_BONUS, scale: DataFrame | None = None
) -> DataFrame:
    """1 plus up to ``bonus``, in proportion to the largest score.

    The maximum is a scalar subquery, run once. ``scale`` is the frame to take
    it from when that is cheaper to read than ``df`` itself.
    """
    top = (scale if scale is not None else df).agg(
        F.max("critical_infra_score").alias("top")
    ).scalar()
    share = F.col("critical_infra_score") / top
    return df.withColumn(
        "infra_multiplier",
        F.when(top > 0, F.lit(1.0) + share * F.lit(bonus)).otherwise(F.lit(1.0)),
    )


def with_risk_score(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "risk_score", F.round(F.col("risk_exposure_naira") * F.col("infra_multiplier"), 2)
    )

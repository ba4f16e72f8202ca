"""Dispatch queue, its views and key figures."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stromlage import fixed_values as fv
from stromlage.functions.bands import HIGH_RISK, risk_band
from stromlage.functions.text import crew_name, marker_size, strip_class, without_last_word
from stromlage.operators.ordering import number_rows


def dispatch_queue(scores: DataFrame, slices: int | None = None) -> DataFrame:
    """Priority 1..N by descending risk score, ties by corridor."""
    order = [F.col("risk_score").desc_nulls_last(), F.col("corridor_id").asc()]
    ranked = number_rows(
        scores.select("corridor_id", *[ours for ours, _ in fv.QUEUE_COLUMNS[1:]]),
        order, "priority", slices,
    )
    return ranked.drop("corridor_id")


def filter_risk(df: DataFrame, threshold: float, disco: str | None = None) -> DataFrame:
    """Rows at or above a risk, of one distributor or (None) of all."""
    rows = df.filter(F.col("risk") >= F.lit(threshold))
    return rows if disco is None else rows.filter(F.col("disco") == F.lit(disco))


def _early(df: DataFrame) -> Column:
    """Greater for rows earlier in the queue, which need not be numbered for it."""
    if "priority" in df.columns:
        return F.struct((-F.col("priority")).alias("order"))
    return F.struct("risk_score", (-F.col("corridor_id")).alias("order"))


def kpis(
    queue: DataFrame, threshold: float = 0.0, disco: str | None = None, crews: int = 3
) -> DataFrame:
    """The status cards in one pass: rows at high risk, their loss, crews, top risk.

    The name of the top row is shown without its voltage class.
    """
    chosen = F.col("risk") >= F.lit(threshold)
    if disco is not None:
        chosen = chosen & (F.col("disco") == F.lit(disco))
    high = chosen & (F.col("risk") >= HIGH_RISK)
    top = F.max(F.when(chosen, F.struct("risk", _early(queue).alias("order"), "name")))
    one = queue.agg(
        F.count_if(high).alias("at_risk"),
        F.coalesce(F.sum(F.when(high, F.col("loss"))), F.lit(0.0)).alias("est_loss"),
        F.count("*").alias("total_monitored"),
        top.alias("_top"),
    )
    needed = F.least(F.col("at_risk"), F.lit(crews).cast("long"))
    return one.select(
        "at_risk",
        "est_loss",
        needed.alias("crews_needed"),
        (needed - F.lit(crews)).alias("delta_crew"),
        "total_monitored",
        F.coalesce("_top.risk", F.lit(0.0)).alias("highest_risk"),
        F.coalesce(strip_class(F.col("_top.name")), F.lit("N/A")).alias("highest_name"),
    )


def highest(queue: DataFrame) -> DataFrame:
    """The riskiest row, the first in the queue on ties; (0, 'N/A') when empty."""
    one = queue.agg(
        F.max(F.struct("risk", _early(queue).alias("order"), "name")).alias("_top")
    )
    return one.select(
        F.coalesce("_top.risk", F.lit(0.0)).alias("risk"),
        F.coalesce("_top.name", F.lit("N/A")).alias("name"),
    )


def top_risk(queue: DataFrame, n: int = 6) -> DataFrame:
    """The ``n`` riskiest rows, ties in queue order, as chart bars."""
    top = queue.orderBy(F.col("risk").desc(), F.col("priority")).limit(n)
    return top.select(
        "priority",
        without_last_word(F.col("name")).alias("name"),
        "risk",
        risk_band(F.col("risk")).alias("band"),
    )


def map_markers(queue: DataFrame) -> DataFrame:
    return queue.select(
        "name", "lat", "lon", "risk", "loss",
        risk_band(F.col("risk")).alias("band"),
        marker_size(F.col("risk")).alias("radius"),
    )


def dispatch_view(queue: DataFrame, crews: int = 3, n: int = 5) -> DataFrame:
    """First ``n`` rows of the queue with the crew each gets.

    Positions are numbered after the limit, on at most ``n`` rows.
    """
    first = queue.orderBy("priority").limit(n)
    position = F.row_number().over(Window.orderBy("priority"))
    numbered = first.withColumn("position", position)
    crew = F.when(F.col("position") <= crews, crew_name(F.col("position"))).otherwise("—")
    return numbered.select(
        "position",
        F.least("position", F.lit(3)).alias("row_class"),
        risk_band(F.col("risk")).alias("badge"),
        "name", "risk", "loss", "infra",
        crew.alias("crew"),
    )


def top_losses(performance: DataFrame, n: int = 5) -> DataFrame:
    """Largest hourly losses in the latest year of the whole table."""
    latest = performance.agg(F.max("year").alias("year")).scalar()
    return (
        performance.filter(F.col("year") == latest)
        .select("disco_name", "year", "economic_loss_per_hr")
        .orderBy(F.col("economic_loss_per_hr").desc_nulls_last(), "disco_name")
        .limit(n)
    )


def ranked(df: DataFrame, by: str, key: str = "corridor_id") -> DataFrame:
    """All rows, largest first, as a range sort."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(key))


def top_summary(df: DataFrame, by: str = "risk_score", key: str = "corridor_id") -> DataFrame:
    return ranked(df, by, key).limit(1)


def flagged_total(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum("at_risk"), F.lit(0)).alias("flagged"))


def pick(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Select and rename in one projection: new name -> column."""
    cols: list[Column] = [F.col(f"`{old}`").alias(new) for new, old in names.items()]
    return df.select(*cols)

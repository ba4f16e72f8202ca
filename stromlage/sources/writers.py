"""Full-refresh tables and ordered CSV exports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stromlage import fixed_values as fv
from stromlage.sources.readers import CSV_TIMESTAMP


def overwrite_table(df: DataFrame, path: str) -> None:
    """Drop and recreate. ``df`` must not read ``path``."""
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, order: list | None = None) -> None:
    """Header and rows; with ``order``, part files follow each other in it.

    The sort is a range sort: each executor writes its own range, and no row
    passes through one task that gathers them all.
    """
    rows = df.orderBy(*order) if order else df
    rows.write.mode("overwrite").option("timestampNTZFormat", CSV_TIMESTAMP).csv(
        path, header=True
    )


def export_features(df: DataFrame, path: str) -> None:
    write_csv(df, path, ["corridor_id", "timestamp"])


def export_queue(queue: DataFrame, path: str) -> None:
    """The queue under its display names, in priority order."""
    shown = queue.orderBy("priority").select(
        *[F.col(ours).alias(shown) for ours, shown in fv.QUEUE_COLUMNS]
    )
    write_csv(shown, path)

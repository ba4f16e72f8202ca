"""Global order without a global window.

A window without PARTITION BY moves every row to one task. Here the rows are
range-partitioned, numbered (or summed) inside their slice, and shifted by what
lies in the slices before. Only that table of slices, one row each, is ever
brought together.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stromlage.session import stage

# monotonically_increasing_id() keeps the row's place in its partition in these bits.
_PLACE_BITS = 33


def range_slices(df: DataFrame, order: Sequence[Column], slices: int | None = None) -> DataFrame:
    """Range partitions over ``order``; without ``slices`` their number follows the data.

    Left open, it is at most spark.sql.shuffle.partitions, and adaptive
    execution merges neighbouring ranges that are small.
    """
    return df.repartitionByRange(slices, *order) if slices else df.repartitionByRange(*order)


def ordered_slices(df: DataFrame, order: Sequence[Column], slices: int | None = None) -> DataFrame:
    """``df`` in range slices, with ``_slice`` and the 0-based ``_place`` in it.

    ``order`` should end in a unique key, so that ties (even a third of all
    rows on one value) are split over slices as well. The result is staged:
    range bounds come from a sample, and two passes must see the same ones.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return stage(
        range_slices(df, order, slices)
        .sortWithinPartitions(*order)
        .withColumns({"_slice": F.spark_partition_id(), "_place": place}),
        "slices",
    )


def _before(totals: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per slice, the sum of ``cols`` over all slices before it, and over all.

    The unpartitioned window sees one row per slice: as many rows as there are
    shuffle partitions, whatever the size of the data.
    """
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return totals.select(
        "_slice",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in cols],
        *[F.sum(c).over(whole).alias(f"_whole_{c}") for c in cols],
    )


def number_rows(
    df: DataFrame, order: Sequence[Column], name: str, slices: int | None = None
) -> DataFrame:
    """Number all rows 1..N in ``order``, in a first column ``name``."""
    rows = ordered_slices(df, order, slices)
    totals = rows.groupBy("_slice").agg(F.count("*").alias("n"))
    numbered = rows.join(F.broadcast(_before(totals, ["n"])), "_slice")
    number = F.col("_before_n") + F.col("_place") + F.lit(1)
    return numbered.select(number.alias(name), *[F.col(f"`{c}`") for c in df.columns])


def running_sums(
    df: DataFrame, order: Sequence[Column], sums: dict[str, str], slices: int | None = None
) -> DataFrame:
    """Add running sums (column -> name of its sum) over ``order``, which is unique.

    Each comes with its grand total, under the name plus ``_total``.
    """
    rows = ordered_slices(df, order, slices)
    totals = rows.groupBy("_slice").agg(*[F.sum(c).alias(c) for c in sums])
    shifted = rows.join(F.broadcast(_before(totals, list(sums))), "_slice")
    within = (
        Window.partitionBy("_slice").orderBy("_place")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return shifted.select(
        *df.columns,
        *[
            (F.sum(c).over(within) + F.col(f"_before_{c}")).alias(name)
            for c, name in sums.items()
        ],
        *[F.col(f"_whole_{c}").alias(f"{name}_total") for c, name in sums.items()],
    )

"""Windows over an entity's rows in time, also when one entity is most of the data.

A window partitioned by entity puts all rows of an entity into one task. Here
all rows are cut into range slices of (entity, time) instead; a window of limited
reach then only needs, besides its slice, the last few rows before it (the
halo). The result is the same, row for row, whatever the gaps in the series.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from stromlage.operators.ordering import range_slices
from stromlage.session import stage

Columns = Callable[[WindowSpec], dict[str, Column]]


def roll(df: DataFrame, entity: str, ts: str, columns: Columns) -> DataFrame:
    """The plain form, one task for each entity; for entities known to be short."""
    return df.withColumns(columns(Window.partitionBy(entity).orderBy(ts)))


def roll_sliced(
    df: DataFrame,
    entity: str,
    ts: str,
    columns: Columns,
    inputs: list[str],
    reach: int,
    slices: int | None = None,
) -> DataFrame:
    """As ``roll``, over range slices of (entity, ts).

    ``inputs`` are the columns the windows read, ``reach`` how many rows back.
    """
    rows = stage(
        range_slices(df, [F.col(entity), F.col(ts)], slices).withColumn(
            "_slice", F.spark_partition_id()
        ),
        "rolling",
    )
    # The last rows of every (entity, slice): one file holds one slice, so each
    # task drops all but `reach` rows per entity before anything is shuffled.
    backwards = Window.partitionBy(entity, "_slice").orderBy(F.col(ts).desc())
    tails = (
        rows.select(entity, "_slice", ts, *inputs)
        .withColumn("_back", F.row_number().over(backwards))
        .filter(F.col("_back") <= reach)
        .groupBy(entity, "_slice")
        .agg(F.sort_array(F.collect_list(F.struct(ts, *inputs))).alias("_tail"))
    )
    # An entity lies in consecutive slices; the `reach` slices before each one
    # hold at least `reach` rows, or all there are.
    earlier = Window.partitionBy(entity).orderBy("_slice").rowsBetween(-reach, -1)
    ahead = F.flatten(F.collect_list("_tail").over(earlier))
    halo = (
        tails.select(entity, "_slice", ahead.alias("_rows"))
        .withColumn("_rows", F.slice("_rows", F.greatest(F.size("_rows") - reach + 1, F.lit(1)),
                                     F.lit(reach)))
        .select(entity, "_slice", F.inline("_rows"))
        .withColumn("_halo", F.lit(True))
    )
    both = rows.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    window = Window.partitionBy(entity, "_slice").orderBy(ts)
    return both.withColumns(columns(window)).filter(~F.col("_halo")).drop("_slice", "_halo")

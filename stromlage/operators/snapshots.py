"""Latest and point-in-time rows of an entity."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stromlage import fixed_values as fv
from stromlage.operators.ordering import range_slices
from stromlage.session import stage


def first_row(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in ``order``.

    Spark cuts each task's rows to one per key before the shuffle
    (WindowGroupLimit), so no key is ever gathered whole.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_row", number).filter("_row = 1").drop("_row")


def latest_per_entity(
    df: DataFrame, key: str = "corridor_id", ts: str = "timestamp"
) -> DataFrame:
    return first_row(df, [key], F.col(ts).desc())


def replay_targets(spark) -> DataFrame:
    """The built-in replay: one instant per corridor, and its fallback."""
    return spark.createDataFrame(
        fv.REPLAY_TARGETS, "corridor_id BIGINT, timestamp STRING, fallback STRING"
    ).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def snapshot_targets(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows at exactly the wanted (corridor, instant), all targets in one join."""
    return df.join(targets.select("corridor_id", "timestamp"), ["corridor_id", "timestamp"])


def missing_targets(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets without an exact row. Reads the two key columns only."""
    key = ["corridor_id", "timestamp"]
    found = df.select(*key).join(targets.select(*key), key, "left_semi")
    return targets.join(found, key, "left_anti")


def nearest_asof(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target, its corridor's row closest in time, before or after.

    Of two equally close rows the earlier counts. Targets name a corridor once,
    so every row is compared with one instant at most.
    """
    wanted = targets.select("corridor_id", F.col("timestamp").alias("_wanted"))
    distance = F.abs(F.timestamp_diff("MICROSECOND", F.col("_wanted"), F.col("timestamp")))
    rows = df.join(wanted, "corridor_id")
    return first_row(rows, ["corridor_id", "_wanted"], distance, F.col("timestamp")).drop("_wanted")


def first_calm(df: DataFrame, targets: DataFrame, below: float = 0.5) -> DataFrame:
    """Per target, its corridor's earliest row with a label below ``below``."""
    calm = df.filter(F.col("failure_event") < F.lit(below))
    rows = calm.join(targets.select("corridor_id"), "corridor_id", "left_semi")
    return first_row(rows, ["corridor_id"], F.col("timestamp"))


def demo_snapshot(df: DataFrame, targets: DataFrame, below: float = 0.5) -> DataFrame:
    """Per target its exact row, else the row of its fallback, from one scan of ``df``.

    Each row is at most one candidate for a target of its corridor: exact; or
    for ``nearest`` as far off as its time, earlier first; or for ``calm``, with
    a label below ``below``, the earliest. One minimum per target picks among
    them, with partial minima before the shuffle. Several targets of one
    corridor are allowed; for very many see ``nearest_of_many``.
    """
    wanted = targets.select("corridor_id", F.col("timestamp").alias("_wanted"), "fallback").distinct()
    ts, at = F.col("timestamp"), F.col("_wanted")
    away = F.timestamp_diff("MICROSECOND", at, ts)
    zero = F.lit(0).cast("long")
    place = (
        F.when(ts == at, F.struct(F.lit(0).alias("kind"), zero.alias("away"), ts.alias("ts")))
        .when(F.col("fallback") == "nearest", F.struct(F.lit(1).alias("kind"), F.abs(away).alias("away"), ts.alias("ts")))
        .when(
            (F.col("fallback") == "calm") & (F.col("failure_event") < F.lit(below)),
            F.struct(F.lit(1).alias("kind"), zero.alias("away"), ts.alias("ts")),
        )
    )
    candidates = df.join(wanted, "corridor_id").withColumn("_place", place).where(F.col("_place").isNotNull())
    first = candidates.groupBy("corridor_id", "_wanted", "fallback").agg(
        F.min_by(F.struct(*[c for c in df.columns if c != "corridor_id"]), "_place").alias("_row"))
    return first.select(*["corridor_id" if c == "corridor_id" else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def nearest_of_many(df: DataFrame, targets: DataFrame, slices: int | None = None) -> DataFrame:
    """(corridor_id, wanted, and the columns of ``df``): per target its corridor's closest row, however many targets there are.

    A sorted merge: rows and targets are cut into range slices of one order,
    (corridor, time), and each target takes the last row before it and the next
    one after it in its slice. Where a slice ends inside a corridor, both are
    carried over its bound from a table with one line per corridor and slice.
    Each row is read once, no row meets a target it does not neighbour, and a
    corridor with most of the rows is many slices. Of two equally close rows
    the earlier counts; equal targets give one line.
    """
    row = F.struct(*df.columns)
    kind = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in df.schema.fields) + ">"
    both = df.select("corridor_id", F.col("timestamp").alias("_at"), row.alias("_row")).unionByName(
        targets.select("corridor_id", F.col("timestamp").alias("_at"), F.lit(None).cast(kind).alias("_row")).distinct()
    ).where(F.col("corridor_id").isNotNull() & F.col("_at").isNotNull())
    sliced = stage(
        range_slices(both, [F.col("corridor_id"), F.col("_at")], slices).withColumn("_slice", F.spark_partition_id()), "merge"
    )
    inside = Window.partitionBy("corridor_id", "_slice").orderBy("_at")
    near = sliced.withColumns({
        "_before": F.last("_row", ignorenulls=True).over(inside.rangeBetween(Window.unboundedPreceding, 0)),
        "_after": F.first("_row", ignorenulls=True).over(inside.rangeBetween(0, Window.unboundedFollowing)),
    }).where(F.col("_row").isNull())
    ends = sliced.where(F.col("_row").isNotNull()).groupBy("corridor_id", "_slice").agg(
        F.min_by("_row", "_at").alias("_first"), F.max_by("_row", "_at").alias("_last"))
    # Slices that hold targets only have ends as well, so that the carrying over does not stop at them.
    every = sliced.select("corridor_id", "_slice").distinct().join(ends, ["corridor_id", "_slice"], "left")
    along = Window.partitionBy("corridor_id").orderBy("_slice")
    carried = every.select(
        "corridor_id", "_slice",
        F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    ).where(F.col("_earlier").isNotNull() | F.col("_later").isNotNull())
    found = near.join(carried, ["corridor_id", "_slice"], "left").select(
        "corridor_id", "_at", F.coalesce("_before", "_earlier").alias("_before"), F.coalesce("_after", "_later").alias("_after"))
    gap = [F.abs(F.timestamp_diff("MICROSECOND", F.col(f"{c}.timestamp"), F.col("_at"))) for c in ("_before", "_after")]
    chosen = F.when(F.col("_after").isNull() | (gap[0] <= gap[1]), F.col("_before")).otherwise(F.col("_after"))
    return found.withColumn("_row", chosen).where(F.col("_row").isNotNull()).select(
        "corridor_id", F.col("_at").alias("wanted"), *[F.col(f"_row.`{c}`").alias(c) for c in df.columns if c != "corridor_id"])


def snapshot_at(df: DataFrame, at: Column, ts: str = "timestamp") -> DataFrame:
    """Rows at one instant; ``at`` may be a scalar subquery."""
    return df.filter(F.col(ts) == at)


def latest_ts(df: DataFrame, back: str | None = None, ts: str = "timestamp") -> Column:
    """The latest instant, or one ``back`` from it, as a scalar subquery.

    The subtraction happens inside the subquery: a bare value on the right of a
    comparison is what Spark can push into the Parquet scan.
    """
    top = F.max(ts)
    if back:
        top = top - F.expr(f"INTERVAL {back}")
    return df.agg(top.alias("at")).scalar()


def trailing(df: DataFrame, back: str = "30 DAY", ts: str = "timestamp") -> DataFrame:
    """Rows of the last ``back`` before the latest instant, both ends included."""
    return df.filter(F.col(ts) >= latest_ts(df, back, ts))

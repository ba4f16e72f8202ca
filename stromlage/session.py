"""Session settings, and the shared folder for intermediate tables."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One key may hold a third of a table: let the join split that partition.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings every plan here counts on.

    Only runtime settings: executors, memory and the number of shuffle
    partitions belong to whoever submits the job.
    """
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


#: Shuffle files go at the end of an execution, not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Runtime settings for the plans executed inside, put back afterwards."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for tables that cut lineage.

    Taken from ``spark.checkpoint.dir``. Only a local session without that
    setting gets a folder of its own: on a cluster a machine-local folder would
    vanish with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="stromlage-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, used by nobody else."""
    return f"{scratch_dir(spark)}/stromlage/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later passes then read fixed, columnar data instead of recomputing a plan,
    and an executor lost on the way costs no more than its running tasks. What
    the plan has shuffled is deleted as soon as its result is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with settings(spark, {SHUFFLES_GO: "true"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

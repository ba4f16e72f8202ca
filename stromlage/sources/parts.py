"""Tables cut by a value of the key, for batches that touch little of them (K3-K6).

The cut (a day, or a bucket of the key) follows from the key alone, so that a
batch says itself which folders it can change: only those are read, joined and
written again, all others keep their files.
"""

import re
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stromlage.session import stage
from stromlage.sources.readers import MissingInput, path_missing
from stromlage.sources.tables import checked_batch, upsert

#: The folder column. Readers may name it in filters; ``PartedTable.read`` leaves it out.
PART = "_part"

#: The folder of rows without a time.
NO_DAY = "none"


def by_day(ts: str = "timestamp") -> Callable[[], Column]:
    return lambda: F.coalesce(F.to_date(ts).cast("string"), F.lit(NO_DAY))


def by_bucket(key: str, buckets: int) -> Callable[[], Column]:
    return lambda: F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string")


class PartedTable:
    """A Parquet table in folders of ``cut``; upserts replace the folders that a batch touches, nothing else."""

    def __init__(self, spark: SparkSession, path: str, cut: Callable[[], Column], schema: StructType | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.cut = cut
        self.schema = schema

    def ensure(self, schema: StructType) -> "PartedTable":
        """Create the table, empty, unless it exists; reads then use ``schema``."""
        self.schema = schema
        try:
            self.spark.read.text(self.path)
        except AnalysisException as error:
            if not path_missing(error):
                raise
            self.write(self.spark.createDataFrame([], schema))
        return self

    def write(self, df: DataFrame) -> None:
        """The whole table anew. A folder's rows come from one task, or from several where it is large."""
        self.schema = self.schema or df.schema
        self._put(df.withColumn(PART, self.cut()), "static")

    def _put(self, df: DataFrame, mode: str) -> None:
        df.hint("rebalance", F.col(PART)).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(PART).parquet(self.path)

    def parts(self, wanted: Sequence[str] | None = None) -> DataFrame:
        """The rows with their folder; with ``wanted`` no other folder is listed or read."""
        if self.schema is None:
            raise ValueError("the table's schema is not known yet: write or ensure it first")
        try:
            rows = self.spark.read.schema(StructType(self.schema.fields).add(PART, "string")).parquet(self.path)
        except AnalysisException as error:
            if path_missing(error):
                raise MissingInput(self.path) from error
            raise
        return rows if wanted is None else rows.where(F.col(PART).isin(list(wanted)))

    def folders(self) -> list[str]:
        """The folders there are, from the listing that every scan makes; no file is opened."""
        found = (re.search(rf"/{PART}=([^/]+)/", f) for f in self.parts().inputFiles())
        return sorted({unquote(m[1]) for m in found if m})

    def read(self) -> DataFrame:
        return self.parts().drop(PART)

    def upsert(
        self, updates: DataFrame, keys: Sequence[str], update_cols: Sequence[str], touch: str | None = None
    ) -> list[str] | None:
        """Apply a batch; returns the folders written, None (with a warning) for an empty batch.

        The folders' names come to the driver, which lists them anyway; their
        rows do not. What replaces them is staged first: a write that breaks
        off can be repeated from there, and no row is read while it is replaced.
        """
        batch = checked_batch(updates.select(*keys, *update_cols), keys, self.path)
        if batch is None:
            return None
        touched = sorted(r[0] for r in batch.select(self.cut().alias(PART)).distinct().collect())
        merged = upsert(self.parts(touched).drop(PART), batch, keys, update_cols, touch)
        self._put(stage(merged.withColumn(PART, self.cut()), "parts"), "dynamic")
        return touched

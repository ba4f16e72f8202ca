"""Versioned Parquet tables and upserts (K1, K3-K6)."""

import json
import logging
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stromlage.operators.quality import check_unique
from stromlage.session import stage
from stromlage.sources.readers import MissingInput, path_missing

logger = logging.getLogger(__name__)

AUDIT_COLUMNS = ("created_at", "updated_at", "scored_at")


def _written(column: str, update_cols: Sequence[str]) -> Column:
    """Value a column takes in a row that is new to the table."""
    if column in update_cols:
        return F.col(f"u.{column}")
    if column in AUDIT_COLUMNS:
        return F.localtimestamp()
    return F.lit(None)


def upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str],
    touch: str | None = None,
) -> DataFrame:
    """``target`` with ``updates`` applied by key, as a new frame.

    A key in both takes ``update_cols`` from the update, NULLs included, and
    ``touch`` becomes the current time; its other columns stay. A new key is
    inserted, audit columns set to now. Keys must be unique on both sides.

    The target is joined to the batch, and the batch to those of its keys that
    the target has. Where the batch is a table (as ``VersionedTable`` makes it),
    Spark knows its size in bytes: a small one is sent to the target, which is
    then not shuffled; for a large one both are, and skewed keys may be split.
    """
    keys, update_cols = list(keys), list(update_cols)
    batch = updates.select(*keys, *update_cols).withColumn("_hit", F.lit(True))
    t, u = target.alias("t"), batch.alias("u")
    on = [F.col(f"t.{k}") == F.col(f"u.{k}") for k in keys]
    hit = F.coalesce(F.col("u._hit"), F.lit(False))

    def merged(column: str) -> Column:
        kind, old = target.schema[column].dataType, F.col(f"t.{column}")
        if column in update_cols:
            old = F.when(hit, F.col(f"u.{column}").cast(kind)).otherwise(old)
        elif column == touch:
            old = F.when(hit, F.localtimestamp().cast(kind)).otherwise(old)
        return old.alias(column)

    kept = t.join(u, on, "left").select(*[merged(c) for c in target.columns])
    found = target.select(*keys).join(batch.select(*keys), keys, "left_semi")
    new = batch.join(found, keys, "left_anti").alias("u")
    inserted = new.select(
        *[
            (F.col(f"u.{c}") if c in keys else _written(c, update_cols))
            .cast(target.schema[c].dataType)
            .alias(c)
            for c in target.columns
        ]
    )
    return kept.unionByName(inserted)


class DuplicateKeys(ValueError):
    """An update batch names a key more than once."""


class ConcurrentWrite(RuntimeError):
    """Two changes started from the same version; the later one is to be repeated."""


def checked_batch(updates: DataFrame, keys: Sequence[str], path: str) -> DataFrame | None:
    """The batch as a staged table; None, with a warning, when it is empty. Repeated keys raise."""
    batch = stage(updates, "batch")
    if batch.isEmpty():
        logger.warning("nothing to load into %s", path)
        return None
    twice = check_unique(batch, keys).limit(5).collect()
    if twice:
        raise DuplicateKeys(f"{path}: {twice}")
    return batch


class VersionedTable:
    """A Parquet table whose every change is a new version beside the old one.

    A version counts once its number is in the log, which is written last: a
    reader never sees half a write, and a change may read the version before.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("version LONG, folder STRING").json(f"{self.path}/log")
        except AnalysisException as error:
            if path_missing(error):
                return None
            raise

    def version(self) -> int | None:
        log = self._log()
        return None if log is None else log.agg(F.max("version")).head()[0]

    def read(self) -> DataFrame:
        log = self._log()
        last = None if log is None else log.agg(F.max_by("folder", "version").alias("folder")).head()
        if last is None or last.folder is None:
            raise MissingInput(self.path)
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        return reader.parquet(f"{self.path}/data/{last.folder}")

    def write(self, df: DataFrame) -> int:
        """A new version in a folder of its own; fails if another writer was first.

        The store must make a new file atomically, as local folders and HDFS do.
        """
        before = self.version() or 0
        version, folder = before + 1, f"v{before + 1}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/data/{folder}")
        self._enter(version, folder)
        return version

    def _enter(self, version: int, folder: str) -> None:
        """Name the version in the log. Its file is made only if there is none: of two writers one fails."""
        file = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{version:012d}.json")
        store = file.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            out = store.create(file, False)
        except Py4JJavaError as error:
            if not store.exists(file):
                raise
            raise ConcurrentWrite(f"{self.path}: version {version} was written meanwhile") from error
        out.write(bytearray(json.dumps({"version": version, "folder": folder}) + "\n", "utf-8"))
        out.close()

    def ensure(self, schema: StructType) -> "VersionedTable":
        """Create the table, empty, unless it exists; reads then use ``schema``."""
        self.schema = schema
        if self.version() is None:
            self.write(self.spark.createDataFrame([], schema))
        return self

    def upsert(
        self,
        updates: DataFrame,
        keys: Sequence[str],
        update_cols: Sequence[str],
        touch: str | None = None,
    ) -> int | None:
        """Apply a batch; no-op with a warning when it is empty."""
        batch = checked_batch(updates.select(*keys, *update_cols), keys, self.path)
        if batch is None:
            return None
        return self.write(upsert(self.read(), batch, keys, update_cols, touch))

"""What several text operators share."""

import re
import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
words_of = re.compile(WORD).findall

#: The columns of ``documents``.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def worker_cache(key: Any, make: Callable[[], Any]) -> Any:
    """One object per Python worker and key, kept from task to task."""
    store = sys.modules.setdefault("_stromlage_worker", types.ModuleType("_stromlage_worker"))
    held = store.__dict__.setdefault("held", {})
    if key not in held:
        held[key] = make()
    return held[key]


def stats_partitions(spark: SparkSession, size: int, per_task: int) -> int:
    """Enough partitions for ``size`` units at ``per_task`` each, the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // per_task), 1)

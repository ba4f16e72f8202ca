"""Checks a file table cannot enforce, and load summaries (Q1-Q4, Q6, A1, A2)."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stromlage.session import stage


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def check_fk(df: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """Rows whose key the dimension lacks; a NULL key is no violation."""
    known = dim.select(F.col(dim_key or key).alias(key))
    return df.filter(F.col(key).isNotNull()).join(known, key, "left_anti")


def check_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the number of NULLs of each column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def unmapped(df: DataFrame, map_df: DataFrame, name: str = "disco_name") -> DataFrame:
    """Distinct names without an entry in the name map."""
    return df.select(name).distinct().join(map_df.select(name), name, "left_anti")


def load_summary(df: DataFrame, label: str = "failure_event") -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum(label), F.lit(0.0)).alias("label_sum"),
    )


def staged_with_figures(
    df: DataFrame, label: str, figures: dict[str, Column]
) -> tuple[DataFrame, dict[str, object]]:
    """``df`` staged, and aggregates of it observed by the write itself: no second pass."""
    seen = Observation()
    staged = stage(df.observe(seen, *[c.alias(name) for name, c in figures.items()]), label)
    return staged, seen.get


def null_figures(cols: Sequence[str]) -> dict[str, Column]:
    """``check_not_null`` as figures of a load."""
    return {f"null_{c}": F.count_if(F.col(c).isNull()) for c in cols}


def dataset_summary(df: DataFrame, name: str = "disco_name", year: str = "year") -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(F.col(name)).alias("n_names"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
    )

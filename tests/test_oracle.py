"""Every registered query with SQL beside it gives the same rows as that SQL."""

import pytest

import __spark_entry__ as entry_module
from stromlage.session import settings
from tools.check_oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    good, note = compare(spark, con, name, SF_DIR)
    assert good, note


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_no_query_pairs_all_with_all(spark, name):
    """Also without broadcasts, as with large tables, no join lacks a key."""
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        df = entry_module.queries()[name](spark, SF_DIR)
        plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_training_query_scores_every_test_row(spark):
    found = entry_module.queries()["gbt_soft_labels"](spark, SF_DIR)
    low, high, n = found.selectExpr("min(probability)", "max(probability)", "count(*)").head()
    assert n > 0 and 0 <= low <= high <= 1

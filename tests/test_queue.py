"""Global order, queue, key figures, context and checks."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stromlage.operators import context, joins, ordering, quality, queue
from stromlage.plans.scoring import consequence_scores
from tests.conftest import rows


def test_numbering_is_row_number(spark):
    """Half of all rows share one score; ties go by key."""
    df = spark.range(5000).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 2 == 0, 7.0).otherwise((F.col("id") * 37 % 101).cast("double")).alias("s"))
    order = [F.col("s").desc(), F.col("k").asc()]
    found = ordering.number_rows(df, order, "n", slices=6)
    plain = df.select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("n"), "k", "s")
    assert rows(found) == rows(plain)
    staged = ordering.ordered_slices(df, order, 6)
    assert staged.groupBy("_slice").count().agg(F.max("count")).head()[0] < 2000


def test_numbering_of_nothing(spark):
    empty = spark.range(0).select(F.col("id").alias("k"))
    assert ordering.number_rows(empty, [F.col("k")], "n").count() == 0


def test_running_sums(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    found = ordering.running_sums(df, [F.col("k").desc()], {"v": "total"}, slices=5)
    w = Window.orderBy(F.col("k").desc())
    plain = df.select("k", "v", F.sum("v").over(w).alias("total"),
                      F.lit(sum(i % 7 for i in range(1000))).cast("bigint").alias("total_total"))
    assert rows(found) == rows(plain)


@pytest.fixture
def golden(spark):
    risk = spark.createDataFrame(
        [(1, "A 330kV", 95.25), (2, "B 132kV", 40.0), (3, "C 330kV", 10.0), (4, "gone", 99.0)],
        "corridor_id BIGINT, corridor_name STRING, failure_probability_pct DOUBLE")
    meta = spark.createDataFrame(
        [(1, "Benin", 3373.0, 44.44), (2, "Eko DisCo", 0.0, 60.0), (3, None, 1686.5, 100.0)],
        "corridor_id BIGINT, disco_name STRING, critical_infra_score DOUBLE, economic_loss_per_hr DOUBLE")
    return consequence_scores(risk, meta)


def test_queue(golden):
    found = queue.dispatch_queue(golden).orderBy("priority").collect()
    assert [(r.priority, r.corridor_name, r.risk_score) for r in found] == [
        (1, "A 330kV", 50.79), (2, "B 132kV", 24.0), (3, "C 330kV", 11.0)]
    assert queue.top_summary(golden).head().corridor_name == "A 330kV"
    assert [r.corridor_id for r in queue.ranked(golden, "risk_score").collect()] == [1, 2, 3]


@pytest.fixture
def view(spark, golden):
    corridors = spark.createDataFrame(
        [("A 330kV", "Benin", 6.3, 5.6, 405, 0, 132), ("B 132kV", "Eko DisCo", 6.5, 3.3, None, 2, 0)],
        "name STRING, disco_name STRING, latitude DOUBLE, longitude DOUBLE, hospital_count INT, "
        "school_count INT, market_count INT")
    return joins.enrich_queue(queue.dispatch_queue(golden), corridors)


def test_enrich(view):
    found = {r.name: r for r in view.collect()}
    a, b, c = found["A 330kV"], found["B 132kV"], found["C 330kV"]
    assert (a.infra, a.crew, a.disco) == ("Hospital (405), Market (132)", "Alpha", "Benin DisCo")
    assert (b.infra, b.crew, b.disco) == ("School (2)", "Beta", "Eko DisCo")
    assert (c.infra, c.lat, c.lon) == ("Residential", 9.08, 8.67)


def test_key_figures(view):
    assert tuple(queue.kpis(view, 0.0, crews=3).head()) == (1, 44.44, 1, -2, 3, 95.25, "A")
    assert tuple(queue.kpis(view, 99.9).head()) == (0, 0.0, 0, -3, 3, 0.0, "N/A")
    assert tuple(queue.kpis(view, 30.0, "Eko DisCo").head())[-2:] == (40.0, "B")
    assert tuple(queue.highest(view.filter("false")).head()) == (0.0, "N/A")


def test_first_in_queue_wins_a_tie(spark):
    df = spark.createDataFrame([(2, "second", 50.0), (1, "first", 50.0), (3, "low", 1.0)],
                               "priority BIGINT, name STRING, risk DOUBLE")
    assert queue.highest(df).head().name == "first"
    assert [r.priority for r in queue.top_risk(df, 2).collect()] == [1, 2]


def test_view_gives_crews_by_position(view):
    found = queue.dispatch_view(queue.filter_risk(view, 10.0), crews=2).collect()
    assert [(r.position, r.row_class, r.badge, r.crew) for r in found] == [
        (1, 1, "high", "Alpha"), (2, 2, "medium", "Beta"), (3, 3, "low", "—")]
    assert queue.filter_risk(view, 0.0, "Eko DisCo").count() == 1


def test_top_losses_ties_by_name(spark):
    df = spark.createDataFrame(
        [("b", 2023, 5.0), ("a", 2023, 5.0), ("c", 2023, 9.0), ("d", 2022, 99.0), ("e", 2023, None)],
        "disco_name STRING, year INT, economic_loss_per_hr DOUBLE")
    assert [r.disco_name for r in queue.top_losses(df, 3).collect()] == ["c", "a", "b"]


def test_pick(spark):
    df = spark.createDataFrame([(1, "x")], "priority INT, `AI Probability (%)` STRING")
    assert queue.pick(df, {"risk": "AI Probability (%)"}).columns == ["risk"]


TELEMETRY = "timestamp TIMESTAMP_NTZ, frequency_hz DOUBLE, voltage_kv DOUBLE, failure_event DOUBLE"


def test_snapshot_and_availability(spark, at):
    df = spark.createDataFrame(
        [(at(10, 1), 50.0, kv, y) for kv, y in
         ((313.4, 0.0), (313.5, 0.0), (200.0, 0.25), (125.3, None))] +
        [(at(10, 1), 50.0, 125.4, None)], TELEMETRY)
    assert tuple(context.grid_snapshot(df).head()) == (50.0, 125.3, 2)
    assert context.availability(df.filter("voltage_kv <> 125.4")).head()[0] == 50.0
    assert tuple(context.grid_snapshot(df.filter("false")).head()) == (None, None, None)
    assert context.availability(df.filter("false")).head()[0] is None


def test_context_deltas(spark, at):
    df = spark.createDataFrame(
        [(at(10, 31, 10), 50.0, 320.0, 0.0), (at(10, 31, 9), 49.9, 310.0, 1.0),
         (at(10, 1, 10), 49.0, 1.0, 0.0), (at(10, 1, 9), 49.0, 1.0, 1.0)], TELEMETRY)
    one = context.grid_context(df).head()
    assert one.latest_ts == at(10, 31, 10)
    assert (one.avg_frequency_hz, one.min_voltage_kv, one.at_risk) == (50.0, 320.0, 0)
    assert (one.delta_freq, one.delta_voltage, one.delta_at_risk) == (0.1, 10.0, -1)
    assert one.plant_availability_pct == 66.7
    alone = context.grid_context(df.filter(F.col("timestamp") != at(10, 31, 9))).head()
    assert alone.delta_freq is None and alone.delta_at_risk is None
    nothing = context.grid_context(df.filter("false")).head()
    assert nothing.latest_ts is None and nothing.plant_availability_pct is None


def test_context_filter_reaches_the_scan(spark, at, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(at(10, 31), 50.0, 320.0, 0.0)], TELEMETRY).write.parquet(path)
    df = context.grid_context(spark.read.schema(TELEMETRY).parquet(path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp,ScalarSubquery" in plan


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "c")], "k BIGINT, v STRING")
    assert rows(quality.check_unique(df, ["k"])) == [(1, 2)]
    dim = spark.createDataFrame([(1,)], "id BIGINT")
    assert rows(quality.check_fk(df, dim, "k", "id")) == [(2, None)]
    assert tuple(quality.check_not_null(df, ["k", "v"]).head()) == (1, 1)
    labels = spark.createDataFrame([(None,), (None,)], "failure_event DOUBLE")
    assert tuple(quality.load_summary(labels).head()) == (2, 0.0)


def test_key_figures_of_scores_that_are_not_numbered(spark):
    schema = "corridor_id BIGINT, name STRING, risk DOUBLE, loss DOUBLE, risk_score DOUBLE, disco STRING"
    df = spark.createDataFrame(
        [(3, "late", 70.0, 1.0, 5.0, "x"), (2, "first", 70.0, 2.0, 9.0, "x"), (1, "none", 70.0, 4.0, None, "x"), (9, "low", 5.0, 8.0, 99.0, "x")],
        schema)
    assert queue.highest(df).head().name == "first"
    one = queue.kpis(df, 30.0, crews=2).head()
    assert (one.at_risk, one.est_loss, one.highest_name, one.total_monitored) == (3, 7.0, "first", 4)

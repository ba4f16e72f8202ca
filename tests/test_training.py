"""Curve, report, training on fractional labels, and the scoring run."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stromlage import schemas
from stromlage.operators import curve, snapshots
from stromlage.operators.boosting import Growth
from stromlage.plans import scoring, training
from stromlage.sources import artifacts, readers
from stromlage.sources.tables import VersionedTable
from tests.conftest import rows

SCORED = "score DOUBLE, label INT"
GOLDEN = [(0.9, 1), (0.8, 0), (0.8, 1), (0.4, 0), (0.3, 1), (0.1, 0)]


def test_golden_curve(spark):
    found = curve.pr_curve(spark.createDataFrame(GOLDEN, SCORED), slices=3).orderBy("threshold")
    got = [(r.threshold, r.tp, r.fp, round(r.precision, 6), round(r.recall, 6), round(r.f1, 6))
           for r in found.collect()]
    assert got == [
        (0.1, 3, 3, 0.5, 1.0, 0.666667), (0.3, 3, 2, 0.6, 1.0, 0.75),
        (0.4, 2, 2, 0.5, 0.666667, 0.571429), (0.8, 2, 1, 0.666667, 0.666667, 0.666667),
        (0.9, 1, 0, 1.0, 0.333333, 0.5)]
    best = curve.best_threshold(spark.createDataFrame(GOLDEN, SCORED)).head()
    assert tuple(best) == pytest.approx((0.3, 0.75))


def test_lowest_threshold_on_a_tie_and_without_positives(spark):
    tie = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.4, 0), (0.2, 1), (0.1, 0)], SCORED)
    best = curve.best_threshold(tie).head()
    assert {round(r.f1, 6) for r in curve.pr_curve(tie).filter("threshold IN (0.9, 0.2)").collect()
            } == {0.666667}
    assert best.threshold == 0.2
    none = spark.createDataFrame([(0.9, 0), (0.2, 0)], SCORED)
    assert tuple(curve.best_threshold(none).head()) == (0.2, 0.0)
    assert {r.recall for r in curve.pr_curve(none).collect()} == {1.0}


@pytest.mark.parametrize("seed", range(4))
def test_best_threshold_by_bounds_equals_all_thresholds(spark, seed):
    """Scores in and outside of 0 to 1, crowded in one bin, repeated, NULL and NaN."""
    rnd = random.Random(seed)
    data = [
        (rnd.choice([rnd.random(), 0.5 + rnd.random() / 9000, round(rnd.random(), 1), rnd.uniform(-2, 3)]), 0)
        for _ in range(1500)
    ] + [(None, seed % 2), (float("nan"), seed % 2)]
    data = [(s, y or int(rnd.random() < (0.7 if s and s > 0.4 + seed / 10 else 0.1))) for s, y in data]
    df = spark.createDataFrame(data, SCORED)
    expected = curve.pr_curve(df).orderBy(F.col("f1").desc(), "threshold").head()
    found = curve.best_threshold(df, slices=3).head()
    assert (found.threshold, found.f1) == (expected.threshold, pytest.approx(expected.f1, abs=1e-12))
    bins = curve.threshold_bins(df).collect()
    assert sum(r.live for r in bins) < len(bins) / 4
    per_bin = {r["_bin"]: r for r in bins}
    for r in curve.pr_curve(df).withColumn("_bin", curve._bin(F.col("threshold"))).collect():
        assert r.f1 <= per_bin[r["_bin"]].upper + 1e-12


@pytest.mark.parametrize("data", [GOLDEN, [(0.1, 0), (0.2, 0)], [(0.9, 1)]])
def test_report(spark, data):
    found = {r["class"]: r for r in
             curve.classification_report(spark.createDataFrame(data, SCORED), 0.5).collect()}

    def counts(k):
        hit = sum(1 for s, y in data if y == k and (s >= 0.5) == bool(k))
        said = sum(1 for s, _ in data if (s >= 0.5) == bool(k))
        real = sum(1 for _, y in data if y == k)
        p, r = (hit / said if said else 0.0), (hit / real if real else 0.0)
        return p, r, (2 * p * r / (p + r) if p + r else 0.0), real

    for k, name in ((0, "Normal"), (1, "Failure")):
        assert tuple(found[name])[1:] == pytest.approx(counts(k))
    both, n = (counts(0), counts(1)), len(data)
    assert found["macro avg"].f1 == pytest.approx(sum(c[2] for c in both) / 2)
    assert found["weighted avg"].recall == pytest.approx(sum(c[1] * c[3] for c in both) / n)
    assert found["accuracy"].f1 == pytest.approx(sum((s >= 0.5) == bool(y) for s, y in data) / n)


def test_expansion_keeps_the_loss(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.28,), (0.82,), (None,)], "failure_event DOUBLE")
    found = training.expand_soft_labels(df, positive_weight=10.0, weight_at=0.5)
    got = {(r.failure_event, r.label): round(r.weight, 6) for r in found.collect()}
    assert got == {(0.0, 0.0): 1.0, (1.0, 1.0): 10.0, (0.28, 1.0): 0.28, (0.28, 0.0): 0.72,
                   (0.82, 1.0): 8.2, (0.82, 0.0): 1.8}
    # By default only certain failures carry the class weight.
    found = training.expand_soft_labels(df, positive_weight=10.0)
    got = {(r.failure_event, r.label): round(r.weight, 6) for r in found.collect()}
    assert got == {(0.0, 0.0): 1.0, (1.0, 1.0): 10.0, (0.28, 1.0): 0.28, (0.28, 0.0): 0.72,
                   (0.82, 1.0): 0.82, (0.82, 0.0): 0.18}


@pytest.fixture(scope="module")
def features(spark):
    """Two months of four corridors: low voltage means a high label."""
    rnd = random.Random(3)
    data = []
    for c in (1, 2, 3, 4):
        for h in range(24 * 61):
            when = dt.datetime(2025, 11, 1) + dt.timedelta(hours=h)
            label = 1.0 if rnd.random() < 0.05 else (0.28 if c == 4 else 0.0)
            kv = 230.0 + rnd.uniform(-5, 5) if label == 1.0 else 325.0 + rnd.uniform(-5, 5)
            temp = None if rnd.random() < 0.1 else rnd.uniform(20, 40)
            hz = 50 + rnd.uniform(-0.2, 0.2)
            data.append((c, f"L{c} 330kV", "Benin", 10 * c, 44.44, when, kv, hz, hz - 50,
                         abs(hz - 50), kv - 313.5, temp, 60.0, label, when.hour,
                         when.isoweekday(), kv, kv, kv, hz, hz, hz, 0.1, temp))
    return spark.createDataFrame(data, schemas.MODEL_FEATURES)


@pytest.fixture(scope="module")
def trained(features):
    return training.train_and_tune(features, training.Params(growth=Growth(rounds=12)))


def test_training_separates_out_of_time(features, trained):
    model, test = trained
    assert test.agg(F.min("timestamp")).head()[0] == dt.datetime(2025, 12, 1)
    default, tuned, failures = training.evaluate(model, test)
    report = {r["class"]: r for r in tuned.collect()}
    assert report["Failure"].f1 > 0.95
    assert default.count() == 5
    assert failures.count() == report["Failure"].support
    assert failures.columns == ["corridor_id", "corridor_name", "timestamp", "failure_proba"]


def test_run_from_features_to_queue(spark, features, trained, tmp_path):
    paths = scoring.Paths(*[str(tmp_path / n) for n in
                            ("model", "threshold", "risk", "scores.csv", "queue.csv")])
    corridors = spark.createDataFrame(
        [(c, f"L{c} 330kV", "Benin" if c < 4 else "Nowhere", 10 * c) for c in (1, 2, 3, 4)],
        "id BIGINT, name STRING, disco_name STRING, critical_infra_score INT")
    performance = spark.createDataFrame(
        [("Benin", 2023, 44.44), ("Benin", 2022, 1.0)],
        "short_name STRING, year INT, economic_loss_per_hr DOUBLE")
    with pytest.raises(readers.MissingInput):
        scoring.run(spark, features, corridors, performance, paths)
    artifacts.save_model(spark, trained[0].model, paths.model)
    artifacts.save_threshold(spark, trained[0].threshold, paths.threshold)

    queue = scoring.run(spark, features, corridors, performance, paths)
    assert [r.priority for r in queue.orderBy("priority").collect()] == [1, 2, 3]
    assert rows(readers.read_queue_csv(spark, paths.queue_csv)) == rows(queue)
    assert readers.read_scores_csv(spark, paths.consequence_csv).count() == 3
    table = VersionedTable(spark, paths.risk_scores)
    risk = table.read()
    assert risk.count() == 4 and risk.filter("scored_at IS NULL").count() == 0
    assert {r.timestamp for r in risk.collect()} == {dt.datetime(2025, 12, 31, 23)}

    replay = snapshots.replay_targets(spark).filter("corridor_id <= 4")
    scoring.run(spark, features, corridors, performance, paths, targets=replay)
    again = {r.corridor_id: r.timestamp for r in table.read().collect()}
    assert again[1] == dt.datetime(2025, 12, 29, 14)
    assert again[2] == dt.datetime(2025, 11, 1)  # nearest to a target before the data
    with pytest.raises(readers.EmptyInput):
        scoring.run(spark, features.filter("false"), corridors, performance, paths)

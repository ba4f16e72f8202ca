"""Payloads, CSV, artifacts, versioned tables and upserts."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from stromlage import schemas
from stromlage.operators import context, geo
from stromlage.plans import ingestion
from stromlage.sources import artifacts, landed, readers
from stromlage.sources.parts import PartedTable, by_bucket, by_day
from stromlage.sources.tables import ConcurrentWrite, DuplicateKeys, VersionedTable, upsert
from stromlage.sources.writers import export_queue, overwrite_table, write_csv
from tests.conftest import rows

WEATHER = ('{"properties":{"parameter":{"T2M":{"2025100100":25.1,"2025100101":-999.0,'
           '"2025100102":7,"20251001xx":1.0},"RH2M":{"2025100100":80.0,"2025100101":-999.0,'
           '"2025100109":1.0}}}}')


@pytest.fixture
def payloads(spark):
    return spark.createDataFrame(
        [(1, WEATHER), (2, '{"properties":{}}'), (3, "not json"), (4, None)],
        "corridor_id BIGINT, payload STRING")


def test_weather_follows_the_temperature_keys(spark, payloads, at):
    good, bad = landed.split_malformed(landed.weather_rows(payloads))
    cols = ["corridor_id", "timestamp", "temperature", "humidity"]
    assert rows(good.select(*cols)) == [
        (1, at(10, 1, 0), 25.1, 80.0), (1, at(10, 1, 1), None, None), (1, at(10, 1, 2), 7.0, None)]
    assert [r.hour_key for r in bad.collect()] == ["20251001xx"]


def test_poi_payload(spark):
    df = spark.createDataFrame(
        [(1, '{"elements":[{"tags":{"amenity":"hospital","shop":"market"}},{"tags":{"shop":"bakery"}},'
             '{"lat":1.0,"lon":2.0},{"tags":{"landuse":"retail"}}]}'), (2, '{"elements":[]}')],
        "corridor_id BIGINT, payload STRING")
    flat = landed.read_poi_json(df)
    assert flat.count() == 4
    assert flat.filter("lat = 1").head().amenity == ""
    assert rows(geo.payload_counts(flat)) == [(1, 1, 0, 1)]


def test_csv_keeps_microseconds_nulls_and_order(spark, tmp_path):
    when = dt.datetime(2025, 10, 1, 3, 4, 5, 678901)
    data = [(2, when, 0.1), (1, when, None), (1, when - dt.timedelta(hours=1), 2.5)]
    schema = "corridor_id BIGINT, timestamp TIMESTAMP_NTZ, voltage_kv DOUBLE"
    df = spark.createDataFrame(data, schema)
    path = str(tmp_path / "out")
    write_csv(df, path, ["corridor_id", "timestamp"])
    back = readers.read_csv(spark, path, df.schema)
    assert rows(back) == rows(df)
    lines = [r.value for r in spark.read.text(path).coalesce(1).collect() if "corridor" not in r.value]
    assert [line.split(",")[0] for line in lines] == ["1", "1", "2"]


def test_queue_export_has_display_names(spark, tmp_path):
    q = spark.createDataFrame([(1, "A", 95.25, 50.79, 44.44, 3373)], schemas.DISPATCH_QUEUE)
    path = str(tmp_path / "queue")
    export_queue(q, path)
    assert spark.read.text(path).head().value == (
        "Priority,Corridor,AI Probability (%),Risk Score,NGN Loss/hr,Critical Infra")
    assert rows(readers.read_queue_csv(spark, path)) == rows(q)


def test_threshold(spark, tmp_path):
    path = str(tmp_path / "threshold")
    assert artifacts.load_threshold(spark, path) == 0.30
    artifacts.save_threshold(spark, 0.4321, path)
    assert artifacts.load_threshold(spark, path) == 0.4321
    (tmp_path / "other.json").write_text('{\n  "threshold": 0.5\n}')
    assert artifacts.load_threshold(spark, str(tmp_path / "other.json")) == 0.5
    (tmp_path / "empty.json").write_text('{"cut": 0.5}')
    assert artifacts.load_threshold(spark, str(tmp_path / "empty.json"), 0.25) == 0.25


def test_missing_and_empty_inputs_raise(spark, tmp_path):
    gone = str(tmp_path / "gone")
    for read in (readers.read_corridors, readers.read_performance, readers.read_features_csv,
                 readers.read_scores_csv, readers.read_queue_csv, artifacts.load_model):
        with pytest.raises(readers.MissingInput):
            read(spark, gone)
    with pytest.raises(readers.MissingInput):
        VersionedTable(spark, gone).read()
    empty = spark.createDataFrame([], schemas.THRESHOLD)
    with pytest.raises(readers.EmptyInput):
        readers.require_non_empty(empty, "snapshot")


def test_full_refresh(spark, tmp_path):
    path = str(tmp_path / "t")
    overwrite_table(spark.range(5), path)
    overwrite_table(spark.range(2), path)
    assert spark.read.parquet(path).count() == 2


TABLE = "k BIGINT, v DOUBLE, w STRING, created_at TIMESTAMP_NTZ"
OLD = dt.datetime(2020, 1, 1)


def test_upsert_partial(spark):
    target = spark.createDataFrame([(1, 1.0, "a", OLD), (2, 2.0, "b", OLD)], TABLE)
    updates = spark.createDataFrame([(2, None), (3, 3.0)], "k BIGINT, v DOUBLE")
    found = upsert(target, updates, ["k"], ["v"])
    assert rows(found.select("k", "v", "w")) == [(1, 1.0, "a"), (2, None, "b"), (3, 3.0, None)]
    created = {r.k: r.created_at for r in found.collect()}
    assert created[1] == created[2] == OLD and created[3] > OLD
    again = upsert(found, updates, ["k"], ["v"])
    assert rows(again.select("k", "v", "w")) == rows(found.select("k", "v", "w"))


def test_touch_moves_only_updated_rows(spark):
    target = spark.createDataFrame([(1, 1.0, "a", OLD), (2, 2.0, "b", OLD)],
                                   TABLE.replace("created_at", "scored_at"))
    updates = spark.createDataFrame([(2, 5.0)], "k BIGINT, v DOUBLE")
    found = upsert(target, updates, ["k"], ["v"], touch="scored_at")
    stamped = {r.k: r.scored_at for r in found.collect()}
    assert stamped[1] == OLD and stamped[2] > OLD


def test_small_batch_does_not_shuffle_the_target(spark):
    target = spark.range(1000).selectExpr("id AS k", "1.0D AS v")
    updates = spark.range(10).selectExpr("id AS k", "2.0D AS v")
    plan = upsert(target, updates, ["k"], ["v"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in text and "SortMergeJoin" not in text


def test_versioned_table(spark, tmp_path, caplog):
    table = VersionedTable(spark, str(tmp_path / "t"))
    schema = spark.createDataFrame([], TABLE).schema
    assert table.ensure(schema).ensure(schema).version() == 1
    assert table.read().count() == 0
    batch = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k BIGINT, v DOUBLE")
    assert table.upsert(batch, ["k"], ["v"]) == 2
    assert table.upsert(batch.filter("k > 5"), ["k"], ["v"]) is None
    assert "nothing to load" in caplog.text
    with pytest.raises(DuplicateKeys):
        table.upsert(batch.union(batch), ["k"], ["v"])
    assert table.version() == 2
    assert rows(table.read().select("k", "v")) == [(1, 1.0), (2, 2.0)]


def test_figures_of_a_load_come_with_its_write(spark, payloads):
    hours, seen = ingestion.staged_hours(payloads)
    assert seen["n_rows"] == hours.count() > 0
    for c in ("timestamp", "temperature", "humidity"):
        assert seen[f"null_{c}"] == hours.filter(F.col(c).isNull()).count()
    _, none = ingestion.staged_hours(payloads.filter("payload = ''"))
    assert set(none.values()) == {0}


def test_loads(spark, payloads, tmp_path, at, caplog):
    weather = VersionedTable(spark, str(tmp_path / "weather"))
    ingestion.load_weather(weather, payloads)
    assert "malformed" in caplog.text
    assert weather.read().count() == 3 and weather.read().columns == schemas.WEATHER.fieldNames()
    poi = spark.createDataFrame([], "lat DOUBLE, lon DOUBLE, amenity STRING, shop STRING, landuse STRING")
    corridors = ingestion.corridors_with_infra(readers.builtin_corridors(spark), poi)
    table = VersionedTable(spark, str(tmp_path / "corridors"))
    ingestion.load_corridors(table, corridors)
    first = {r.id: (r.created_at, r.updated_at) for r in table.read().collect()}
    ingestion.load_corridors(table, corridors.filter("id = 1"))
    second = {r.id: (r.created_at, r.updated_at) for r in table.read().collect()}
    assert first[2] == second[2]
    assert first[1][0] == second[1][0] and first[1][1] < second[1][1]
    frequency = weather.read().select("corridor_id", "timestamp", F.lit(50.0).alias("frequency_hz"))
    from stromlage.operators.events import builtin_events, event_windows
    telemetry = ingestion.telemetry_under_events(
        weather.read(), table.read(), frequency, event_windows(builtin_events(spark)))
    scada = VersionedTable(spark, str(tmp_path / "scada"))
    ingestion.load_telemetry(scada, telemetry)
    assert scada.read().count() == 3
    assert scada.read().filter(F.hour("timestamp") == 0).head().voltage_kv == 330.0


def test_performance_load(spark, caplog):
    raw = spark.createDataFrame(
        [("Benin Electricity Distribution Company", 2023, 1, 1, 1.0, 10.0, 25.0, 7_000_000.0, 1.0),
         ("Elsewhere", 2023, 1, 1, 1.0, 10.0, 25.0, 0.0, 1.0)], schemas.PERFORMANCE_RAW)
    found = ingestion.performance_with_loss(raw)
    assert found.columns == schemas.PERFORMANCE.fieldNames()
    assert {r.short_name: r.economic_loss_per_hr for r in found.collect()} == {"Benin": 62.93, None: 0.0}
    from stromlage.operators.joins import builtin_name_map
    assert rows(ingestion.report_unmapped(raw, builtin_name_map(raw))) == [("Elsewhere",)]
    assert "1 names" in caplog.text


def _files(path):
    return {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_upsert_by_day_leaves_other_days_alone(spark, tmp_path, at):
    schema = "k BIGINT, timestamp TIMESTAMP_NTZ, v DOUBLE, created_at TIMESTAMP_NTZ"
    table = PartedTable(spark, str(tmp_path / "t"), by_day())
    table.write(spark.createDataFrame([(k, at(10, d, 5), float(k), at(1, 1)) for k in range(3) for d in (1, 2, 3)], schema))
    before = _files(tmp_path / "t")
    batch = spark.createDataFrame([(0, at(10, 2, 5), None), (7, at(10, 2, 6), 70.0), (7, at(10, 9), 71.0)], "k BIGINT, timestamp TIMESTAMP_NTZ, v DOUBLE")
    assert table.upsert(batch, ["k", "timestamp"], ["v"]) == ["2025-10-02", "2025-10-09"]
    after = _files(tmp_path / "t")
    assert {f for f in before if "2025-10-02" not in str(f)} == {f for f in before if after.get(f) == before[f]}
    found = {(r.k, r.timestamp): (r.v, r.created_at) for r in table.read().collect()}
    assert len(found) == 11 and found[0, at(10, 2, 5)] == (None, at(1, 1)) and found[1, at(10, 2, 5)] == (1.0, at(1, 1))
    assert found[7, at(10, 9)][0] == 71.0 and found[7, at(10, 9)][1] is not None
    assert table.upsert(batch.filter("k > 8"), ["k", "timestamp"], ["v"]) is None
    with pytest.raises(DuplicateKeys):
        table.upsert(batch.union(batch), ["k", "timestamp"], ["v"])
    assert _files(tmp_path / "t") == after


def test_touched_folders_are_all_that_is_scanned(spark, tmp_path, at):
    table = PartedTable(spark, str(tmp_path / "t"), by_bucket("k", 4))
    table.write(spark.range(100).selectExpr("id AS k", "id * 2 AS v"))
    part = table.parts(["1"])
    assert {f.split("_part=")[1][0] for f in part.inputFiles()} >= {"1"}
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan or "PartitionFilters: [(_part" in plan
    written = table.upsert(spark.createDataFrame([(5, -1)], "k BIGINT, v BIGINT"), ["k"], ["v"])
    assert len(written) == 1 and table.read().agg(F.sum("v")).head()[0] == 9900 - 10 - 1


def test_days_are_pruned_by_the_latest_folder(spark, tmp_path, at):
    table = PartedTable(spark, str(tmp_path / "t"), by_day())
    rows = [(1, at(10, d), 0.0 if d % 2 else 1.0) for d in range(1, 11)] + [(2, None, 0.0)]
    table.write(spark.createDataFrame(rows, "corridor_id BIGINT, timestamp TIMESTAMP_NTZ, failure_event DOUBLE"))
    one = context.availability_of_days(table, 4)
    assert tuple(one.head()) == (50.0, 4) and table.folders()[0] == "2025-10-01"
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan.split("PartitionFilters: ")[1].split("]")[0]
    scanned = tmp_path / "t" / "_part=2025-10-01"
    for f in scanned.glob("*.parquet"):
        f.write_bytes(b"unreadable")
    assert tuple(context.availability_of_days(table, 4).head()) == (50.0, 4)


def test_of_two_writers_one_fails(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    df = spark.range(3)
    assert [table.write(df), table.write(df)] == [1, 2]
    results = []

    def write():
        try:
            results.append(VersionedTable(spark, table.path).write(df))
        except ConcurrentWrite:
            results.append("late")

    both = [threading.Thread(target=write) for _ in range(2)]
    [t.start() for t in both]
    [t.join() for t in both]
    assert sorted(map(str, results)) in (["3", "4"], ["3", "late"])
    late = VersionedTable(spark, table.path)
    with pytest.raises(ConcurrentWrite):
        late._enter(3, "v3-other")
    assert late.read().count() == 3

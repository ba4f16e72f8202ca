"""Points of interest: classes, radius join, counts, floors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stromlage.operators import geo
from stromlage.plans.ingestion import corridors_from_payloads, corridors_with_infra
from stromlage.sources.readers import builtin_corridors
from tests.conftest import rows

TAGS = "amenity STRING, shop STRING, landuse STRING"


def test_first_matching_class_wins(spark):
    df = spark.createDataFrame(
        [("hospital", "market", ""), ("school", "", "retail"), ("", "", "retail"),
         ("marketplace", "", ""), ("", "market", ""), ("", "bakery", ""), ("", "", "")], TAGS)
    assert [r.kind for r in geo.classify_poi(df).collect()] == [
        "hospital", "school", "market", "market", "market"]


def distance(lat1, lon1, lat2, lon2):
    a = (math.sin(math.radians(lat2 - lat1) / 2) ** 2
         + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2))
         * math.sin(math.radians(lon2 - lon1) / 2) ** 2)
    return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(a)))


def around(lat, lon, n, seed=5):
    """Points around a place, far enough to lie outside of most circles."""
    rnd = random.Random(seed)
    wide = min(170.0, 1.0 / max(0.005, math.cos(math.radians(abs(lat)))))
    return [
        (k, max(-90.0, min(90.0, lat + rnd.uniform(-0.5, 0.5))),
         (lon + rnd.uniform(-wide, wide) + 180) % 360 - 180)
        for k in range(n)
    ]


PLACES = [(9.0, 7.0), (0.0, 179.95), (0.0, -179.9), (78.0, 15.0), (89.9, 0.0), (-89.95, 120.0)]


@pytest.mark.parametrize("lat, lon", PLACES)
def test_radius_join_equals_brute_force(spark, lat, lon):
    centres, points = around(lat, lon, 12, seed=1), around(lat, lon, 1500)
    c = spark.createDataFrame(centres, "id BIGINT, latitude DOUBLE, longitude DOUBLE")
    p = spark.createDataFrame(points, "poi_id BIGINT, lat DOUBLE, lon DOUBLE")
    found = {(r.corridor_id, r.poi_id) for r in geo.poi_within(c, p).collect()}
    expected = {(a[0], b[0]) for a in centres for b in points if distance(*a[1:], *b[1:]) <= 20_000}
    assert found == expected and expected
    assert geo.poi_within(c, p).count() == len(found)


@pytest.mark.parametrize("lat, lon", PLACES)
@pytest.mark.parametrize("cell", [0.05, 0.02])
def test_counts_equal_brute_force(spark, lat, lon, cell):
    centres, points = around(lat, lon, 8, seed=2), around(lat, lon, 4000)
    c = spark.createDataFrame(centres, "id BIGINT, latitude DOUBLE, longitude DOUBLE")
    p = spark.createDataFrame(
        [(y, x, "hospital" if k % 2 else "school", "", "") for k, y, x in points],
        "lat DOUBLE, lon DOUBLE, " + TAGS)
    found = {r.corridor_id: (r.hospital_count, r.school_count)
             for r in geo.infra_counts(c, p, cell=cell).collect()}
    near = {a[0]: [b[0] % 2 for b in points if distance(*a[1:], *b[1:]) <= 20_000] for a in centres}
    assert found == {k: (sum(v), len(v) - sum(v)) for k, v in near.items()}
    assert sum(map(sum, near.values())) > 10


def test_counts_are_zero_filled_and_copies_count(spark):
    c = spark.createDataFrame([(1, 9.0, 7.0), (2, 20.0, 20.0)],
                              "id BIGINT, latitude DOUBLE, longitude DOUBLE")
    poi = spark.createDataFrame(
        [(9.0, 7.01, "hospital", "", "")] * 5 + [(9.05, 7.0, "", "market", "")]
        + [(9.5, 7.0, "school", "", "")], "lat DOUBLE, lon DOUBLE, " + TAGS)
    assert rows(geo.infra_counts(c, poi)) == [(1, 5, 0, 1), (2, 0, 0, 0)]


COUNTS = "disco_name STRING, hospital_count INT, school_count INT, market_count INT"


def test_floors_only_when_everything_is_zero(spark):
    df = spark.createDataFrame(
        [("Ikeja", 0, 0, 0), ("Eko", 0, 2, 0), ("Nowhere", 0, 0, 0), ("Kano", None, None, None)],
        COUNTS)
    found = {r.disco_name: tuple(r)[1:] for r in geo.apply_infra_floors(df).collect()}
    assert found == {"Ikeja": (3, 5, 8, 49), "Eko": (0, 2, 0, 4), "Nowhere": (0, 0, 0, 0),
                     "Kano": (2, 3, 8, 40)}


def test_builtin_corridors_get_counts_floors_and_score(spark):
    poi = spark.createDataFrame([(6.34, 5.63, "hospital", "", "")], "lat DOUBLE, lon DOUBLE, " + TAGS)
    found = corridors_with_infra(builtin_corridors(spark), poi)
    by_id = {r.id: r for r in found.collect()}
    assert len(by_id) == 8
    assert by_id[1].critical_infra_score == 5
    assert by_id[4].critical_infra_score == 4 * 5 + 4 * 2 + 10 * 3


def test_corridors_from_payloads(spark):
    payloads = spark.createDataFrame(
        [(1, '{"elements":[{"tags":{"amenity":"school"}}]}'), (2, '{"elements":[]}'), (3, None)],
        "corridor_id BIGINT, payload STRING")
    found = {r.id: r.critical_infra_score
             for r in corridors_from_payloads(builtin_corridors(spark), payloads).collect()}
    assert (found[1], found[2], found[3]) == (2, 49, 40) and len(found) == 8


def test_a_crowded_spot_meets_each_corridor_once(spark):
    """A third of all points on one coordinate are one row per class in the join."""
    poi = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 9.0).otherwise(F.col("id") % 80).cast("double").alias("lat"),
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") % 170).cast("double").alias("lon"),
        F.lit("school").alias("amenity"), F.lit("").alias("shop"), F.lit("").alias("landuse"))
    c = spark.createDataFrame([(1, 9.001, 7.001)], "id BIGINT, latitude DOUBLE, longitude DOUBLE")
    expected = poi.filter("lat = 9 AND lon = 7").count()
    assert geo.infra_counts(c, poi).head().school_count == expected >= 3000


def test_many_rows_of_a_short_table_are_dealt_over_all_cores(spark):
    """Both tables fit a broadcast, which would leave every pair to the one task that reads the other."""
    c = spark.createDataFrame([(k, 9.0 + k / 100, 7.0) for k in range(40)], "id BIGINT, latitude DOUBLE, longitude DOUBLE")
    p = spark.createDataFrame([(9.0 + k / 90, 7.0, "school", "", "") for k in range(40)], "lat DOUBLE, lon DOUBLE, " + TAGS)
    for found in (geo.poi_within(c.coalesce(1), p), geo.infra_counts(c.coalesce(1), p)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "_row" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "_row" in x]
        before = plan[plan.index("Generate explode"):]
        assert "REPARTITION_BY_NUM" in before

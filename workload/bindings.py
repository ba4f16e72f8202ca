"""Our tables, derived from the given ones; each with its SQL twin for the check.

Every binding keeps all rows of the table it comes from, and its work grows
with that table.
"""

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stromlage.functions.physics import clean_sentinel, full_hour
from stromlage.functions.risk import with_economic_loss, with_infra_score
from stromlage.session import tune


SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}


_OPEN: WeakKeyDictionary[SparkSession, dict[str, DataFrame]] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The given table. Its frame (a plan, no data) is made once per session."""
    if spark not in _OPEN:
        _OPEN[tune(spark)] = {}
    path = f"{sf_dir}/{name}.parquet"
    if path not in _OPEN[spark]:
        _OPEN[spark][path] = spark.read.schema(SCHEMAS[name]).parquet(path)
    return _OPEN[spark][path]


def reading_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    label = (
        F.when(kind == "signup", F.lit(None).cast("double"))
        .when((kind == "error") & (F.col("value") > 200), 1.0)
        .when(kind == "error", 0.28)
        .otherwise(0.0)
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("corridor_id"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("voltage_kv"),
        (F.lit(49.5) + reading_k() / F.lit(100.0)).alias("frequency_hz"),
        label.alias("failure_event"),
    )


TELEMETRY = """telemetry AS (
  SELECT user_id AS corridor_id, ts AS "timestamp", value AS voltage_kv,
         CAST(49.5 AS DOUBLE) + CAST(json_extract_string(props, '$.k') AS INTEGER)
           / CAST(100.0 AS DOUBLE) AS frequency_hz,
         CAST(CASE WHEN event_type = 'signup' THEN NULL
                   WHEN event_type = 'error' AND value > 200 THEN 1.0
                   WHEN event_type = 'error' THEN 0.28 ELSE 0.0 END AS DOUBLE) AS failure_event
  FROM events)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry on full hours, so that an instant has many corridors."""
    return telemetry(spark, sf_dir).withColumn("timestamp", full_hour(F.col("timestamp")))


HOURLY = TELEMETRY + """, hourly AS (
  SELECT corridor_id, date_trunc('hour', "timestamp") AS "timestamp",
         voltage_kv, frequency_hz, failure_event FROM telemetry)"""


def raw_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather beside all events but sign-ups; errors carry the missing-value flag."""
    k = reading_k()
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type") != "signup")
        .select(
            F.col("user_id").alias("corridor_id"),
            F.col("ts").alias("timestamp"),
            F.when(F.col("event_type") == "error", -999.0)
            .otherwise(F.lit(20.0) + k / F.lit(5.0)).alias("temperature"),
            (F.lit(50.0) + k / F.lit(2.0)).alias("humidity"),
        )
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_sentinel(raw_weather(spark, sf_dir), ["temperature", "humidity"])


WEATHER = """weather AS (
  SELECT user_id AS corridor_id, ts AS "timestamp",
         CASE WHEN event_type = 'error' THEN NULL
              ELSE CAST(20.0 AS DOUBLE) + CAST(json_extract_string(props, '$.k') AS INTEGER)
                / CAST(5.0 AS DOUBLE) END AS temperature,
         CAST(50.0 AS DOUBLE) + CAST(json_extract_string(props, '$.k') AS INTEGER)
           / CAST(2.0 AS DOUBLE) AS humidity
  FROM events WHERE event_type <> 'signup')"""


def corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    suffix = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), " 330kV")
    rows = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return with_infra_score(
        rows.select(
            key.alias("id"),
            F.concat("c_name", suffix.otherwise(" 132kV")).alias("name"),
            F.col("n_name").alias("disco_name"),
            (F.lit(4.0) + (key * 7919) % 9973 / F.lit(1000.0)).alias("latitude"),
            (F.lit(3.0) + (key * 6271) % 9967 / F.lit(1000.0)).alias("longitude"),
            (key % 4).cast("int").alias("hospital_count"),
            (key % 3).cast("int").alias("school_count"),
            (key % 5).cast("int").alias("market_count"),
        )
    )


CORRIDORS = """corridors AS (
  SELECT c_custkey AS id,
         c_name || CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY')
                        THEN ' 330kV' ELSE ' 132kV' END AS name,
         n_name AS disco_name,
         CAST(4.0 AS DOUBLE) + ((c_custkey * 7919) % 9973) / CAST(1000.0 AS DOUBLE) AS latitude,
         CAST(3.0 AS DOUBLE) + ((c_custkey * 6271) % 9967) / CAST(1000.0 AS DOUBLE) AS longitude,
         c_custkey % 4 AS hospital_count, c_custkey % 3 AS school_count,
         c_custkey % 5 AS market_count,
         (c_custkey % 4) * 5 + (c_custkey % 3) * 2 + (c_custkey % 5) * 3 AS critical_infra_score
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def raw_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per nation and year as energy; the last year differs by nation."""
    year = F.year("o_orderdate") + F.col("n_nationkey") % 3
    grouped = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name", "n_nationkey", year.alias("year"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("energy_received_mwh"))
    )
    return grouped.select(
        F.col("n_name").alias("disco_name"),
        "year",
        (F.lit(5.0) + F.col("n_nationkey") % 7).alias("technical_losses_pct"),
        (F.lit(10.0) + F.col("year") % 9).alias("commercial_losses_pct"),
        "energy_received_mwh",
    )


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_economic_loss(raw_performance(spark, sf_dir)).withColumn(
        "short_name", F.col("disco_name")
    )


PERFORMANCE = """raw_performance AS (
  SELECT n_name AS disco_name, CAST(year AS BIGINT) AS year,
         CAST(5.0 AS DOUBLE) + n_nationkey % 7 AS technical_losses_pct,
         CAST(10.0 AS DOUBLE) + year % 9 AS commercial_losses_pct,
         energy AS energy_received_mwh
  FROM (SELECT n_name, n_nationkey, EXTRACT(YEAR FROM o_orderdate) + n_nationkey % 3 AS year,
               ROUND(SUM(o_totalprice), 2) AS energy
        FROM orders JOIN customer ON o_custkey = c_custkey
                    JOIN nation ON c_nationkey = n_nationkey
        GROUP BY 1, 2, 3)),
performance AS (
  SELECT *, disco_name AS short_name,
         ROUND(energy_received_mwh / CAST(8760.0 AS DOUBLE) * CAST(1000.0 AS DOUBLE)
               * ((technical_losses_pct + commercial_losses_pct) / CAST(100.0 AS DOUBLE))
               * CAST(225.0 AS DOUBLE) / CAST(1000000.0 AS DOUBLE), 2) AS economic_loss_per_hr
  FROM raw_performance)"""


def failure_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .filter((F.col("event_type") == "error") & (F.col("value") > 200))
        .select(
            F.col("event_id").alias("event_seq"),
            F.col("user_id").alias("corridor_id"),
            F.col("ts").alias("event_ts"),
        )
    )


def ambient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corridors of one segment stand under constant stress."""
    return (
        table(spark, sf_dir, "customer")
        .filter(F.col("c_mktsegment") == "HOUSEHOLD")
        .select(
            F.col("c_custkey").alias("corridor_id"),
            F.lit(0.965).alias("volt_mult"),
            F.lit(-0.08).alias("freq_delta"),
            F.lit(0.28).alias("soft_label"),
        )
    )


WINDOWS = """ramp(off, volt_mult, freq_delta, soft_label) AS (VALUES
  (-6, 0.98, -0.05, 0.20), (-5, 0.97, -0.08, 0.28), (-4, 0.96, -0.12, 0.38),
  (-3, 0.94, -0.18, 0.52), (-2, 0.90, -0.25, 0.68), (-1, 0.82, -0.40, 0.82),
  (0, 0.70, NULL, 1.0)),
windows AS (
  SELECT user_id AS corridor_id,
         date_trunc('hour', ts) + off * INTERVAL 1 HOUR AS "hour",
         event_id AS event_seq, off AS "offset", CAST(volt_mult AS DOUBLE) AS volt_mult,
         CAST(freq_delta AS DOUBLE) AS freq_delta, CAST(soft_label AS DOUBLE) AS soft_label
  FROM events CROSS JOIN ramp
  WHERE event_type = 'error' AND value > 200
  QUALIFY ROW_NUMBER() OVER (PARTITION BY corridor_id, "hour"
                             ORDER BY off <> 0, event_id, off) = 1)"""


def poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as points of interest; some carry no tag that counts."""
    key = F.col("p_partkey")
    size = F.col("p_size") % 6
    return table(spark, sf_dir, "part").select(
        key.alias("poi_id"),
        F.when(size == 0, "hospital").when(size == 1, "school").when(size == 2, "marketplace")
        .otherwise("").alias("amenity"),
        F.when((size == 3) | (size == 0), "market").otherwise("bakery").alias("shop"),
        F.when(size == 4, "retail").otherwise("").alias("landuse"),
        (F.lit(4.0) + (key * 5557) % 9973 / F.lit(1000.0)).alias("lat"),
        (F.lit(3.0) + (key * 8623) % 9967 / F.lit(1000.0)).alias("lon"),
    )


POI = """poi AS (
  SELECT p_partkey AS poi_id,
         CASE p_size % 6 WHEN 0 THEN 'hospital' WHEN 1 THEN 'school'
              WHEN 2 THEN 'marketplace' ELSE '' END AS amenity,
         CASE WHEN p_size % 6 IN (0, 3) THEN 'market' ELSE 'bakery' END AS shop,
         CASE WHEN p_size % 6 = 4 THEN 'retail' ELSE '' END AS landuse,
         CAST(4.0 AS DOUBLE) + ((p_partkey * 5557) % 9973) / CAST(1000.0 AS DOUBLE) AS lat,
         CAST(3.0 AS DOUBLE) + ((p_partkey * 8623) % 9967) / CAST(1000.0 AS DOUBLE) AS lon
  FROM part),
classified AS (
  SELECT * FROM (
    SELECT *, CASE WHEN amenity = 'hospital' THEN 'hospital'
                   WHEN amenity = 'school' THEN 'school'
                   WHEN amenity = 'marketplace' OR shop = 'market' OR landuse = 'retail'
                   THEN 'market' END AS kind FROM poi)
  WHERE kind IS NOT NULL)"""


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored rows: returned ones are the positives."""
    score = F.col("l_extendedprice") / F.lit(110_000.0)
    return table(spark, sf_dir, "lineitem").select(
        score.alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label")
    )


LABELLED = """labelled AS (
  SELECT l_extendedprice / CAST(110000.0 AS DOUBLE) AS score,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instant per corridor with a purchase.

    It is the first purchase itself, or for two segments 90 minutes later, when
    there is usually no row: those fall back to the nearest or a calm one.
    """
    first = (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type") == "purchase")
        .groupBy(F.col("user_id").alias("corridor_id"))
        .agg(F.min("ts").alias("first_ts"))
    )
    segment = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("corridor_id"), "c_mktsegment"
    )
    late = F.col("c_mktsegment").isin("MACHINERY", "BUILDING")
    at = F.when(late, F.col("first_ts") + F.expr("INTERVAL 90 MINUTE"))
    return first.join(segment, "corridor_id").select(
        "corridor_id",
        at.otherwise(F.col("first_ts")).alias("timestamp"),
        F.when(F.col("c_mktsegment") == "BUILDING", "calm").otherwise("nearest").alias("fallback"),
    )


TARGETS = """targets AS (
  SELECT corridor_id,
         CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING')
              THEN first_ts + INTERVAL 90 MINUTE ELSE first_ts END AS "timestamp",
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'calm' ELSE 'nearest' END AS fallback
  FROM (SELECT user_id AS corridor_id, MIN(ts) AS first_ts FROM events
        WHERE event_type = 'purchase' GROUP BY 1)
  JOIN customer ON corridor_id = c_custkey)"""


def with_fixed_margin(df: DataFrame) -> DataFrame:
    """A fixed linear margin, in place of a model, that SQL can compute as well."""
    heat = F.coalesce(F.col("temperature"), F.lit(28.0)) - F.lit(28.0)
    return df.withColumn(
        "margin",
        F.lit(0.01) * F.col("voltage_deviation")
        - F.lit(2.0) * F.col("freq_deviation")
        + F.lit(0.05) * heat,
    )


MARGIN = """CAST(0.01 AS DOUBLE) * voltage_deviation - CAST(2.0 AS DOUBLE) * freq_deviation
  + CAST(0.05 AS DOUBLE) * (COALESCE(temperature, CAST(28.0 AS DOUBLE)) - CAST(28.0 AS DOUBLE))"""

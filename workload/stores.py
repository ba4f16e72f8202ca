"""Registered queries of sources, sinks and the model's inputs: written, read back, beside their SQL twins."""

from pyspark.sql import functions as F

from stromlage import fixed_values as fv
from stromlage import schemas
from stromlage.operators import context
from stromlage.operators.curve import best_threshold
from stromlage.operators.events import class_balance
from stromlage.plans import ingestion
from stromlage.plans.features import feature_frame
from stromlage.plans.training import expand_soft_labels
from stromlage.session import scratch_path
from stromlage.sources import artifacts, readers, writers
from stromlage.sources.parts import PartedTable, by_day
from stromlage.sources.tables import VersionedTable
from workload import bindings as b
from workload.catalog import CURVE, FEATURES, QUEUE, SCORES, _queue, _scores, feature_table, query, rounded, shaped, widened

CORRIDOR_OUT = f"""id, name, disco_name, {rounded('latitude longitude')},
  {widened('hospital_count school_count market_count critical_infra_score')}"""


@query("stored_corridors", f"WITH {b.CORRIDORS} SELECT {CORRIDOR_OUT} FROM corridors")
def stored_corridors(spark, d):
    """Corridors as a table, read with their schema."""
    path = scratch_path(spark, "corridors")
    writers.overwrite_table(b.corridors(spark, d), path)
    return shaped(readers.read_corridors(spark, path).drop("created_at", "updated_at"))


@query("performance_refresh", f"""WITH {b.PERFORMANCE}
  SELECT disco_name, year, {rounded('technical_losses_pct commercial_losses_pct energy_received_mwh')},
         CAST(NULL AS BIGINT) AS customers_total FROM raw_performance""")
def performance_refresh(spark, d):
    """A full refresh leaves nothing of what was there; columns that a file lacks are null."""
    path = scratch_path(spark, "performance")
    raw = b.raw_performance(spark, d).withColumn("year", F.col("year").cast("bigint"))
    writers.overwrite_table(raw.withColumn("disco_name", F.lit("old")), path)
    writers.overwrite_table(raw, path)
    read = readers.read_performance(spark, path)
    return shaped(read.select("disco_name", "year", "technical_losses_pct", "commercial_losses_pct",
                              "energy_received_mwh", "customers_total"))


@query("scores_csv", f"""WITH {SCORES}
  SELECT corridor_id, corridor_name, "timestamp", {rounded('failure_probability_pct')}, at_risk, disco_name,
         {widened('critical_infra_score')},
         {rounded('economic_loss_per_hr risk_exposure_naira infra_multiplier risk_score', 4)} FROM scores""")
def scores_csv(spark, d):
    """Consequence scores exported and read again."""
    path = scratch_path(spark, "scores")
    writers.write_csv(_scores(spark, d).select(*schemas.CONSEQUENCE_SCORES.fieldNames()), path)
    read = readers.read_scores_csv(spark, path)
    close = ["economic_loss_per_hr", "risk_exposure_naira", "infra_multiplier", "risk_score"]
    return shaped(read.withColumns({c: F.round(c, 4) for c in close}))


@query("queue_csv", f"""WITH {QUEUE}
  SELECT priority, corridor_name, {rounded('failure_probability_pct risk_score economic_loss_per_hr')},
         {widened('critical_infra_score')} FROM queue""")
def queue_csv(spark, d):
    """The dispatch queue under its display names, read again under ours."""
    path = scratch_path(spark, "queue")
    writers.export_queue(_queue(spark, d), path)
    return shaped(readers.read_queue_csv(spark, path))


@query("rows_at_instant", f"""WITH {b.TELEMETRY}
  SELECT corridor_id, "timestamp", {rounded('voltage_kv frequency_hz failure_event')} FROM telemetry
  WHERE (corridor_id, "timestamp") = (SELECT (corridor_id, "timestamp") FROM telemetry
                                      ORDER BY "timestamp" DESC, corridor_id LIMIT 1)""")
def rows_at_instant(spark, d):
    """A read by named parameters, here those of the latest reading."""
    rows = b.telemetry(spark, d)
    last = rows.orderBy(F.desc("timestamp"), "corridor_id").select("corridor_id", "timestamp").head()
    return shaped(readers.rows_at(rows, last.corridor_id, str(last.timestamp)))


@query("threshold_artifact", f"""WITH {CURVE}
  SELECT 'saved' AS kind, (SELECT ROUND(threshold, 6) FROM curve ORDER BY f1 DESC, threshold LIMIT 1) AS threshold
  UNION ALL SELECT 'missing', 0.3""")
def threshold_artifact(spark, d):
    """The saved threshold, and the default without one."""
    path = scratch_path(spark, "threshold")
    artifacts.save_threshold(spark, best_threshold(b.labelled_scores(spark, d)).head().threshold, path)
    found = [("saved", artifacts.load_threshold(spark, path)),
             ("missing", artifacts.load_threshold(spark, path + "-none", fv.DEFAULT_THRESHOLD))]
    return shaped(spark.createDataFrame(found, "kind STRING, threshold DOUBLE"))


@query("corridor_loads", f"""WITH {b.CORRIDORS}
  SELECT {CORRIDOR_OUT}, CAST(3 AS BIGINT) AS version, TRUE AS created, TRUE AS touched FROM corridors""")
def corridor_loads(spark, d):
    """K1, K5, K6: a table is made, loaded, touched by a second load, and left alone by an empty one."""
    table = VersionedTable(spark, scratch_path(spark, "loads"))
    rows = b.corridors(spark, d)
    ingestion.load_corridors(table, rows)
    first = table.read().select("id", F.col("created_at").alias("_created"), F.col("updated_at").alias("_updated"))
    ingestion.load_corridors(table, rows)
    ingestion.load_corridors(table, rows.filter("id < 0"))
    both = table.read().join(first, "id")
    return shaped(both.select(
        *[c for c in schemas.CORRIDORS.fieldNames() if not c.endswith("_at")],
        F.lit(table.version()).cast("bigint").alias("version"),
        (F.col("created_at") == F.col("_created")).alias("created"),
        (F.col("updated_at") > F.col("_updated")).alias("touched"),
    ))


@query("model_inputs", f"""WITH {FEATURES}
  SELECT {widened('hour_of_day day_of_week critical_infra_score')},
         {rounded(' '.join(c for c in fv.FEATURES if c not in ('hour_of_day', 'day_of_week', 'critical_infra_score')))}
  FROM features""")
def model_inputs(spark, d):
    """F8: the model's inputs and nothing else."""
    return shaped(feature_frame(feature_table(spark, d)))


@query("soft_label_expansion", f"""WITH {b.TELEMETRY}, ratio AS (
    SELECT COUNT(*) FILTER (failure_event < 0.5) / NULLIF(COUNT(*) FILTER (failure_event >= 0.5), 0)::DOUBLE AS r
    FROM telemetry),
  halves AS (
    SELECT corridor_id, "timestamp", 1.0::DOUBLE AS label, failure_event AS part, failure_event FROM telemetry
    UNION ALL
    SELECT corridor_id, "timestamp", 0.0::DOUBLE, 1 - failure_event, failure_event FROM telemetry)
  SELECT corridor_id, "timestamp", label,
         ROUND(part * CASE WHEN failure_event = 1 THEN COALESCE(r, 1) ELSE 1 END, 6) AS weight
  FROM halves, ratio WHERE part > 0""")
def soft_label_expansion(spark, d):
    """M2: the weighted halves of fractional labels, certain failures at the class ratio."""
    rows = b.telemetry(spark, d)
    ratio = class_balance(rows).head().ratio
    return shaped(expand_soft_labels(rows, 1.0 if ratio is None else ratio).select(
        "corridor_id", "timestamp", "label", "weight"))


RECENT = """recent AS (
  SELECT if(corridor_id % 3 = 0, corridor_id + 1000000000, corridor_id) AS corridor_id, "timestamp", temperature
  FROM weather, (SELECT MAX("timestamp") AS newest FROM weather) WHERE date_diff('day', "timestamp", newest) <= 2)"""


@query("upsert_days", f"""WITH {b.TELEMETRY}, {b.WEATHER}, {RECENT}
  SELECT corridor_id, "timestamp", ROUND(voltage_kv, 6) AS voltage_kv,
         ROUND(if(r.corridor_id IS NULL, frequency_hz, temperature), 6) AS frequency_hz
  FROM telemetry t FULL JOIN recent r USING (corridor_id, "timestamp")""")
def upsert_days(spark, d):
    """K3-K5: the readings of the last days replaced or added; other days keep their files."""
    key = ["corridor_id", "timestamp"]
    table = PartedTable(spark, scratch_path(spark, "days"), by_day())
    table.write(b.telemetry(spark, d).select(*key, "voltage_kv", "frequency_hz"))
    weather = b.weather(spark, d)
    newest = weather.agg(F.to_date(F.max("timestamp")).alias("d")).scalar()
    corridor = F.col("corridor_id")
    recent = weather.where(F.date_diff(newest, F.to_date("timestamp")) <= 2).select(
        F.when(corridor % 3 == 0, corridor + 1_000_000_000).otherwise(corridor).alias("corridor_id"), "timestamp",
        F.col("temperature").alias("frequency_hz"))
    table.upsert(recent, key, ["frequency_hz"])
    return shaped(table.read())


@query("availability_by_day_folders", f"""WITH {b.HOURLY}
  SELECT ROUND(AVG(CAST(failure_event IS NOT DISTINCT FROM 0.0 AS INTEGER)) * 100, 1) AS availability_pct, COUNT(*) AS n_rows
  FROM hourly, (SELECT MAX("timestamp")::DATE AS newest FROM hourly)
  WHERE date_diff('day', "timestamp"::DATE, newest) <= 6""")
def availability_by_day_folders(spark, d):
    """A3, A5, F4 on readings stored by day: the latest day is a folder's name, older folders are not listed."""
    table = PartedTable(spark, scratch_path(spark, "days"), by_day())
    table.write(b.hourly(spark, d).select("corridor_id", "timestamp", "failure_event"))
    return shaped(context.availability_of_days(table, 7))

"""Table schemas. Reads always name one; nothing is inferred from files."""

from pyspark.sql import types as T

_TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
}


def _flat(columns: str) -> T.StructType:
    """A flat schema from ``name TYPE`` pairs, without needing a session."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


CORRIDORS = _flat(
    "id BIGINT, name STRING, disco_name STRING, latitude DOUBLE, longitude DOUBLE, "
    "hospital_count INT, school_count INT, market_count INT, critical_infra_score INT, "
    "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
)

WEATHER = _flat(
    "corridor_id BIGINT, timestamp TIMESTAMP_NTZ, temperature DOUBLE, humidity DOUBLE, "
    "created_at TIMESTAMP_NTZ"
)

TELEMETRY = _flat(
    "corridor_id BIGINT, timestamp TIMESTAMP_NTZ, voltage_kv DOUBLE, frequency_hz DOUBLE, "
    "failure_event DOUBLE, created_at TIMESTAMP_NTZ"
)

PERFORMANCE_RAW = _flat(
    "disco_name STRING, year BIGINT, customers_total BIGINT, customers_metered BIGINT, "
    "collection_efficiency_pct DOUBLE, technical_losses_pct DOUBLE, "
    "commercial_losses_pct DOUBLE, energy_received_mwh DOUBLE, energy_billed_mwh DOUBLE"
)

PERFORMANCE = _flat(
    "disco_name STRING, short_name STRING, year BIGINT, customers_total BIGINT, "
    "customers_metered BIGINT, collection_efficiency_pct DOUBLE, technical_losses_pct DOUBLE, "
    "commercial_losses_pct DOUBLE, energy_received_mwh DOUBLE, energy_billed_mwh DOUBLE, "
    "economic_loss_per_hr DOUBLE"
)

MODEL_FEATURES = _flat(
    "corridor_id BIGINT, corridor_name STRING, disco_name STRING, critical_infra_score INT, "
    "economic_loss_per_hr DOUBLE, timestamp TIMESTAMP_NTZ, voltage_kv DOUBLE, "
    "frequency_hz DOUBLE, freq_deviation DOUBLE, freq_deviation_abs DOUBLE, "
    "voltage_deviation DOUBLE, temperature DOUBLE, humidity DOUBLE, failure_event DOUBLE, "
    "hour_of_day INT, day_of_week INT, volt_lag_1h DOUBLE, volt_lag_2h DOUBLE, "
    "volt_roll_avg_3h DOUBLE, freq_lag_1h DOUBLE, freq_lag_3h DOUBLE, "
    "freq_roll_avg_6h DOUBLE, freq_volatility_6h DOUBLE, temp_roll_avg_3h DOUBLE"
)

RISK_SCORES = _flat(
    "corridor_id BIGINT, corridor_name STRING, timestamp TIMESTAMP_NTZ, "
    "failure_probability_pct DOUBLE, at_risk INT, scored_at TIMESTAMP_NTZ"
)

CONSEQUENCE_SCORES = _flat(
    "corridor_id BIGINT, corridor_name STRING, timestamp TIMESTAMP_NTZ, "
    "failure_probability_pct DOUBLE, at_risk INT, disco_name STRING, "
    "critical_infra_score INT, economic_loss_per_hr DOUBLE, risk_exposure_naira DOUBLE, "
    "infra_multiplier DOUBLE, risk_score DOUBLE"
)

DISPATCH_QUEUE = _flat(
    "priority BIGINT, corridor_name STRING, failure_probability_pct DOUBLE, "
    "risk_score DOUBLE, economic_loss_per_hr DOUBLE, critical_infra_score INT"
)

THRESHOLD = _flat("threshold DOUBLE")

# Landed payloads, kept as text beside the corridor they were fetched for.
WEATHER_PAYLOAD = (
    "STRUCT<properties: STRUCT<parameter: STRUCT<"
    "T2M: MAP<STRING, DOUBLE>, RH2M: MAP<STRING, DOUBLE>>>>"
)
POI_PAYLOAD = (
    "STRUCT<elements: ARRAY<STRUCT<tags: MAP<STRING, STRING>, lat: DOUBLE, lon: DOUBLE>>>"
)

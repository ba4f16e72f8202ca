"""Names, limits and tables that results depend on.

They are kept together, as plain text in natural order, because changing any
of them changes the numbers every query returns.
"""

# Frequency and voltage limits of the grid code.
NOMINAL_HZ = 50.0
VOLTAGE_FLOOR_330 = 313.5
VOLTAGE_FLOOR_132 = 125.4
CLASS_SPLIT_KV = 200.0
BASE_KV_330 = 330.0
BASE_KV_132 = 132.0

# Missing-value flag in weather payloads.
WEATHER_SENTINEL = -999.0

# Tariff in naira per kWh, and hours per year.
TARIFF = 225.0
HOURS_PER_YEAR = 365 * 24

# Points per facility in the infrastructure score.
INFRA_WEIGHTS = {"hospital": 5, "school": 2, "market": 3}

# Largest bonus the infrastructure score can add to an exposure.
INFRA_BONUS = 0.20

# Decision threshold when no tuned one was saved.
DEFAULT_THRESHOLD = 0.30

# First instant of the out-of-time test period.
TEST_START = "2025-12-01 00:00:00"

# Radius around a corridor point, and mean earth radius, in metres.
POI_RADIUS_M = 20_000
EARTH_RADIUS_M = 6_371_000.0

# Distributor: long name, short name.
NAME_MAP = [
    ("Abuja Electricity Distribution Company", "Abuja"),
    ("Benin Electricity Distribution Company", "Benin"),
    ("Eko Electricity Distribution Company", "Eko"),
    ("Enugu Electricity Distribution Company", "Enugu"),
    ("Ibadan Electricity Distribution Company", "Ibadan"),
    ("Ikeja Electricity Distribution Company", "Ikeja"),
    ("Jos Electricity Distribution Company", "Jos"),
    ("Kaduna Electricity Distribution Company", "Kaduna"),
    ("Kano Electricity Distribution Company", "Kano"),
    ("Port Harcourt Electricity Distribution Company", "Port Harcourt"),
    ("Yola Electricity Distribution Company", "Yola"),
]

# Distributor: least plausible number of hospitals, schools, markets.
INFRA_FLOORS = [
    ("Ikeja", 3, 5, 8),
    ("Eko", 4, 4, 10),
    ("Abuja", 2, 3, 4),
    ("Port Harcourt", 2, 3, 5),
    ("Benin", 1, 2, 3),
    ("Ibadan", 2, 3, 6),
    ("Kano", 2, 3, 8),
    ("Yola", 1, 1, 2),
]

# Corridor: id, name, distributor, latitude, longitude.
CORRIDORS = [
    (1, "Benin-Onitsha 330kV", "Benin", 6.3350, 5.6270),
    (2, "Ikeja-Ota 132kV", "Ikeja", 6.6018, 3.3515),
    (3, "Kano-Kaduna 330kV", "Kano", 11.9964, 8.5167),
    (4, "Egbin-Lagos Island 132kV", "Eko", 6.5244, 3.3792),
    (5, "Shiroro-Gwagwalada 330kV", "Abuja", 9.0765, 7.3986),
    (6, "Jebba-Olorunsogo 330kV", "Ibadan", 8.9167, 4.8333),
    (7, "Afam-Port Harcourt 132kV", "Port Harcourt", 4.8156, 7.0498),
    (8, "Kainji-Birnin Kebbi 330kV", "Abuja", 11.5890, 4.2000),
]

# Known collapses: order, corridor, hour.
FAILURE_EVENTS = [
    (1, 2, "2025-10-15 15:00:00"),
    (2, 3, "2025-11-10 19:00:00"),
    (3, 4, "2025-11-25 14:00:00"),
    (4, 1, "2025-12-29 14:00:00"),
    (5, 5, "2025-10-22 16:00:00"),
    (6, 6, "2025-11-03 20:00:00"),
    (7, 7, "2025-10-28 13:00:00"),
    (8, 8, "2025-11-18 15:00:00"),
]

# Hours to collapse: voltage factor, frequency change, label.
RAMP = [
    (-6, 0.98, -0.05, 0.20),
    (-5, 0.97, -0.08, 0.28),
    (-4, 0.96, -0.12, 0.38),
    (-3, 0.94, -0.18, 0.52),
    (-2, 0.90, -0.25, 0.68),
    (-1, 0.82, -0.40, 0.82),
]

# Collapse hour: voltage factor on the base, frequency, label.
COLLAPSE_FACTOR = 0.70
COLLAPSE_HZ = 48.2
COLLAPSE_LABEL = 1.0

# Corridors under standing stress: voltage factor, frequency change, label.
AMBIENT = [
    (5, 0.965, -0.08, 0.28),
    (6, 0.972, -0.06, 0.25),
    (7, 0.978, -0.10, 0.27),
    (8, 0.968, -0.07, 0.26),
]

# Replay targets: corridor, hour, what to use when that hour is missing.
REPLAY_TARGETS = [
    (1, "2025-12-29 14:00:00", "nearest"),
    (2, "2025-10-15 14:00:00", "nearest"),
    (3, "2025-11-10 15:00:00", "nearest"),
    (4, "2025-11-25 10:00:00", "nearest"),
    (5, "2025-10-22 08:00:00", "calm"),
    (6, "2025-11-03 12:00:00", "calm"),
    (7, "2025-10-28 05:00:00", "calm"),
    (8, "2025-11-18 07:00:00", "calm"),
]

# Model inputs, in the order of the feature vector.
FEATURES = [
    "voltage_kv",
    "frequency_hz",
    "freq_deviation",
    "freq_deviation_abs",
    "voltage_deviation",
    "temperature",
    "humidity",
    "hour_of_day",
    "day_of_week",
    "economic_loss_per_hr",
    "critical_infra_score",
    "volt_lag_1h",
    "volt_lag_2h",
    "volt_roll_avg_3h",
    "freq_lag_1h",
    "freq_lag_3h",
    "freq_roll_avg_6h",
    "freq_volatility_6h",
    "temp_roll_avg_3h",
]
TARGET = "failure_event"

# Crew names by position.
CREWS = ["Alpha", "Beta", "Gamma", "Delta", "Echo", "Zeta", "Eta", "Theta"]

# Values shown when a queue row lacks them.
DEFAULT_NAME = "Unknown"
DEFAULT_LAT = 9.08
DEFAULT_LON = 8.67

# Column names of the exported queue: ours, exported.
QUEUE_COLUMNS = [
    ("priority", "Priority"),
    ("corridor_name", "Corridor"),
    ("failure_probability_pct", "AI Probability (%)"),
    ("risk_score", "Risk Score"),
    ("economic_loss_per_hr", "NGN Loss/hr"),
    ("critical_infra_score", "Critical Infra"),
]

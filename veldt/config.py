"""Parameters of the panel model.

Everything here is a plain value; functions take these as defaults and
accept overrides, so no operator depends on a global.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the application being matched for identical
# results (thresholds, window lengths, catalog, driver specs, text labels).
# ---------------------------------------------------------------------------

THREATS = ["fire", "drought", "vegetation"]
LABEL_COLS = ["fire_within_30d", "drought_within_30d", "vegetation_within_30d"]
PROB_COLS = ["fire_prob", "drought_prob", "veg_prob"]

FEATURE_COLS = [
    "rain_7d", "rain_30d", "rain_60d", "rain_deficit_30d",
    "temp_max_7d", "temp_max_30d", "hot_days_30d",
    "ndvi", "ndvi_30d_lag", "ndvi_change_30d", "ndvi_90d_avg", "ndvi_deviation",
    "fire_30d", "fire_90d", "days_since_fire",
    "doy_sin", "doy_cos", "dry_season", "park_id", "ecosystem_id",
]

CIRCLE_VERTICES = 48
KM_PER_DEGREE_LAT = 110.574
KM_PER_DEGREE_LON = 111.320

FORWARD_DAYS = 30
WARMUP_DAYS = 60
NDVI_FILL_LIMIT = 7
HOT_DAY_C = 35.0
DAYS_SINCE_CAP = 365
DROUGHT_ROLLING = 30
DROUGHT_MIN = 15
DROUGHT_RATIO = 0.40
NDVI_WINDOW = 90
NDVI_MIN = 30
NDVI_THRESHOLD = 0.10
VEG_WINDOW = 14
VEG_MIN = 7
VEG_DAYS_IN_WINDOW = 5
LEAD_THRESHOLD = 0.7
LEAD_WINDOW = 30
DECISION_THRESHOLD = 0.5
BOOTSTRAP_RESAMPLES = 1000
SERVE_HISTORY_DAYS = 90
SERVE_MIN_ROWS = 45
BACKFILL_MIN_ROWS = 7
NDVI_LOOKBACK_DAYS = 16

# rolling (window, min_periods) for the training profile
ROLL_TRAIN = {
    "rain_7d": (7, 4), "rain_30d": (30, 15), "rain_60d": (60, 30),
    "temp_max_7d": (7, 4), "temp_max_30d": (30, 15), "hot_days_30d": (30, 15),
    "ndvi_90d_avg": (90, 30), "fire_30d": (30, 15), "fire_90d": (90, 45),
}

# risk bands (display) and urgency tiers (planning)
RISK_HIGH = 0.66
RISK_MEDIUM = 0.33
URGENCY_TIERS = [(0.85, "critical", 0.40), (0.70, "high", 0.25), (0.50, "moderate", 0.10)]
FLOOR_CAP_SHARE = 0.80
CURRENCY_RATE = 1600

THREAT_TEXT = {"fire": "fire", "drought": "drought", "vegetation": "vegetation degradation"}

INTERVENTION_TYPES = ["patrol", "infrastructure", "water", "vegetation", "community", "survey"]

# id, name, type, cost_usd, max_units, eff_fire, eff_drought, eff_veg  (catalog order matters)
CATALOG_ROWS = [
    ("fire_patrol", "Fire Patrol Unit", "patrol", 500.0, 10, 0.12, 0.00, 0.02),
    ("ranger", "Ranger Deployment", "patrol", 1200.0, 8, 0.10, 0.02, 0.02),
    ("fire_break", "Fire Break Construction", "infrastructure", 2000.0, 5, 0.22, 0.00, 0.04),
    ("water_truck", "Waterhole Maintenance", "water", 800.0, 8, 0.01, 0.18, 0.08),
    ("borehole", "Borehole / Well Repair", "water", 3000.0, 3, 0.00, 0.28, 0.12),
    ("revegetation", "Revegetation Plot", "vegetation", 1500.0, 6, 0.01, 0.04, 0.22),
    ("community", "Community Liaison", "community", 600.0, 5, 0.06, 0.06, 0.04),
    ("aerial_survey", "Aerial / Drone Survey", "survey", 4000.0, 2, 0.08, 0.03, 0.07),
]

# (threat, feature, label, unit, direction)
DRIVER_SPECS = [
    ("fire", "rain_30d", "30-day rainfall", "mm", "low"),
    ("fire", "temp_max_30d", "Avg max temperature", "degC", "high"),
    ("fire", "days_since_fire", "Days since last fire", "days", "low"),
    ("fire", "dry_season", "Dry season", "bool", "high"),
    ("drought", "rain_30d", "30-day rainfall", "mm", "low"),
    ("drought", "rain_deficit_30d", "Rainfall deficit (30d)", "mm", "lowval"),
    ("drought", "rain_60d", "60-day rainfall", "mm", "low"),
    ("drought", "dry_season", "Dry season", "bool", "high"),
    ("vegetation", "ndvi", "Vegetation index (NDVI)", "ndvi", "low"),
    ("vegetation", "ndvi_deviation", "NDVI vs 90-day normal", "ndvi", "lowval"),
    ("vegetation", "ndvi_change_30d", "NDVI change (30d)", "ndvi", "lowval"),
    ("vegetation", "rain_30d", "30-day rainfall", "mm", "low"),
]
DRIVER_THRESHOLDS = {"rain_30d": 20.0, "rain_60d": 50.0, "temp_max_30d": 34.0, "days_since_fire": 30.0}

# ---------------------------------------------------------------------------
# Mapping of the generic panel onto the driver's TPC-H-style tables.
# entity = nation, ecosystem = region, zone = customer market segment.
# ---------------------------------------------------------------------------
DRY_MONTHS = [11, 12, 1, 2, 3]
TRAIN_END = "1999-06-30"
VAL_START = "1999-07-01"
VAL_END = "1999-12-31"
TEST_START = "2000-01-01"

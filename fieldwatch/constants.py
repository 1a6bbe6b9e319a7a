"""Fixed values. Every number, list and label here must equal the published behaviour."""

# --- gaps, windows, hysteresis ------------------------------------------------------
READING_GAP_SECONDS = 125
ALARM_GAP_SECONDS = 120
ROLLING_WINDOWS = {"short": (12, 6), "medium": (36, 18), "long": (78, 39)}
HYSTERESIS_MARGIN = {"temperature": 0.5, "humidity": 2.0}
HYSTERESIS_EXIT_ROWS = 5
TUKEY_FACTORS = {"mild": 0.5, "strong": 1.0, "extreme": 1.5}
STREAM_BUFFER = 100
STREAM_MIN_ROWS = 39

STATE_FEATURES = [
    "temperature", "humidity",
    "temperature_mean_short", "temperature_mean_medium", "temperature_mean_long",
    "humidity_mean_short", "humidity_mean_medium", "humidity_mean_long",
    "temperature_std_short", "humidity_std_short",
    "temperature_short_long", "humidity_short_long",
    "temperature_change_1", "humidity_change_1",
    "temperature_change_5", "humidity_change_5",
    "freshness_short", "freshness_medium", "freshness_long",
]
HMM_STATE_COUNTS = [2, 3, 4, 5, 6]
HMM_CUTOFFS = [0.05, 0.10, 0.20, 0.30]
HMM_SEEDS = [0, 7, 21, 42, 99]
HMM_ITERATIONS = 500
HMM_TOLERANCE = 1e-4
HMM_MIN_STATE_ROWS = 20

# --- plausible sensor ranges --------------------------------------------------------
PLAUSIBLE = {"temperature": (5.0, 60.0), "humidity": (15.0, 100.0)}

# --- alarm keyword lists ------------------------------------------------------------
CATEGORY_KEYWORDS = {
    "UPS": ["UPS", "SOCOMEC", "BATTERY"],
    "CLIM": ["CLIM", "STULZ", "LIEBERT", "TEMPERATURE"],
    "ENERGY": ["TENSION", "GROUPE ELECTROGENE", "ELECTROGENE"],
}
EVENT_KEYWORDS = {
    "ups": ["UPS", "SOCOMEC", "BATTERY", "RECTIFIER", "BYPASS", "INVERTER"],
    "generator": ["GROUPE", "DEMARRAGE", "ABSENCE TENSION"],
    "temperature": ["TEMPERATURE"],
}
FLAG_KEYWORDS = {
    "is_outage": [
        "absence de tension", "absence tension", "power failure", "mains failure",
        "utility failure", "coupure", "perte secteur",
    ],
    "is_supply_event": [
        "rectifier", "redresseur", "bypass", "input voltage", "supply fault",
        "alimentation", "tension reseau", "tension réseau",
    ],
    "is_generator_event": [
        "generator", "groupe electrogene", "groupe électrogène", "genset", "diesel",
    ],
    "is_backup_transfer": ["transfer", "ats", "basculement", "backup supply", "secours"],
    "is_check_battery": [
        "check battery", "battery test", "replace battery", "battery fault",
        "battery general alarm", "ups unit 1 general alarm", "ups unit 2 general alarm",
        "batterie à vérifier", "verifier batterie", "vérifier batterie",
        "défaut batterie", "defaut batterie",
    ],
    "is_battery_discharge": [
        "battery discharge", "discharging", "operating on battery", "on battery",
        "décharge batterie", "decharge batterie", "sur batterie",
    ],
    "is_low_battery": [
        "low battery", "battery low", "low capacity", "battery capacity",
        "batterie faible", "faible autonomie",
    ],
    "is_battery_chatter": [
        "battery connect", "battery disconnect", "battery connected",
        "battery disconnected", "connexion batterie", "déconnexion batterie",
        "deconnexion batterie",
    ],
}
ENERGY_FLAGS = {
    "is_outage": "outage", "is_supply_event": "supply",
    "is_generator_event": "generator", "is_backup_transfer": "transfer",
}
BATTERY_FLAGS = {
    "is_check_battery": "check_battery", "is_battery_discharge": "discharge",
    "is_low_battery": "low_battery", "is_battery_chatter": "chatter",
}

# --- weights and multipliers --------------------------------------------------------
WEIGHTS = {
    "environmental": {
        "temp_term": 0.40, "humidity_term": 0.25,
        "temp_change_term": 0.20, "humidity_change_term": 0.15,
    },
    "energy": {
        "outage_term": 0.35, "supply_term": 0.20, "generator_term": 0.15,
        "transfer_term": 0.15, "persistence_term": 0.15,
    },
    "battery": {
        "check_battery_component": 0.20, "discharge_component": 0.20,
        "low_battery_component": 0.15, "chatter_component": 0.10,
        "recurrence_component": 0.10, "persistence_component": 0.25,
    },
    "overall": {"environmental": 0.30, "energy": 0.35, "battery": 0.35},
}
MULTIPLIERS = {"environmental": (0.50, 0.30), "energy": (0.50, 0.35), "battery": (0.50, 0.50)}
PM_DEFAULTS = {
    "environmental": ("2026-03-01", 90), "energy": ("2022-12-13", 180), "battery": (None, 90),
}
HALF_LIFE_HOURS = 8
DURATION_SCALE_HOURS = 6
ENERGY_COMPRESSION = 60.0
ENERGY_FLOOR = 85.0
WEIGHT_VERSION = "v1.0"
SCORE_VERSION = "health_score_v1.0"

STATUS_LEVELS = [
    (40, "Critical", "P1 - Immediate"), (60, "High Risk", "P2 - Urgent"),
    (75, "Warning", "P3 - Investigate"), (90, "Minor Degradation", "P4 - Monitor"),
]
STATUS_TOP = ("Healthy", "P5 - Routine")
TREND_POINTS = (5.0, 15.0)
HEALTHY_MIN, WATCH_MIN = 90.0, 60.0

# --- forecast feature lists ---------------------------------------------------------
HORIZON_ROWS = 6
HEALTH_LAGS = [1, 2, 3, 6, 12, 24, 48, 72, 168]
HEALTH_WINDOWS = [6, 12, 24, 72, 168]
SUBSYSTEM_LAGS = [1, 6, 12, 24]
HEALTH_CHANGES = [1, 3, 6, 12, 24]
TRAJECTORY_LAGS = [1, 2, 3, 6, 12, 24, 48]
TRAJECTORY_CHANGES = [1, 2, 3, 6, 12, 24]
TRAJECTORY_RATES = [3, 6, 12, 24]
TRAJECTORY_WINDOWS = [3, 6, 12, 24]
TRAJECTORY_SLOPES = [3, 6, 12, 24]
TRAJECTORY_ACCELERATIONS = [1, 3, 6]
MAJOR_DROP, SEVERE_DROP = -10.0, -20.0
HIGH_RISK_BELOW = 60.0
SUBSYSTEM_HEALTH = [
    "environmental_health_score", "energy_health_score", "battery_health_score",
]
SUBSYSTEM_RISK = ["environmental_risk_score", "energy_risk_score", "battery_risk_score"]
TRAJECTORY_SOURCES = [
    "overall_site_health", "environmental_health_score", "energy_health_score",
    "battery_health_score", "environmental_risk_score", "energy_risk_score",
    "energy_risk_score_calibrated", "battery_risk_score", "environmental_base_risk",
    "energy_base_risk", "battery_base_risk", "environmental_anomaly_burden",
    "energy_anomaly_burden", "battery_anomaly_burden", "environmental_pm_risk",
    "energy_pm_risk", "battery_pm_risk", "temperature", "humidity", "outage_duration_hours",
    "battery_alarm_duration_hours", "overall_site_health_volatility_24h",
    "overall_site_health_trend_24h",
]
CURRENT_FEATURES = [
    "overall_site_health", "environmental_health_score", "energy_health_score",
    "battery_health_score", "environmental_risk_score", "energy_risk_score",
    "battery_risk_score", "environmental_base_risk", "energy_base_risk", "battery_base_risk",
    "environmental_pm_risk", "energy_pm_risk", "battery_pm_risk",
    "environmental_anomaly_burden", "energy_anomaly_burden", "battery_anomaly_burden",
    "overall_site_health_trend_24h", "overall_site_health_volatility_24h",
    "overall_site_health_smoothed_6h", "battery_alarm_duration_hours",
    "outage_duration_hours", "temperature", "humidity", "score_confidence",
]
REQUIRED_FEATURES = [
    "overall_site_health", "overall_health_lag_1h", "overall_health_lag_6h",
    "overall_health_lag_24h",
]
FEATURE_COUNTS = [20, 50, 100, 200]
MIN_TRAINING_ROWS = 200
DROP_WEIGHTS = [(-5.0, 1.25), (-10.0, 1.75), (-20.0, 2.50)]
DROP_THRESHOLDS = [0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50,
                   0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90]
DAMPING = 0.5
# horizon: forecast hours, display step in hours, history points
HORIZONS = {"24h": (24, 1, 24), "7d": (168, 6, 28), "30d": (720, 24, 30)}

# --- alarm outlier model ------------------------------------------------------------
EVENT_FEATURES = [
    "duration_sec", "total_alarms", "unique_alarm_types", "active_alarms", "cleared_alarms",
    "alarm_rate", "alarm_diversity", "repetition_factor", "active_ratio", "hour",
]
FOREST_TREES = 300
FOREST_CONTAMINATION = 0.03
FOREST_SAMPLE = 256
FOREST_SEED = 42

# --- episodes, reminders ------------------------------------------------------------
SEVERITIES = ["alert", "critical"]
DIRECTIONS = ["high", "low"]
STATUSES = ["open", "acknowledged", "resolved"]
RESOLVED_AFTER_HOURS, ACKNOWLEDGED_AFTER_HOURS = 72, 24
MIN_EPISODE_MINUTES = 2.0
PM_REMINDER_DAYS = 14
SNOOZE_MAX_HOURS = 720

"""Fixed values that must equal the reference behaviour for right results.

Everything in this module is a fixed value (names, thresholds, weights,
lookup tables).  They are listed plainly, in their natural order.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — API universe and lookups
# ---------------------------------------------------------------------------
ALL_APIS = [
    "stock_price_api",
    "forex_api",
    "crypto_api",
    "market_data_api",
    "transaction_api",
]

SIMILAR_API = {
    "stock_price_api": "forex_api",
    "forex_api": "stock_price_api",
    "crypto_api": "market_data_api",
    "market_data_api": "crypto_api",
    "transaction_api": "market_data_api",
}

BACKUP_API = {
    "stock_price_api": "market_data_api",
    "crypto_api": "market_data_api",
    "forex_api": "market_data_api",
    "market_data_api": "transaction_api",
    "transaction_api": "market_data_api",
}

# batch60 profile complexity (generator / first integration)
API_COMPLEXITY = {
    "stock_price_api": 1.0,
    "forex_api": 1.1,
    "crypto_api": 1.3,
    "market_data_api": 1.2,
    "transaction_api": 1.15,
}

# batch20 profile (second integration)
API_COMPLEXITY_BATCH20 = {
    "market_data_api": 0.7,
    "crypto_api": 0.9,
    "transaction_api": 0.8,
    "forex_api": 0.6,
    "stock_price_api": 0.4,
}
HIGH_FREQ_BATCH20 = ["market_data_api", "crypto_api", "stock_price_api"]

# Default failure type per API when a failure row has none
DEFAULT_FAILURE_TYPE = {
    "transaction_api": "cascading_failure",
    "market_data_api": "vendor_upstream_failure",
    "stock_price_api": "market_volatility_overload",
    "crypto_api": "market_volatility_overload",
    "forex_api": "regulatory_load_spike",
}

# ---------------------------------------------------------------------------
# FIXED VALUES — the 43 model features (status_code excluded on purpose)
# ---------------------------------------------------------------------------
FEATURE_COLS = [
    "response_time", "request_count",
    "hour", "day_of_week", "is_market_hours", "is_financial_peak",
    "is_weekend", "is_holiday",
    "response_time_rolling_mean", "response_time_rolling_std",
    "error_rate_rolling", "response_time_variance", "error_volatility",
    "response_time_lag_1", "response_time_lag_5", "error_rate_lag_1",
    "response_time_ema_10", "response_time_ema_30", "error_rate_ema_10",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos",
    "high_frequency_api", "api_complexity",
    "error_rate_boost", "rt_multiplier",
    "latency_diff_1", "latency_diff_5",
    "error_rate_diff_1", "error_rate_diff_5",
    "latency_spike", "error_burst", "instability_index",
    "latency_slope", "error_slope",
    "traffic_change", "burst_ratio",
    "avg_error_rate_others", "max_error_rate_others",
    "n_apis_elevated", "corr_with_similar_api",
    "systemic_stress_index",
]

CROSS_API_FEATURES = [
    "avg_error_rate_others",
    "max_error_rate_others",
    "n_apis_elevated",
    "corr_with_similar_api",
    "systemic_stress_index",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — event calendars (label, start, end, error_rate_boost, rt_mult)
# ---------------------------------------------------------------------------
GLOBAL_EVENTS = [
    ("market_crash", "2023-03-10", "2023-03-15", 0.45, 2.8),
    ("market_crash", "2023-08-02", "2023-08-05", 0.38, 2.4),
    ("market_crash", "2024-04-19", "2024-04-22", 0.42, 2.6),
    ("flash_crash", "2023-05-24", "2023-05-24", 0.70, 4.5),
    ("flash_crash", "2023-11-08", "2023-11-08", 0.65, 4.0),
    ("flash_crash", "2024-07-15", "2024-07-15", 0.72, 5.0),
    ("quarter_end", "2023-03-29", "2023-03-31", 0.22, 1.8),
    ("quarter_end", "2023-06-28", "2023-06-30", 0.20, 1.7),
    ("quarter_end", "2023-09-27", "2023-09-29", 0.21, 1.75),
    ("quarter_end", "2023-12-27", "2023-12-29", 0.23, 1.9),
    ("quarter_end", "2024-03-27", "2024-03-29", 0.22, 1.8),
    ("quarter_end", "2024-06-26", "2024-06-28", 0.20, 1.7),
    ("quarter_end", "2024-09-25", "2024-09-27", 0.21, 1.75),
    ("quarter_end", "2024-12-27", "2024-12-31", 0.24, 1.9),
    ("ddos_attack", "2023-07-04", "2023-07-05", 0.60, 3.5),
    ("ddos_attack", "2024-02-14", "2024-02-15", 0.55, 3.2),
    ("ddos_attack", "2024-10-31", "2024-11-01", 0.65, 4.0),
    ("vendor_outage", "2023-04-18", "2023-04-19", 0.80, 5.0),
    ("vendor_outage", "2023-10-03", "2023-10-04", 0.75, 4.5),
    ("vendor_outage", "2024-01-22", "2024-01-23", 0.82, 5.5),
    ("vendor_outage", "2024-08-07", "2024-08-08", 0.78, 5.0),
]

API_SPECIFIC_EVENTS = {
    "stock_price_api": [
        ("deprecated_endpoint", "2023-06-01", "2023-06-30", 0.15, 1.2),
        ("bad_url", "2023-09-15", "2023-09-16", 0.50, 1.5),
        ("permission_error", "2024-03-01", "2024-03-03", 0.35, 1.3),
    ],
    "forex_api": [
        ("session_expiry", "2023-05-10", "2023-05-12", 0.40, 1.6),
        ("token_expiry", "2023-11-20", "2023-11-21", 0.45, 1.4),
        ("public_ip_exposure", "2024-06-10", "2024-06-11", 0.30, 1.2),
    ],
    "crypto_api": [
        ("dependency_failure", "2023-02-15", "2023-02-17", 0.55, 2.0),
        ("complex_endpoint", "2023-08-22", "2023-08-24", 0.25, 2.5),
        ("monitoring_gap", "2024-05-05", "2024-05-07", 0.20, 1.3),
    ],
    "market_data_api": [
        ("poor_documentation", "2023-03-01", "2023-04-01", 0.12, 1.1),
        ("insufficient_testing", "2023-07-17", "2023-07-19", 0.30, 1.4),
        ("outdated_url", "2024-02-28", "2024-03-01", 0.45, 1.5),
    ],
    "transaction_api": [
        ("invalid_session", "2023-04-05", "2023-04-06", 0.50, 1.8),
        ("unsecured_endpoint", "2023-12-01", "2023-12-03", 0.35, 1.3),
        ("dependency_failure", "2024-09-10", "2024-09-12", 0.60, 2.2),
    ],
}

HOLIDAYS = [
    "2023-01-02", "2023-04-07", "2023-04-10", "2023-05-01", "2023-05-29",
    "2023-08-28", "2023-11-23", "2023-12-25", "2023-12-26",
    "2024-01-01", "2024-03-29", "2024-04-01", "2024-05-06", "2024-05-27",
    "2024-08-26", "2024-11-28", "2024-12-25", "2024-12-26",
]

# Event label -> error type label
ERROR_LABELS = {
    "market_crash": "market_volatility_overload",
    "flash_crash": "flash_crash_timeout",
    "quarter_end": "regulatory_load_spike",
    "ddos_attack": "ddos_rate_limit_exceeded",
    "vendor_outage": "vendor_upstream_failure",
    "deprecated_endpoint": "410_endpoint_deprecated",
    "bad_url": "404_bad_or_outdated_url",
    "permission_error": "403_incorrect_api_permission",
    "session_expiry": "401_invalid_session",
    "token_expiry": "401_token_expired",
    "public_ip_exposure": "security_misconfiguration",
    "dependency_failure": "503_external_dependency_down",
    "complex_endpoint": "504_complex_endpoint_timeout",
    "monitoring_gap": "silent_failure_no_alert",
    "poor_documentation": "400_malformed_request",
    "insufficient_testing": "500_untested_code_path",
    "outdated_url": "404_outdated_url",
    "invalid_session": "401_invalid_session_token",
    "unsecured_endpoint": "security_breach_attempt",
}

# HTTP status -> error type (exact codes; ranges handled in the function)
HTTP_ERROR_TYPES = [
    (400, "400_malformed_request"),
    (401, "401_unauthorized"),
    (403, "403_incorrect_api_permission"),
    (404, "404_bad_or_outdated_url"),
    (408, "408_request_timeout"),
    (429, "ddos_rate_limit_exceeded"),
    (500, "500_internal_server_error"),
    (502, "502_bad_gateway"),
    (503, "503_external_dependency_down"),
    (504, "504_complex_endpoint_timeout"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — surrogate forecast
# ---------------------------------------------------------------------------
SURROGATE_BASE = 0.1388
SURROGATE_QHAT = {1: 0.5195, 5: 0.5207, 15: 0.5258}
SURROGATE_HSCALE = {1: 1.0, 5: 1.12, 15: 1.25}
SURROGATE_SHRINK = {1: 1.0, 5: 0.86, 15: 0.72}
SURROGATE_HI, SURROGATE_LO = 0.55, 0.35
SURROGATE_API_BIAS = {
    "transaction_api": 0.00,
    "market_data_api": 0.10,
    "stock_price_api": -0.10,
    "crypto_api": 0.40,
    "forex_api": 0.20,
}
SURROGATE_W = {"err": 9.0, "rt": 0.55, "vol": 1.6, "recent": 0.18, "load": 0.45, "b0": -2.72}

# ---------------------------------------------------------------------------
# FIXED VALUES — diagnosis thresholds and remedies
# ---------------------------------------------------------------------------
DIAG = {
    "systemic_stress_hi": 0.6,
    "n_apis_elevated": 2,
    "burst_ratio_hi": 2.0,
    "traffic_change_hi": 1.5,
    "rt_multiplier_hi": 2.0,
    "latency_spike_hi": 1.0,
    "error_burst_hi": 1.0,
    "error_boost_hi": 0.5,
}

DIAG_TEXT = {
    "cascade": "Multiple APIs are degrading simultaneously — systemic upstream stress.",
    "overload": "Traffic burst exceeded endpoint capacity — request surge detected.",
    "timeout": "Response latency spike — endpoint is slow to respond.",
    "error_surge": "Error rate burst — endpoint is returning errors at elevated rate.",
    "intermittent": "Unstable signal without dominant cause — likely transient fault.",
}

# category -> (action, recovery_ticks, risk_reduction_per_tick)
REMEDIES = [
    ("timeout", "backoff", 4, 0.12),
    ("error_surge", "circuit_break", 6, 0.09),
    ("overload", "throttle", 5, 0.10),
    ("cascade", "isolate_dependency", 8, 0.08),
    ("intermittent", "retry_jitter", 3, 0.15),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — policy back-test
# ---------------------------------------------------------------------------
COST_PER_FAILURE = 50.0
TRANSACTIONS_PER_YEAR = 260_000
HIGH_RISK = 0.65
LOW_RISK = 0.35
LATENCY_NORMAL = 0.12
LATENCY_RETRY = 0.28
LATENCY_SWITCH = 0.45
REACTIVE_BACKUP_FAIL = 0.04

# ---------------------------------------------------------------------------
# FIXED VALUES — audit / self-improvement thresholds
# ---------------------------------------------------------------------------
AUDIT_SOURCE_LOW_PCT = 5.0
AUDIT_SOURCE_HIGH_PCT = 40.0
AUDIT_COVERAGE_PCT = 30.0
AUDIT_DOMINANT_MODE_PCT = 50.0
AUDIT_FAILURE_MIN_PCT = 5.0
AUDIT_KEY_FEATURES = [
    "error_rate_boost", "rt_multiplier",
    "latency_spike", "error_burst",
    "instability_index", "error_rate_rolling",
]

DRIFT_FEATURES = [
    "error_rate_rolling", "response_time_rolling_mean",
    "rt_multiplier", "error_rate_boost", "error_volatility",
]
JITTER_COLS = [
    "response_time", "response_time_rolling_mean", "response_time_rolling_std",
    "error_rate_rolling", "response_time_variance", "error_volatility",
    "response_time_lag_1", "response_time_lag_5", "error_rate_lag_1",
    "response_time_ema_10", "response_time_ema_30", "error_rate_ema_10",
    "error_rate_boost", "rt_multiplier",
]
TARGET_FAILURE_RATE = 0.13
OVERSAMPLE_FACTOR = 5
DRIFT_WINDOW_FRACTION = 0.65
MAX_AUGMENTATION_FRACTION = 0.10
KS_THRESHOLD = 0.10
KS_P_THRESHOLD = 0.05
DRIFT_MIN_FEATURES = 2
AUC_FLOOR = 0.70
RECALL_FLOOR = 0.35
IMBALANCE_FLOOR = 0.05

# ---------------------------------------------------------------------------
# FIXED VALUES — live-path controls
# ---------------------------------------------------------------------------
BREAKER_FAILS = 3
BREAKER_PROBE_SECONDS = 15
CANARY_STEPS = [0.10, 0.50, 1.00]
CANARY_HOLD_SECONDS = 10
SCORE_EVERY = 10
ROUTE_HI, ROUTE_LO, ROUTE_COOLDOWN = 0.55, 0.35, 3

EPS = 1e-6

# ---------------------------------------------------------------------------
# FIXED VALUES — online collector: API flags (high frequency, complexity),
# holidays as (month, day), health windows
# ---------------------------------------------------------------------------
ONLINE_FLAGS = {
    "transaction_api": (0.0, 0.8),
    "stock_price_api": (1.0, 0.5),
    "crypto_api": (1.0, 0.6),
    "forex_api": (1.0, 0.5),
    "market_data_api": (0.5, 0.6),
}
ONLINE_HOLIDAYS = [(1, 1), (1, 19), (2, 16), (5, 25), (6, 19), (7, 4), (9, 7), (11, 26), (12, 25)]
ONLINE_MIN_RECORDS = 30
HEALTH_WINDOWS = (50, 100, 200)

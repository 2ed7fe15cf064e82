"""Canonical inputs derived from the shared test tables.

``telemetry()`` maps ``events`` onto the canonical telemetry schema
(timestamp, api_name, response_time, status_code, success, error_type,
request_count, data_source, event_id).  ``transfers()``/``accounts()`` map the
order/customer tables onto the ledger.  Each has a DuckDB twin used by the
oracle SQL, kept next to it so both stay in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import scalars as S
from faultline.session import sf_path

# FIXED VALUES — fixture mapping of event types to APIs and failure statuses
EVENT_API = {
    "view": "market_data_api",
    "click": "stock_price_api",
    "purchase": "transaction_api",
    "signup": "forex_api",
    "error": "crypto_api",
}
FAIL_STATUSES = [429, 503, 500, 403, 404, 504, 401]
FAIL_K = 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(sf_path(sf_dir, name))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    api_map = F.create_map(*[F.lit(x) for kv in EVENT_API.items() for x in kv])
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(k < FAIL_K, F.element_at(F.array(*[F.lit(s) for s in FAIL_STATUSES]),
                                             (k % 7) + 1)).otherwise(F.lit(200))
    base = ev.select(
        F.col("event_id"),
        F.col("ts").alias("timestamp"),
        F.element_at(api_map, F.col("event_type")).alias("api_name"),
        F.col("value").alias("response_time"),
        status.alias("status_code"),
        F.when(k < FAIL_K, 0).otherwise(1).alias("success"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise(
            S.http_error_type(status)).alias("error_type"),
        (F.lit(1) + k).alias("request_count"),
        F.when(F.col("user_id") % 2 == 0, "synthetic").otherwise("db_extended").alias("data_source"),
        F.col("user_id"),
    )
    return base


def _http_error_type_sql(s: str) -> str:
    from faultline import constants as C
    parts = [f"WHEN {s} < 400 THEN NULL"]
    parts += [f"WHEN {s} = {code} THEN '{label}'" for code, label in C.HTTP_ERROR_TYPES]
    parts += [f"WHEN {s} < 500 THEN CAST({s} AS VARCHAR) || '_client_error'",
              f"ELSE CAST({s} AS VARCHAR) || '_server_error'"]
    return "CASE " + " ".join(parts) + " END"


def telemetry_sql() -> str:
    """DuckDB CTE body equivalent to :func:`telemetry` (view name ``telemetry``)."""
    api_case = "CASE event_type " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_API.items()) + " END"
    statuses = ", ".join(str(s) for s in FAIL_STATUSES)
    status = f"CASE WHEN k < {FAIL_K} THEN [{statuses}][(k % 7) + 1] ELSE 200 END"
    return f"""
telemetry_raw AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events
),
telemetry_s AS (
  SELECT *, {status} AS status_code FROM telemetry_raw
),
telemetry AS (
  SELECT event_id, ts AS "timestamp", {api_case} AS api_name,
         value AS response_time, status_code,
         CASE WHEN k < {FAIL_K} THEN 0 ELSE 1 END AS success,
         CASE WHEN k % 5 = 0 THEN NULL ELSE {_http_error_type_sql('status_code')} END AS error_type,
         1 + k AS request_count,
         CASE WHEN user_id % 2 = 0 THEN 'synthetic' ELSE 'db_extended' END AS data_source,
         user_id
  FROM telemetry_s
)"""


# --- ledger fixtures ---------------------------------------------------------------
def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("account_id"),
        (F.col("c_acctbal").cast("decimal(18,2)") + F.lit(1000000).cast("decimal(18,2)"))
        .cast("decimal(18,2)").alias("opening_balance"),
    )


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfer requests: one per order (region 'a') plus a replay under region
    'b' of every tenth order, carrying the same idempotency key."""
    o = table(spark, sf_dir, "orders")
    n_cust = table(spark, sf_dir, "customer").select(F.count(F.lit(1))).scalar()
    req = o.select(
        F.col("o_orderkey").alias("txn_id"),
        F.concat(F.lit("k-"), F.col("o_orderkey").cast("string")).alias("idempotency_key"),
        F.col("o_custkey").alias("account_from"),
        ((F.col("o_custkey") + 1) % n_cust).alias("account_to"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.col("o_orderdate").alias("created_at"),
        F.lit("a").alias("region"),
    )
    dup = req.filter(F.col("txn_id") % 10 == 0).withColumn("region", F.lit("b"))
    return req.unionByName(dup)


def ledger_sql() -> str:
    """DuckDB CTEs ``accounts`` and ``transfers`` matching the functions above."""
    return """
accounts AS (
  SELECT c_custkey AS account_id,
         CAST(CAST(c_acctbal AS DECIMAL(18,2)) + CAST(1000000 AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS opening_balance
  FROM customer
),
transfers_a AS (
  SELECT o_orderkey AS txn_id, 'k-' || CAST(o_orderkey AS VARCHAR) AS idempotency_key,
         o_custkey AS account_from,
         (o_custkey + 1) % (SELECT count(*) FROM customer) AS account_to,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderdate AS created_at, 'a' AS region
  FROM orders
),
transfers AS (
  SELECT * FROM transfers_a
  UNION ALL
  SELECT txn_id, idempotency_key, account_from, account_to, amount, created_at, 'b' AS region
  FROM transfers_a WHERE txn_id % 10 = 0
)"""


# --- event calendars for the January-2024 fixture -------------------------------------
# Test fixture (not reference data): six global intervals inside the events'
# date range, overlapping on purpose so that "last match wins" is exercised,
# and one one-day event that only matches midnight.
FIXTURE_GLOBAL_EVENTS = [
    ("market_crash", "2024-01-03", "2024-01-06", 0.45, 2.8),
    ("quarter_end", "2024-01-05", "2024-01-09", 0.22, 1.8),
    ("flash_crash", "2024-01-12", "2024-01-12", 0.70, 4.5),
    ("ddos_attack", "2024-01-15", "2024-01-17", 0.60, 3.5),
    ("vendor_outage", "2024-01-16", "2024-01-20", 0.80, 5.0),
    ("vendor_outage", "2024-01-22", "2024-01-23", 0.82, 5.5),
]
FIXTURE_API_EVENTS = {
    "crypto_api": [("dependency_failure", "2024-01-10", "2024-01-14", 0.55, 2.0)],
    "stock_price_api": [("bad_url", "2024-01-04", "2024-01-05", 0.50, 1.5)],
}


def tagged_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry + combined global/API event tags (JN-04/05)."""
    from faultline.operators.joins import combine_event_tags
    return combine_event_tags(telemetry(spark, sf_dir), FIXTURE_GLOBAL_EVENTS, FIXTURE_API_EVENTS)


def _event_case_sql(ts: str, events, idx: int, default) -> str:
    if not events:
        return repr(default) if not isinstance(default, str) else f"'{default}'"
    lit = (lambda v: f"'{v}'" if isinstance(v, str) else repr(float(v)))
    parts = [f"WHEN {ts} >= TIMESTAMP '{e[1]}' AND {ts} <= TIMESTAMP '{e[2]}' THEN {lit(e[idx])}"
             for e in reversed(events)]
    return "CASE " + " ".join(parts) + f" ELSE {lit(default)} END"


def tagged_telemetry_sql() -> str:
    """CTEs ending in ``tagged`` (telemetry + event_label/boost/rt_multiplier)."""
    g_lab = _event_case_sql('"timestamp"', FIXTURE_GLOBAL_EVENTS, 0, "normal")
    g_b = _event_case_sql('"timestamp"', FIXTURE_GLOBAL_EVENTS, 3, 0.0)
    g_m = _event_case_sql('"timestamp"', FIXTURE_GLOBAL_EVENTS, 4, 1.0)

    def per_api(idx, default):
        lit = (lambda v: f"'{v}'" if isinstance(v, str) else repr(float(v)))
        parts = [f"WHEN api_name = '{a}' THEN {_event_case_sql(chr(34) + 'timestamp' + chr(34), ev, idx, default)}"
                 for a, ev in FIXTURE_API_EVENTS.items()]
        return "CASE " + " ".join(parts) + f" ELSE {lit(default)} END"
    return telemetry_sql() + f""",
tagged0 AS (
  SELECT *, {g_lab} AS g_label, {g_b} AS g_boost, {g_m} AS g_mult,
         {per_api(0, 'normal')} AS a_label, {per_api(3, 0.0)} AS a_boost, {per_api(4, 1.0)} AS a_mult
  FROM telemetry
),
tagged AS (
  SELECT event_id, "timestamp", api_name, response_time, status_code, success, error_type,
         request_count, data_source, user_id,
         CASE WHEN a_label <> 'normal' THEN a_label ELSE g_label END AS event_label,
         greatest(g_boost, a_boost) AS error_rate_boost,
         greatest(g_mult, a_mult) AS rt_multiplier
  FROM tagged0
)"""

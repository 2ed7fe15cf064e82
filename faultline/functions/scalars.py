"""Scalar Column functions (SCL-*).  All are Catalyst expressions — no UDFs —
so they stay inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import constants as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- SCL-01 / SCL-02: calendar ------------------------------------------------
def day_of_week(ts) -> Column:
    """Monday=0 .. Sunday=6 (pandas ``dayofweek``)."""
    return F.weekday(_c(ts))


def calendar_features(ts="timestamp", holiday=None, profile: str = "batch60") -> dict[str, Column]:
    """Hour/day flags per feature profile.  ``holiday`` is a 0/1 Column."""
    t = _c(ts)
    hour = F.hour(t)
    dow = day_of_week(t)
    weekend = (dow >= 5).cast("int")
    hol = F.coalesce(holiday, F.lit(0)) if holiday is not None else F.lit(0)
    low = (weekend == 1) | (hol == 1)
    if profile == "batch20":
        market = ((hour >= 9) & (hour <= 17) & (weekend == 0)).cast("int")
        peak = hour.isin(9, 10, 14, 15).cast("int")
    elif profile == "online21":
        market = ((hour >= 9) & (hour < 17)).cast("int")
        peak = (((hour >= 9) & (hour < 10)) | ((hour >= 14) & (hour < 15))).cast("int")
    else:
        market = ((hour >= 9) & (hour <= 16) & ~low).cast("int")
        peak = market
    return {
        "hour": hour,
        "day_of_week": dow,
        "is_weekend": weekend,
        "is_holiday": hol.cast("int"),
        "is_market_hours": market,
        "is_financial_peak": peak,
        "is_pre_open": ((hour >= 7) & (hour < 9)).cast("int"),
        "is_market_close": ((hour >= 16) & (hour <= 18)).cast("int"),
    }


# --- SCL-03 ---------------------------------------------------------------------
def cyclical(col, period: int, fn: str = "sin") -> Column:
    angle = F.lit(2 * math.pi) * _c(col) / F.lit(float(period))
    return F.sin(angle) if fn == "sin" else F.cos(angle)


# --- SCL-04 ---------------------------------------------------------------------
def floor_minute(ts) -> Column:
    return F.date_trunc("minute", _c(ts))


def parse_ts(col) -> Column:
    """Parse with coercion: unparsable -> NULL."""
    return F.try_to_timestamp(_c(col))


# --- SCL-05 ---------------------------------------------------------------------
def clip(col, lo=None, hi=None) -> Column:
    out = _c(col)
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return out


def safe_div(a, b, eps: float = C.EPS) -> Column:
    return _c(a) / (_c(b) + F.lit(eps))


# --- SCL-06 ---------------------------------------------------------------------
def sigmoid(col) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(col)))


def logit(col, eps: float = 1e-7) -> Column:
    p = clip(col, eps, 1 - eps)
    return F.log(p / (F.lit(1.0) - p))


# --- SCL-07 / SCL-08 / SCL-10 ------------------------------------------------------
def http_error_type(status) -> Column:
    s = _c(status)
    expr = F.when(s < 400, F.lit(None).cast("string"))
    for code, label in C.HTTP_ERROR_TYPES:
        expr = expr.when(s == code, F.lit(label))
    expr = expr.when(s < 500, F.concat(s.cast("string"), F.lit("_client_error")))
    return expr.otherwise(F.concat(s.cast("string"), F.lit("_server_error")))


def http_event_label(status) -> Column:
    s = _c(status)
    return (F.when(s < 400, "normal")
            .when(s == 429, "ddos_attack")
            .when(s.isin(401, 403), "permission_error")
            .when(s == 404, "bad_url")
            .when(s >= 500, "vendor_outage")
            .otherwise("normal"))


def is_success(status, limit: int = 400) -> Column:
    return (_c(status) < limit).cast("int")


def event_error_label(event_label) -> Column:
    """SCL-09: event label -> error label (``normal`` -> NULL)."""
    m = F.create_map(*[F.lit(x) for kv in C.ERROR_LABELS.items() for x in kv])
    e = _c(event_label)
    return F.when(e == "normal", F.lit(None).cast("string")).otherwise(
        F.coalesce(F.element_at(m, e), F.lit("unknown_error")))


# --- SCL-11 ---------------------------------------------------------------------
def clean_label(col) -> Column:
    """strip -> lower -> rstrip('.')"""
    return F.regexp_replace(F.lower(F.trim(_c(col))), r"\.+$", "")


# --- SCL-12 ---------------------------------------------------------------------
def risk_label(p, lo: float = 0.35, hi: float = 0.65) -> Column:
    return F.when(_c(p) >= hi, "HIGH").when(_c(p) >= lo, "MEDIUM").otherwise("LOW")


# --- SCL-13 ---------------------------------------------------------------------
def record_checksum(*cols: str) -> Column:
    """sha256 of the sorted-key JSON of the record, first 16 hex chars."""
    names = sorted(cols)
    return F.substring(F.sha2(F.to_json(F.struct(*[F.col(c) for c in names])), 256), 1, 16)


# --- SCL-14 / SCL-15 -----------------------------------------------------------------
def json_path(col, path: str, default=None) -> Column:
    v = F.get_json_object(_c(col), path)
    return F.coalesce(v, F.lit(default)) if default is not None else v


def map_get(col, key, default=None) -> Column:
    k = key if isinstance(key, Column) else F.lit(key)
    v = F.try_element_at(_c(col), k)
    return F.coalesce(v, F.lit(default)) if default is not None else v


# --- SCL-16 ---------------------------------------------------------------------
def hash_uniform(id_col, seed) -> Column:
    """Deterministic per-row uniform in [0,1): first 8 hex digits of
    md5(seed || ':' || id) / 2^32.  Identical in DuckDB (md5 + hex parse)."""
    h = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), _c(id_col).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_uniform_sql(id_sql: str, seed) -> str:
    """DuckDB form of :func:`hash_uniform` for oracle SQL."""
    return (f"(CAST(('0x' || substr(md5('{seed}' || ':' || CAST({id_sql} AS VARCHAR)), 1, 8)) "
            f"AS UBIGINT) / 4294967296.0)")


def hash_normal(id_col, seed) -> Column:
    """Box–Muller standard normal from two hash uniforms."""
    u1 = F.greatest(hash_uniform(id_col, f"{seed}a"), F.lit(1e-12))
    u2 = hash_uniform(id_col, f"{seed}b")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


# --- rounding -------------------------------------------------------------------------
def np_round(col, nd: int) -> Column:
    """Round like numpy: scale by 10^nd, round half to even, scale back.

    Spark's ``round`` rounds half-up on the decimal form; numpy (which the
    reference uses) rounds the scaled binary value half-to-even.  Oracle SQL
    uses ``round_even(x * 10^nd, 0) / 10^nd`` — the same three IEEE steps.
    """
    s = float(10 ** nd)
    return F.bround(_c(col) * F.lit(s), 0) / F.lit(s)


def np_round_sql(expr: str, nd: int) -> str:
    s = float(10 ** nd)
    return f"(round_even(CAST(({expr}) AS DOUBLE) * {s!r}, 0) / {s!r})"

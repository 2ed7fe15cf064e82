"""Registered queries: decisioning (DEC-*), policy back-tests (AGG-20) and the
row-level diagnosis / remedy table."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.scalars import hash_uniform_sql as HU
from faultline.functions.scalars import np_round_sql as R
from faultline.operators import decide, policy, series, surrogate
from faultline.plans import sql as Q
from faultline.plans.catalog import register
from faultline.plans.feature_table import feature_table
from faultline.plans.q_evaluation import S
from faultline.plans.scored import labelled_features, scored_long
from faultline.session import reliable_checkpoint
from faultline.sources import fixtures as FX


def transactions(spark, sf):
    """Scored horizon-1 rows = one transaction each (primary = its API)."""
    # written once: running sums and back-tests read it several times
    return reliable_checkpoint(scored_long(spark, sf).filter(F.col("horizon") == 1)
                               .select("event_id", "api_name", "timestamp", "row_idx", "p", "y"))


TX = S + """, tx AS (SELECT event_id, api_name, "timestamp", row_idx, p, y FROM scored WHERE horizon = 1),
rates AS (SELECT api_name, 1.0 - avg(coalesce(success, 1)) AS failure_rate FROM telemetry GROUP BY 1),
apos AS (SELECT * FROM (VALUES """ + ", ".join(f"('{a}', {i + 1})" for i, a in enumerate(C.ALL_APIS)) + """) v(api_name, pos)),
rp AS (SELECT r.*, apos.pos FROM rates r JOIN apos USING (api_name)),
bk AS (SELECT a.api_name, a.failure_rate AS primary_rate, b.api_name AS backup_api, b.failure_rate AS backup_rate,
              row_number() OVER (PARTITION BY a.api_name ORDER BY b.failure_rate, b.pos) AS rk
       FROM rp a JOIN rp b ON a.api_name <> b.api_name),
bk1 AS (SELECT * FROM bk WHERE rk = 1)
"""


def _pro_sql(variant: str) -> str:
    u = HU("event_id", "proactive")
    hi, lo = C.HIGH_RISK, C.LOW_RISK
    if variant == "scaled":
        return f""", pro AS (SELECT tx.*,
  CASE WHEN p > {hi} THEN 'switch' WHEN p > {lo} THEN 'retry' ELSE 'normal' END AS action,
  CAST(CASE WHEN p > {hi} THEN {u} < CAST(y AS DOUBLE) * 0.25 WHEN p > {lo} THEN {u} < CAST(y AS DOUBLE) * 0.5
       ELSE y = 1 END AS INT) AS failed FROM tx)"""
    return f""", pro AS (SELECT tx.*,
  CASE WHEN p > {hi} AND bk1.backup_api IS NOT NULL AND bk1.backup_rate < bk1.primary_rate THEN 'switch'
       WHEN p > {hi} THEN 'hold' WHEN p > {lo} THEN 'retry' ELSE 'normal' END AS action,
  CAST(CASE WHEN p > {hi} AND bk1.backup_api IS NOT NULL AND bk1.backup_rate < bk1.primary_rate THEN {u} < bk1.backup_rate
       WHEN p > {hi} THEN y = 1 WHEN p > {lo} THEN y = 1 AND {u} < 0.5 ELSE y = 1 END AS INT) AS failed
  FROM tx LEFT JOIN bk1 USING (api_name))"""


def _lat(action_col: str = "action") -> str:
    return (f"CASE WHEN {action_col} = 'switch' THEN {policy.MS['switch']} "
            f"WHEN {action_col} IN ('retry', 'hold') THEN {policy.MS['retry']} ELSE {policy.MS['normal']} END")


REACT_SQL = f""", rl AS (SELECT tx.*, row_idx - 1 - coalesce(max(CASE WHEN y = 0 THEN row_idx END) OVER (
                PARTITION BY api_name ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS r FROM tx),
react AS (SELECT event_id, api_name, "timestamp", row_idx, p, y,
  CASE WHEN r % 2 = 1 THEN 'switch' ELSE 'normal' END AS action,
  CASE WHEN r % 2 = 1 THEN CAST({HU('event_id', 'reactive')} < {C.REACTIVE_BACKUP_FAIL} AS INT) ELSE y END AS failed,
  CASE WHEN r % 2 = 1 THEN {policy.MS['switch']} ELSE {policy.MS['normal']} END AS latency_ms FROM rl)"""

POST_SQL = f""", post AS (SELECT tx.*, CASE WHEN y = 1 THEN 'post-fail-switch' ELSE 'normal' END AS action, y AS failed,
  CASE WHEN y = 1 THEN {policy.MS['switch']} ELSE {policy.MS['normal']} END AS latency_ms FROM tx)"""


def _metrics_sql(src: str, label: str, lat: str = "latency_ms") -> str:
    return f"""SELECT '{label}' AS label, count(*) AS n_transactions, count(*) - sum(failed) AS successes,
  sum(failed) AS failures, sum(failed) / count(*) AS failure_rate,
  sum(CASE WHEN action = 'switch' THEN 1 ELSE 0 END) AS switches,
  {R(f'sum({lat}) / (count(*) * 1000.0::DOUBLE)', 4)} AS avg_latency_sec,
  {R(f'sum(failed) * {C.COST_PER_FAILURE!r}::DOUBLE', 2)} AS cost,
  {R(f'sum(failed) / count(*) * {float(C.TRANSACTIONS_PER_YEAR)!r}::DOUBLE * {C.COST_PER_FAILURE!r}::DOUBLE', 2)} AS annual_cost_usd
FROM {src}"""


def _all_metrics_spark(spark, sf):
    tx = transactions(spark, sf)
    rates = policy.measured_rates(FX.telemetry(spark, sf))
    pro = policy.proactive(tx, rates)
    pro_s = policy.proactive(tx, rates, variant="scaled")
    rea = policy.reactive(tx)
    post = policy.reactive(tx, variant="post_fail")
    return (policy.policy_metrics(pro, "proactive"), policy.policy_metrics(pro_s, "proactive_scaled"),
            policy.policy_metrics(rea, "reactive"), policy.policy_metrics(post, "reactive_post_fail"))


_PRO_M = TX + _pro_sql("measured") + f", prol AS (SELECT *, {_lat()} AS latency_ms FROM pro)"


@register("dec_policy_metrics", TX + _pro_sql("measured").replace(", pro AS", ", pro AS", 1)
          + f", prol AS (SELECT *, {_lat()} AS latency_ms FROM pro)"
          + _pro_sql("scaled").replace(", pro AS", ", pros AS", 1)
          + f", prosl AS (SELECT *, {_lat()} AS latency_ms FROM pros)" + REACT_SQL + POST_SQL + "\n"
          + _metrics_sql("prol", "proactive") + "\nUNION ALL\n" + _metrics_sql("prosl", "proactive_scaled")
          + "\nUNION ALL\n" + _metrics_sql("react", "reactive") + "\nUNION ALL\n"
          + _metrics_sql("post", "reactive_post_fail"))
def q_policy_metrics(spark, sf):
    a, b, c, d = _all_metrics_spark(spark, sf)
    return a.unionByName(b).unionByName(c).unionByName(d)


@register("dec_policy_comparison", _PRO_M + REACT_SQL + f""",
pm AS ({_metrics_sql('prol', 'proactive')}),
rm AS ({_metrics_sql('react', 'reactive')})
SELECT (rm.failures - pm.failures) / greatest(rm.failures, 1) AS failure_reduction,
       rm.annual_cost_usd - pm.annual_cost_usd AS annual_saving_usd,
       pm.avg_latency_sec - rm.avg_latency_sec AS latency_delta_sec,
       rm.failures - pm.failures AS failures_avoided
FROM pm, rm""")
def q_policy_comparison(spark, sf):
    a, _, c, _ = _all_metrics_spark(spark, sf)
    return policy.compare_policies(a, c)


@register("dec_reactive_actions", TX + REACT_SQL + "\nSELECT event_id, api_name, action, failed, latency_ms FROM react")
def q_reactive_rows(spark, sf):
    return policy.reactive(transactions(spark, sf)).select("event_id", "api_name", "action", "failed", "latency_ms")


@register("dec_proactive_actions", _PRO_M + "\nSELECT event_id, api_name, action, failed, latency_ms FROM prol")
def q_proactive_rows(spark, sf):
    tx = transactions(spark, sf)
    return (policy.proactive(tx, policy.measured_rates(FX.telemetry(spark, sf)))
            .select("event_id", "api_name", "action", "failed", "latency_ms"))


def _remedy_case(idx: int) -> str:
    return "CASE category " + " ".join(
        f"WHEN '{r[0]}' THEN {repr(r[idx]) if not isinstance(r[idx], str) else chr(39) + r[idx] + chr(39)}"
        for r in C.REMEDIES) + " END"


@register("dec_diagnosis_rows", Q.full_features_with() + f""",
dg AS (SELECT event_id, api_name, {Q.diagnose_case()} AS category, {Q.diagnose_confidence()} AS confidence
       FROM full_feat)
SELECT event_id, api_name, category, confidence,
       CASE category WHEN 'cascade' THEN 'isolate_dependency' WHEN 'overload' THEN 'throttle'
            WHEN 'timeout' THEN 'backoff' WHEN 'error_surge' THEN 'circuit_break' ELSE 'retry_jitter' END
         AS remediation_hint,
       {_remedy_case(1)} AS remedy_action, {_remedy_case(2)} AS recovery_ticks, {_remedy_case(3)} AS risk_reduction
FROM dg""")
def q_diagnosis_rows(spark, sf):
    d = decide.diagnose(feature_table(spark, sf))
    d = d.select("event_id", "api_name", F.col("diagnosis.category").alias("category"),
                 F.col("diagnosis.confidence").alias("confidence"),
                 F.col("diagnosis.remediation_hint").alias("remediation_hint"))
    return decide.remedies(d)


@register("dec_risk_decay", S + f""", rd AS (
  SELECT event_id, horizon, p, CAST(row_idx % 10 AS BIGINT) AS ticks, 'timeout' AS category FROM scored WHERE horizon = 1)
SELECT event_id, p AS risk, ticks, greatest(0.0, p - least(ticks, 4) * 0.12) AS risk_after, ticks >= 4 AS fix_complete
FROM rd""")
def q_risk_decay(spark, sf):
    s = (scored_long(spark, sf).filter(F.col("horizon") == 1)
         .select("event_id", F.col("p").alias("risk"), (F.col("row_idx") % 10).alias("ticks"),
                 F.lit("timeout").alias("category")))
    return decide.decay_risk(decide.remedies(s), "risk", "ticks").select(
        "event_id", "risk", "ticks", "risk_after", "fix_complete")


@register("dec_hysteresis", S + """, tx AS (SELECT event_id, api_name, row_idx, p FROM scored WHERE horizon = 1),
ev AS (SELECT *, CASE WHEN p >= 0.55 THEN 1 WHEN p < 0.45 THEN 0 END AS e FROM tx)
SELECT event_id, api_name, row_idx, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY api_name ORDER BY row_idx
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS alert FROM ev""")
def q_hysteresis(spark, sf):
    tx = transactions(spark, sf).select("event_id", "api_name", "row_idx", "p")
    return decide.hysteresis(tx, "p", "api_name", "row_idx").select("event_id", "api_name", "row_idx", "alert")


def health_polls(spark, sf):
    """Per-backend health polls: backend = user_id % 3, tick = position in the
    backend's time-ordered request log, healthy = request succeeded."""
    t = FX.telemetry(spark, sf).select("event_id", "timestamp", "success",
                                       (F.col("user_id") % 3).alias("backend"))
    idx = series.with_row_index(t, key="backend", order=("timestamp", "event_id"), idx_col="tick")
    return idx.withColumn("healthy", F.col("success") == 1)


@register("dec_debounce", "WITH " + FX.telemetry_sql() + """,
polls AS (SELECT event_id, user_id % 3 AS backend, success = 1 AS healthy,
                 row_number() OVER (PARTITION BY user_id % 3 ORDER BY "timestamp", event_id) - 1 AS tick FROM telemetry)
SELECT event_id, backend, tick, healthy,
       coalesce(lag(healthy, 1) OVER w = healthy, false)
       AND (lag(healthy, 2) OVER w IS NULL OR lag(healthy, 2) OVER w <> healthy) AS confirmed
FROM polls WINDOW w AS (PARTITION BY backend ORDER BY tick)""")
def q_debounce(spark, sf):
    return decide.debounce(health_polls(spark, sf), "healthy", "backend", "tick", 2).select(
        "event_id", "backend", "tick", "healthy", "confirmed")


@register("dec_roi", _PRO_M + REACT_SQL + f""",
pm AS ({_metrics_sql('prol', 'proactive')}),
rm AS ({_metrics_sql('react', 'reactive')}),
red AS (SELECT (rm.failures - pm.failures) / greatest(rm.failures, 1) AS r FROM pm, rm),
sc AS (SELECT api_name AS scenario, sum(1 - success) AS incidents, {C.COST_PER_FAILURE!r} AS cost_per_incident
       FROM telemetry GROUP BY 1)
SELECT scenario, incidents, cost_per_incident, {R('incidents * red.r', 0)} AS averted,
       {R('incidents * red.r', 0)} * cost_per_incident AS saved FROM sc, red""")
def q_roi(spark, sf):
    a, _, c, _ = _all_metrics_spark(spark, sf)
    red = policy.compare_policies(a, c).select("failure_reduction").scalar()
    sc = (FX.telemetry(spark, sf).groupBy(F.col("api_name").alias("scenario"))
          .agg(F.sum(F.lit(1) - F.col("success")).alias("incidents"))
          .withColumn("cost_per_incident", F.lit(C.COST_PER_FAILURE)))
    return decide.roi(sc, red)


@register("dec_parity_check", "WITH " + FX.telemetry_sql() + """,
rec AS (SELECT event_id, '{"api": "' || api_name || '", "idempotency_key": "k-' || CAST(event_id AS VARCHAR)
               || '", "outcome": "' || CASE WHEN success = 1 THEN 'success' ELSE 'failure' END
               || '", "request_count": ' || CAST(request_count AS VARCHAR)
               || ', "response_time": ' || CAST(response_time AS VARCHAR) || ', "source": "' || data_source || '"}' AS j,
               '{"api": "' || api_name || '", "idempotency_key": "k-' || CAST(event_id AS VARCHAR)
               || '", "outcome": "' || CASE WHEN success = 1 THEN 'success' ELSE 'failure' END
               || '", "request_count": ' || CAST(request_count + 1 AS VARCHAR)
               || ', "response_time": ' || CAST(response_time AS VARCHAR) || ', "source": "' || data_source || '"}' AS jneg
        FROM telemetry)
SELECT event_id, substr(sha256(j), 1, 16) AS checksum_primary, substr(sha256(j), 1, 16) AS checksum_replica,
       true AS parity_ok, substr(sha256(j), 1, 16) <> substr(sha256(jneg), 1, 16) AS negative_control_differs
FROM rec""")
def q_parity(spark, sf):
    prim = FX.telemetry(spark, sf)
    repl = FX.telemetry(spark, sf)   # second, independent scan = the replica

    def fields(df):
        return {"api": (F.col("api_name"), "str"),
                "idempotency_key": (F.concat(F.lit("k-"), F.col("event_id").cast("string")), "str"),
                "outcome": (F.when(F.col("success") == 1, "success").otherwise("failure"), "str"),
                "request_count": F.col("request_count"),
                "response_time": F.col("response_time"),
                "source": (F.col("data_source"), "str")}

    def negative(df):
        f = fields(df)
        f["request_count"] = F.col("request_count") + 1
        return f
    return decide.parity(prim, repl, "event_id", fields, negative)


# --- state machines, held against row-by-row recursive SQL ---------------------------------------------
def _route_input(spark, sf):
    s = (scored_long(spark, sf).filter(F.col("horizon") == 1)
         .join(FX.telemetry(spark, sf).select("event_id", "user_id"), "event_id"))
    g = (s.groupBy("api_name", F.date_trunc("minute", "timestamp").alias("ts_bucket"),
                   F.concat(F.lit("region-"), (F.col("user_id") % 3).cast("string")).alias("route"))
         .agg(F.max("p").alias("risk")))
    return g.groupBy("api_name", "ts_bucket").agg(F.map_from_entries(F.collect_list(F.struct("route", "risk")))
                                                  .alias("risks"))


def _route_sql() -> str:
    active = "CASE r.a WHEN 0 THEN {0}0 WHEN 1 THEN {0}1 ELSE {0}2 END"
    lv, tg = active.format("l.l"), active.format("l.t")
    bad = "l.c0 >= 0.55 AND l.c1 >= 0.55 AND l.c2 >= 0.55"
    action = f"""CASE WHEN {bad} THEN 'hold_alert_systemic'
      WHEN {lv} >= 0.55 THEN CASE WHEN {tg} IS NULL THEN CASE WHEN r.a = 0 THEN 'hold_alert_no_backup' ELSE 'hold_alert_backup_degraded' END
                                  WHEN r.a = 0 THEN 'reroute' ELSE 'rehop' END
      WHEN r.a = 0 THEN CASE WHEN l.l0 >= 0.35 THEN 'prewarm' ELSE 'serve' END
      WHEN l.c0 >= 0.35 THEN 'hold_backup' WHEN r.cool <= 1 THEN 'failback' ELSE 'cooldown' END"""
    return S + f""",
tk AS (SELECT s.api_name, date_trunc('minute', s."timestamp") AS ts_bucket, t.user_id % 3 AS g, max(s.p) AS v
       FROM scored s JOIN telemetry t USING (event_id) WHERE s.horizon = 1 GROUP BY ALL),
wd AS (SELECT api_name, ts_bucket, max(CASE WHEN g = 0 THEN v END) AS r0, max(CASE WHEN g = 1 THEN v END) AS r1,
              max(CASE WHEN g = 2 THEN v END) AS r2 FROM tk GROUP BY ALL),
cl AS (SELECT *, coalesce(r0, 0) AS l0, coalesce(r1, 0) AS l1, coalesce(r2, 0) AS l2,
              coalesce(r0, 1) AS c0, coalesce(r1, 1) AS c1, coalesce(r2, 1) AS c2 FROM wd),
ln AS MATERIALIZED (SELECT *, CASE WHEN c1 < 0.55 AND c1 <= c2 THEN 1 WHEN c2 < 0.55 THEN 2 END AS t0,
              CASE WHEN c0 < 0.55 AND c0 <= c2 THEN 0 WHEN c2 < 0.55 THEN 2 END AS t1,
              CASE WHEN c0 < 0.55 AND c0 <= c1 THEN 0 WHEN c1 < 0.55 THEN 1 END AS t2,
              row_number() OVER (PARTITION BY api_name ORDER BY ts_bucket) AS i FROM cl),
r(api_name, i, ts_bucket, a, state, cool, target, action) AS (
  SELECT DISTINCT api_name, 0::BIGINT, NULL::TIMESTAMP, 0, 'NORMAL', 0, NULL::INTEGER, '' FROM ln
  UNION ALL
  SELECT api_name, i, ts_bucket,
         CASE WHEN act IN ('reroute', 'rehop') THEN tgt WHEN act = 'failback' THEN 0 ELSE a END,
         CASE WHEN act LIKE 'hold_alert%' THEN 'SYSTEMIC' WHEN act = 'prewarm' THEN 'PREWARM' WHEN act = 'reroute' THEN 'REROUTED'
              WHEN act IN ('serve', 'failback') THEN 'NORMAL' ELSE state END,
         CASE WHEN act IN ('reroute', 'rehop', 'hold_backup') THEN 3 WHEN act = 'cooldown' THEN cool - 1 ELSE cool END, tgt, act
  FROM (SELECT l.api_name, l.i, l.ts_bucket, r.a, r.state, r.cool, {tg} AS tgt, {action} AS act
        FROM r JOIN ln l ON l.api_name = r.api_name AND l.i = r.i + 1))
"""


def route_sql_as(columns: str) -> str:
    return _route_sql() + f"SELECT {columns}\nFROM r WHERE i > 0"


@register("dec_route_replay", route_sql_as("""api_name, ts_bucket, 'region-' || a AS active, state, action LIKE 'hold_alert%' AS alert,
       CASE WHEN action = 'prewarm' THEN 'region-' || target END AS prewarm, action"""))
def q_route(spark, sf):
    from faultline.operators import stateful
    return stateful.route(_route_input(spark, sf), "api_name", "ts_bucket", "risks",
                          ["region-0", "region-1", "region-2"], "region-0", hi=0.55, lo=0.35, cooldown=3,
                          chunk_rows=500).drop("risks")


def _request_log(spark, sf):
    return FX.telemetry(spark, sf).select(
        "event_id", (F.col("user_id") % 3).cast("string").alias("backend"),
        (F.unix_micros(F.col("timestamp").cast("timestamp")) / F.lit(1e6)).alias("ts_s"),
        (F.col("success") == 1).alias("ok"))


LOG = "WITH RECURSIVE " + FX.telemetry_sql() + """,
log AS MATERIALIZED (SELECT event_id, CAST(user_id % 3 AS VARCHAR) AS backend, epoch_us("timestamp") / 1e6 AS ts_s, success = 1 AS ok,
       row_number() OVER w AS i, coalesce(lag(success) OVER w = success, false) AS confirmed
       FROM telemetry WINDOW w AS (PARTITION BY user_id % 3 ORDER BY "timestamp", event_id)),
"""


@register("dec_circuit_breaker", LOG + f"""
r(backend, i, event_id, ts_s, ok, state_before, allowed, state_after, event, streak, opened) AS (
  SELECT DISTINCT backend, 0::BIGINT, NULL::BIGINT, 0.0::DOUBLE, true, 'CLOSED', true, 'CLOSED', NULL::VARCHAR, 0, 0.0::DOUBLE FROM log
  UNION ALL
  SELECT backend, i, event_id, ts_s, ok, was, pass,
         CASE WHEN NOT pass THEN was WHEN ok THEN 'CLOSED' WHEN trip THEN 'OPEN' ELSE 'CLOSED' END,
         CASE WHEN NOT pass THEN NULL WHEN ok AND was = 'OPEN' THEN 'closed' WHEN ok THEN NULL WHEN was = 'OPEN' THEN 'reopened'
              WHEN trip THEN 'opened' END,
         CASE WHEN NOT pass THEN streak WHEN ok THEN 0 ELSE streak + 1 END,
         CASE WHEN pass AND NOT ok AND trip THEN ts_s ELSE opened END
  FROM (SELECT l.*, r.state_after AS was, r.streak, r.opened, r.state_after = 'CLOSED' OR l.ts_s - r.opened >= {C.BREAKER_PROBE_SECONDS} AS pass,
               r.state_after = 'OPEN' OR r.streak + 1 >= {C.BREAKER_FAILS} AS trip
        FROM r JOIN log l ON l.backend = r.backend AND l.i = r.i + 1))
SELECT event_id, backend, ts_s, ok, state_before, allowed, state_after, event FROM r WHERE i > 0""")
def q_breaker(spark, sf):
    from faultline.operators import stateful
    return stateful.circuit_breaker(_request_log(spark, sf), chunk_rows=1000)


@register("dec_canary", LOG + f"""
r(backend, i, event_id, ts_s, healthy, stage, since, event) AS (
  SELECT DISTINCT backend, 0::BIGINT, NULL::BIGINT, 0.0::DOUBLE, true, -1, 0.0::DOUBLE, NULL::VARCHAR FROM log
  UNION ALL
  SELECT l.backend, l.i, l.event_id, l.ts_s, l.ok,
         CASE WHEN NOT l.confirmed THEN r.stage WHEN NOT l.ok AND r.stage = -1 THEN 0 WHEN l.ok AND r.stage = 0 THEN 1
              WHEN l.ok AND r.stage > 0 AND l.ts_s - r.since >= {C.CANARY_HOLD_SECONDS} THEN CASE r.stage WHEN 1 THEN 2 ELSE -1 END ELSE r.stage END,
         CASE WHEN l.confirmed AND l.ok AND (r.stage = 0 OR r.stage > 0 AND l.ts_s - r.since >= {C.CANARY_HOLD_SECONDS}) THEN l.ts_s ELSE r.since END,
         CASE WHEN NOT l.confirmed THEN NULL WHEN NOT l.ok AND r.stage = -1 THEN 'reroute' WHEN l.ok AND r.stage = 0 THEN 'canary_10pct'
              WHEN l.ok AND r.stage > 0 AND l.ts_s - r.since >= {C.CANARY_HOLD_SECONDS}
              THEN CASE r.stage WHEN 1 THEN 'canary_50pct' ELSE 'full_restore' END END
  FROM r JOIN log l ON l.backend = r.backend AND l.i = r.i + 1)
SELECT event_id, backend, ts_s, healthy, CASE WHEN stage = -1 THEN 'primary' ELSE 'backup' END AS route, greatest(stage, 0) AS canary_stage,
       CASE stage WHEN -1 THEN 1.0 WHEN 0 THEN 0.0 WHEN 1 THEN 0.1 ELSE 0.5 END::DOUBLE AS primary_fraction, event FROM r WHERE i > 0""")
def q_canary(spark, sf):
    from faultline.operators import stateful
    polls = _request_log(spark, sf).withColumnRenamed("ok", "healthy")
    return stateful.canary(polls, chunk_rows=1000)


def _heal_ticks(spark, sf):
    """Score and diagnosis come from one feature pass; the ticks, which several jobs
    read, are written once."""
    d = decide.diagnose(surrogate.surrogate_forecast(labelled_features(spark, sf)).where("event_id is not null and y_h1 is not null"))
    j = d.select("event_id", "timestamp", "api_name", F.col("p_h1").alias("p"), F.col("diagnosis.category").alias("category"))
    return reliable_checkpoint(j.groupBy(F.date_trunc("minute", "timestamp").alias("ts_bucket"), "api_name")
                               .agg(F.max("p").alias("p"), F.max_by("category", F.struct("p", "event_id")).alias("category")))


def _heal_sql() -> str:
    """The loop tick by tick; lists hold a value per API."""
    each = list(range(1, len(C.ALL_APIS) + 1))
    names = "[" + ", ".join(f"'{a}'" for a in C.ALL_APIS) + "]"
    hi, lo = C.HIGH_RISK, C.LOW_RISK

    def put(cells: str, value: str, when: str = "true") -> str:
        return f"list_transform({each}, lambda j: CASE WHEN j = x AND {when} THEN {value} ELSE {cells}[j] END)"

    cause = "CASE WHEN category IN (" + ", ".join(f"'{r[0]}'" for r in C.REMEDIES) + ") THEN category ELSE 'intermittent' END"
    remedy = lambda k: "CASE cause " + " ".join(f"WHEN '{r[0]}' THEN " + (f"'{r[k]}'" if isinstance(r[k], str) else repr(r[k])) for r in C.REMEDIES) + " END"
    return S + f""",
dg AS (SELECT event_id, {Q.diagnose_case()} AS category FROM full_feat),
hm AS (SELECT date_trunc('minute', "timestamp") AS ts_bucket, api_name, max(p) AS p, first(category ORDER BY p DESC, event_id DESC) AS category
       FROM scored JOIN dg USING (event_id) WHERE horizon = 1 GROUP BY ALL),
hl AS MATERIALIZED (SELECT *, list_position({names}, api_name) AS x, row_number() OVER (ORDER BY ts_bucket, api_name) AS i FROM hm),
hr AS (SELECT api_name, 1.0 - avg(coalesce(success, 1)) AS rate FROM telemetry GROUP BY 1),
r(i, ts_bucket, api_name, p, category, risk, act, lab, cool, fix, cut, away, action, route_state, active, phase, root_cause, remedy_action) AS (
  SELECT 0::BIGINT, NULL::TIMESTAMP, ''::VARCHAR, 0.0::DOUBLE, ''::VARCHAR,
    (SELECT list(coalesce(rate, 0.10)::DOUBLE ORDER BY n.i) FROM (SELECT unnest({names}) AS a, unnest({each}) AS i) n LEFT JOIN hr ON api_name = a),
    {each}::INTEGER[], {["NORMAL"] * len(each)}::VARCHAR[], {[0] * len(each)}::INTEGER[], {[0] * len(each)}::INTEGER[], {[0.0] * len(each)}::DOUBLE[],
    [{", ".join(["false"] * len(each))}], ''::VARCHAR, ''::VARCHAR, ''::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR
  UNION ALL
  SELECT i, ts_bucket, api_name, p, category, risk, {put("act", "to_")}, {put("lab", "label")}, {put("cool", "count")}, {put("fix", remedy(2), "mend")},
    {put("cut", remedy(3), "mend")}, {put("away", "mend", "(mend OR back)")},
    CASE WHEN switch THEN 'switch' WHEN label = 'PREWARM' THEN 'prewarm' WHEN label = 'SYSTEMIC' THEN 'hold' WHEN back THEN 'restore'
         WHEN p > {lo} THEN 'retry' ELSE 'normal' END, label, {names}[to_], CASE WHEN mend THEN 'reroute+diagnose+fix' WHEN back THEN 'restore' END,
    CASE WHEN mend THEN cause END, CASE WHEN mend THEN {remedy(1)} END
  FROM (SELECT *, switch AND fix[x] = 0 AS mend, NOT switch AND label = 'NORMAL' AND to_ = x AND away[x] AS back
  FROM (SELECT *, label = 'REROUTED' AND to_ <> x AS switch, {cause} AS cause
  FROM (SELECT *, CASE WHEN did IN ('reroute', 'rehop') THEN target WHEN did = 'failback' THEN x ELSE act[x] END::INTEGER AS to_,
      CASE did WHEN 'hold' THEN 'SYSTEMIC' WHEN 'reroute' THEN 'REROUTED' WHEN 'prewarm' THEN 'PREWARM' WHEN 'serve' THEN 'NORMAL'
               WHEN 'failback' THEN 'NORMAL' ELSE lab[x] END AS label,
      CASE WHEN did IN ('reroute', 'rehop', 'backup') THEN {C.ROUTE_COOLDOWN} WHEN did = 'less' THEN cool[x] - 1 WHEN did = 'failback' THEN 0 ELSE cool[x] END AS count
  FROM (SELECT *, CASE WHEN list_min(risk) >= {hi} THEN 'hold' WHEN risk[act[x]] >= {hi} THEN CASE WHEN target IS NULL THEN 'hold' WHEN act[x] = x THEN 'reroute' ELSE 'rehop' END
      WHEN act[x] = x THEN CASE WHEN risk[x] >= {lo} THEN 'prewarm' ELSE 'serve' END
      WHEN risk[x] >= {lo} THEN 'backup' WHEN cool[x] <= 1 THEN 'failback' ELSE 'less' END AS did
  FROM (SELECT * REPLACE (list_transform(fix, lambda t: greatest(t - 1, 0)) AS fix),
      list_min(list_transform(list_filter({each}, lambda j: j <> act[x] AND risk[j] < {hi}), lambda j: {{'v': risk[j], 'j': j}})).j AS target
  FROM (SELECT l.i, l.ts_bucket, l.api_name, l.p, l.category, l.x, act, lab, cool, fix, cut, away,
      list_transform({each}, lambda j: CASE WHEN fix[j] > 0 THEN greatest(0.0, CASE WHEN j = l.x THEN l.p ELSE risk[j] END - cut[j])
                                            WHEN j = l.x THEN l.p ELSE risk[j] END) AS risk
  FROM r JOIN hl l ON l.i = r.i + 1)))))))"""


def _healed(spark, sf, chunk_rows=2000):
    from faultline.operators import healing
    rates = {r["api_name"]: r["failure_rate"] for r in policy.measured_rates(FX.telemetry(spark, sf)).collect()}
    return healing.self_heal(_heal_ticks(spark, sf), rates, chunk_rows=chunk_rows)


@register("dec_self_heal_replay", _heal_sql() + """
SELECT ts_bucket, api_name, p, category, action, route_state, active, phase, root_cause, remedy_action FROM r WHERE i > 0""")
def q_self_heal(spark, sf):
    return _healed(spark, sf)


@register("dec_heal_summary", _heal_sql() + """
SELECT 'action' AS dimension, action AS value, count(*) AS count FROM r WHERE i > 0 GROUP BY 2
UNION ALL SELECT 'root_cause', root_cause, count(*) FROM r WHERE i > 0 AND phase = 'reroute+diagnose+fix' GROUP BY 2
UNION ALL SELECT 'remedy', remedy_action, count(*) FROM r WHERE i > 0 AND phase = 'reroute+diagnose+fix' GROUP BY 2""")
def q_heal_summary(spark, sf):
    from faultline.operators import healing
    return healing.heal_summary(_healed(spark, sf))

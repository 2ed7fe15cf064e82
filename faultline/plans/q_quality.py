"""Registered queries: sampling / rebalancing (SMP-*), cleaning (DQ-*, PRJ-05)
and drift (DR-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.scalars import hash_uniform_sql as HU
from faultline.operators import quality as QL
from faultline.operators import sampling as SM
from faultline.plans import sql as Q
from faultline.plans.catalog import register
from faultline.plans.feature_table import feature_table
from faultline.plans.q_evaluation import S
from faultline.plans.scored import scored_long
from faultline.session import reliable_checkpoint, scratch_dir
from faultline.sources import fixtures as FX

T = "WITH " + FX.telemetry_sql() + "\n"


def d(x) -> str:
    return f"{float(x)!r}::DOUBLE"


@register("smp_sample_n", T + f"""
SELECT event_id, api_name FROM telemetry ORDER BY {HU('event_id', 'sample')}, event_id LIMIT 1000""")
def q_sample_n(spark, sf):
    return SM.sample_n(FX.telemetry(spark, sf), 1000, "sample").select("event_id", "api_name")


@register("smp_stratified", T + f""", lab AS (SELECT *, 1 - success AS failure FROM telemetry),
c AS (SELECT sum(failure) AS npos, count(*) - sum(failure) AS nneg, count(*) AS total FROM lab),
q AS (SELECT least(npos, CAST(floor(2000 * (CAST(npos AS DOUBLE) / greatest(total, 1))) AS BIGINT)) AS kp FROM c),
q2 AS (SELECT kp, least(nneg, 2000 - kp) AS kn FROM q, c),
r AS (SELECT event_id, failure, row_number() OVER (PARTITION BY failure ORDER BY {HU('event_id', 'strat')}, event_id) AS rn
      FROM lab)
SELECT event_id, failure FROM r, q2 WHERE (failure = 1 AND rn <= kp) OR (failure = 0 AND rn <= kn)""")
def q_stratified(spark, sf):
    t = FX.telemetry(spark, sf).withColumn("failure", F.lit(1) - F.col("success"))
    return SM.stratified_sample(t, "failure", 2000, "strat").select("event_id", "failure")


@register("smp_cap_group_share", T + f""", c AS (
  SELECT sum(CASE WHEN api_name <> 'transaction_api' THEN 1 ELSE 0 END) AS others,
         sum(CASE WHEN api_name = 'transaction_api' AND success = 0 THEN 1 ELSE 0 END) AS fail,
         sum(CASE WHEN api_name = 'transaction_api' AND success = 1 THEN 1 ELSE 0 END) AS succ FROM telemetry),
x AS (SELECT greatest(0, CAST(trunc(({d(0.15)} * others - ({d(1.0)} - {d(0.15)}) * fail) / ({d(1.0)} - {d(0.15)})) AS BIGINT)) AS x,
             succ FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY {HU('event_id', 'cap_share')}, event_id) AS rn
      FROM telemetry WHERE api_name = 'transaction_api' AND success = 1)
SELECT event_id, api_name FROM telemetry WHERE api_name <> 'transaction_api' OR success = 0
UNION ALL
SELECT event_id, api_name FROM r, x WHERE rn <= CASE WHEN x.x >= x.succ THEN x.succ ELSE x.x END""")
def q_cap_share(spark, sf):
    return SM.cap_group_share(FX.telemetry(spark, sf), "transaction_api", 0.15).select("event_id", "api_name")


@register("smp_cap_failure_rate", T + f""", c AS (SELECT sum(coalesce(success, 1)) AS succ, count(*) AS n FROM telemetry),
r AS (SELECT *, row_number() OVER (ORDER BY {HU('event_id', 'cap_fail')}, event_id) AS rn FROM telemetry WHERE success = 0)
SELECT event_id, success FROM telemetry, c WHERE success = 1 OR 1.0 - succ / n <= 0.10
UNION ALL
SELECT event_id, success FROM r, c WHERE 1.0 - succ / n > 0.10 AND rn <= CAST(floor(succ * {d(0.10)}) AS BIGINT)""")
def q_cap_fail(spark, sf):
    return SM.cap_failure_rate(FX.telemetry(spark, sf), 0.10).select("event_id", "success")


TXS = S + ", tx AS (SELECT event_id, api_name, row_idx, p, y FROM scored WHERE horizon = 1)"


def _tx(spark, sf):
    # written once: order statistics, counts and copies each read it
    return reliable_checkpoint(scored_long(spark, sf).filter(F.col("horizon") == 1).select("event_id", "api_name", "row_idx", "p", "y"))


@register("smp_balance", TXS + f""", c AS (SELECT sum(y) AS pos, count(*) - sum(y) AS neg FROM tx),
r AS (SELECT *, row_number() OVER (ORDER BY {HU('event_id', 'balance')}, event_id) AS rn FROM tx WHERE y = 0)
SELECT event_id, y FROM tx, c WHERE y = 1 OR c.pos = 0 OR c.neg <= c.pos
UNION ALL
SELECT event_id, y FROM r, c WHERE c.pos > 0 AND c.neg > c.pos AND rn <= c.pos""")
def q_balance(spark, sf):
    return SM.balance(_tx(spark, sf), "y").select("event_id", "y")


@register("smp_oversample", TXS + f""", c AS (SELECT sum(y) AS npos FROM tx),
e AS (SELECT npos, CAST(round_even(npos * ({d(2.5)} - {d(1.0)}), 0) AS BIGINT) AS extra FROM c),
k AS (SELECT npos, extra, CAST(extra // npos AS BIGINT) AS full_copies, CAST(extra % npos AS BIGINT) AS rem FROM e WHERE npos > 0),
pos AS (SELECT * FROM tx WHERE y = 1),
r AS (SELECT *, row_number() OVER (ORDER BY {HU('event_id', 'oversample')}, event_id) AS rn FROM pos)
SELECT event_id, 0 AS copy FROM tx
UNION ALL
SELECT event_id, CAST(s.copy AS INT) AS copy FROM pos, k, generate_series(CAST(1 AS BIGINT), k.full_copies) s(copy)
UNION ALL
SELECT event_id, CAST(k.full_copies + 1 AS INT) AS copy FROM r, k WHERE rn <= k.rem""")
def q_oversample(spark, sf):
    return SM.oversample(_tx(spark, sf), 2.5, "y").select("event_id", F.col("copy").cast("int").alias("copy"))


@register("smp_split_stratified", TXS + f""", r AS (
  SELECT event_id, y, row_number() OVER (PARTITION BY y ORDER BY {HU('event_id', 'split')}, event_id) - 1 AS r,
         count(*) OVER (PARTITION BY y) AS n FROM tx)
SELECT event_id, y, CASE WHEN r < floor(n * {d(0.8)}) THEN 'train' WHEN r < floor(n * {d(0.8 + 0.1)}) THEN 'val'
                         ELSE 'test' END AS split FROM r""")
def q_split(spark, sf):
    return SM.split_stratified(_tx(spark, sf), "y").select("event_id", "y", "split")


@register("smp_kfold", T + f"""
SELECT event_id, CAST(floor({HU('event_id', 'kfold')} * 5) AS INT) AS fold FROM telemetry""")
def q_kfold(spark, sf):
    return SM.kfold(FX.telemetry(spark, sf), 5).select("event_id", "fold")


@register("smp_quota_pool", T + f""", r AS (
  SELECT event_id, api_name, {HU('event_id', 'pool')} AS u,
         row_number() OVER (PARTITION BY api_name ORDER BY {HU('event_id', 'pool')}, event_id) AS rn FROM telemetry)
SELECT event_id, api_name FROM r WHERE rn <= 1000 // (SELECT count(DISTINCT api_name) FROM telemetry)
ORDER BY u, event_id LIMIT 1000""")
def q_quota(spark, sf):
    return SM.quota_pool(FX.telemetry(spark, sf), 1000).select("event_id", "api_name")


def _augment_sql():
    import math

    def normal(key, seed):
        u1 = HU(key, f"{seed}a")
        u2 = HU(key, f"{seed}b")
        return f"(sqrt({d(-2.0)} * ln(greatest({u1}, {d(1e-12)}))) * cos({d(2 * math.pi)} * {u2}))"
    key = "(CAST(event_id AS VARCHAR) || '/' || CAST(copy AS VARCHAR))"
    scale = f"({d(0.05)} + copy * {d(0.01)})"
    cols = "event_id, \"timestamp\", api_name, response_time, status_code, success, error_type, request_count, data_source, user_id"
    return T + f""", src AS (SELECT * FROM telemetry WHERE api_name = 'crypto_api' AND success = 0),
cp AS (SELECT src.*, CAST(c.copy AS INT) AS copy FROM src, range(5) c(copy)),
noisy AS (SELECT event_id, "timestamp", api_name,
                 greatest(CAST(response_time AS DOUBLE) * ({d(1.0)} + {normal(key, 'augment:response_time')} * {scale}), {d(0.0)}) AS response_time,
                 status_code, success, error_type,
                 greatest(request_count + CAST(floor({HU(key, 'augment:rc')} * 7) AS INT) - 3, 1) AS request_count,
                 data_source, user_id, copy FROM cp),
capn AS (SELECT CAST(floor((SELECT count(*) FROM telemetry) * {d(C.MAX_AUGMENTATION_FRACTION)}) AS BIGINT) AS cap),
ranked AS (SELECT *, row_number() OVER (ORDER BY {HU(key, 'augment:cap')}, {key}) AS rn FROM noisy)
SELECT {cols}, -1 AS copy FROM telemetry
UNION ALL
SELECT {cols}, copy FROM ranked, capn WHERE rn <= cap"""


@register("smp_augment_worst_api", _augment_sql())
def q_augment(spark, sf):
    t = FX.telemetry(spark, sf)
    return SM.augment_group(t, (F.col("api_name") == "crypto_api") & (F.col("success") == 0))


def _inject_sql(target: float = 0.30):
    import math

    def normal(key, seed):
        u1 = HU(key, f"{seed}a")
        u2 = HU(key, f"{seed}b")
        return f"(sqrt({d(-2.0)} * ln(greatest({u1}, {d(1e-12)}))) * cos({d(2 * math.pi)} * {u2}))"
    key = "(CAST(event_id AS VARCHAR) || '/' || CAST(copy AS VARCHAR))"
    cols = "event_id, \"timestamp\", api_name, response_time, status_code, success, error_type, request_count, data_source, user_id"
    return T + f""", fails AS (SELECT * FROM telemetry WHERE success = 0),
c AS (SELECT (SELECT count(*) FROM telemetry) AS n, count(*) AS nf FROM fails),
k AS (SELECT nf, greatest(0, CAST(floor(n * {d(target)}) AS BIGINT) - nf) AS inj FROM c),
e AS (SELECT nf, inj, CAST(round_even(nf * (({d(1.0)} + inj / nf) - {d(1.0)}), 0) AS BIGINT) AS extra FROM k
      WHERE inj > 0 AND nf > 0),
kk AS (SELECT nf, CAST(extra // nf AS BIGINT) AS full_copies, CAST(extra % nf AS BIGINT) AS rem FROM e WHERE extra > 0),
fullc AS (SELECT f.*, CAST(s.copy AS INT) AS copy FROM fails f, kk, generate_series(CAST(1 AS BIGINT), kk.full_copies) s(copy)),
r AS (SELECT f.*, row_number() OVER (ORDER BY {HU('event_id', 'inject')}, event_id) AS rn FROM fails f),
remr AS (SELECT r.* EXCLUDE (rn), CAST(kk.full_copies + 1 AS INT) AS copy FROM r, kk WHERE rn <= kk.rem),
ex AS (SELECT * FROM fullc UNION ALL SELECT * FROM remr),
jit AS (SELECT event_id, "timestamp", api_name,
               greatest(CAST(response_time AS DOUBLE) * ({d(1.0)} + {normal(key, 'inject:response_time')} * {d(0.06)}), {d(0.0)}) AS response_time,
               status_code, success, error_type,
               greatest(request_count + CAST(floor({HU(key, 'inject:rc')} * 7) AS INT) - 3, 1) AS request_count,
               data_source, user_id, copy FROM ex)
SELECT {cols}, -1 AS copy FROM telemetry
UNION ALL
SELECT {cols}, copy FROM jit"""


@register("smp_inject_failures", _inject_sql())
def q_inject(spark, sf):
    # rebalance towards 30 % failures (the fixture already exceeds 13 %)
    return SM.inject_failures(FX.telemetry(spark, sf), 0.30)


def _null_like_sql(c: str) -> str:
    return f"({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '' OR lower(CAST({c} AS VARCHAR)) = 'unknown')"


def _repair_sql(src: str) -> str:
    m = "CASE api_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.DEFAULT_FAILURE_TYPE.items()) + " END"
    nl = _null_like_sql("error_type")
    return f"""SELECT * REPLACE (CASE WHEN {nl} AND success = 0 THEN coalesce({m}, error_type)
                   WHEN {nl} AND success <> 0 THEN 'none' ELSE error_type END AS error_type) FROM {src}"""


@register("dq_repair_error_type", T + f", rep AS ({_repair_sql('telemetry')})\nSELECT event_id, error_type FROM rep")
def q_repair(spark, sf):
    return QL.repair_error_type(FX.telemetry(spark, sf)).select("event_id", "error_type")


@register("dq_repair_counts", T + f"""
SELECT sum(CASE WHEN {_null_like_sql('error_type')} THEN 1 ELSE 0 END) AS null_before,
       sum(CASE WHEN {_null_like_sql('error_type')} AND success = 0 AND api_name IN ({", ".join(f"'{a}'" for a in C.DEFAULT_FAILURE_TYPE)}) THEN 1 ELSE 0 END) AS mapping_filled,
       sum(CASE WHEN {_null_like_sql('error_type')} AND NOT success = 0 THEN 1 ELSE 0 END) AS set_none,
       sum(CASE WHEN {_null_like_sql('error_type')} AND success = 0 AND api_name NOT IN ({", ".join(f"'{a}'" for a in C.DEFAULT_FAILURE_TYPE)}) THEN 1 ELSE 0 END) AS null_after
FROM telemetry""")
def q_repair_counts(spark, sf):
    return QL.repair_counts(FX.telemetry(spark, sf))


def clean_inputs(spark, sf):
    """csv = telemetry rows with user_id % 4 <> 0; db = db_extended rows plus a
    replay of every tenth of them (duplicates)."""
    t = FX.telemetry(spark, sf).drop("user_id")
    csv = t.filter(F.col("event_id") % 4 != 0)
    db0 = t.filter(F.col("data_source") == "db_extended")
    db = db0.unionByName(db0.filter(F.col("event_id") % 10 == 0))
    return csv, db


CLEAN_SQL = T + f""", csv AS (SELECT * EXCLUDE (user_id) FROM telemetry WHERE event_id % 4 <> 0),
db0 AS (SELECT * EXCLUDE (user_id) FROM telemetry WHERE data_source = 'db_extended'),
db AS (SELECT * FROM db0 UNION ALL SELECT * FROM db0 WHERE event_id % 10 = 0),
dd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY api_name, "timestamp", data_source
                                    ORDER BY event_id) AS rn FROM db) WHERE rn = 1),
nw AS (SELECT * FROM dd WHERE NOT EXISTS (SELECT 1 FROM csv WHERE csv.api_name = dd.api_name
                                          AND csv."timestamp" = dd."timestamp")),
merged0 AS (SELECT * FROM csv UNION ALL SELECT * FROM nw),
merged AS ({_repair_sql('merged0')}),
c AS (SELECT sum(CASE WHEN api_name <> 'transaction_api' THEN 1 ELSE 0 END) AS others,
             sum(CASE WHEN api_name = 'transaction_api' AND success = 0 THEN 1 ELSE 0 END) AS fail,
             sum(CASE WHEN api_name = 'transaction_api' AND success = 1 THEN 1 ELSE 0 END) AS succ FROM merged),
x AS (SELECT greatest(0, CAST(trunc(({d(0.25)} * others - ({d(1.0)} - {d(0.25)}) * fail) / ({d(1.0)} - {d(0.25)})) AS BIGINT)) AS x,
             succ FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY {HU('event_id', 'cap_share')}, event_id) AS rn
      FROM merged WHERE api_name = 'transaction_api' AND success = 1),
cleaned AS (SELECT event_id, api_name, data_source, error_type, success FROM merged
            WHERE api_name <> 'transaction_api' OR success = 0
            UNION ALL
            SELECT event_id, api_name, data_source, error_type, success FROM r, x
            WHERE rn <= CASE WHEN x.x >= x.succ THEN x.succ ELSE x.x END)
"""


@register("dq_clean_pipeline", CLEAN_SQL + "SELECT * FROM cleaned")
def q_clean(spark, sf):
    csv, db = clean_inputs(spark, sf)
    return QL.clean(csv, db, cap=0.25).select("event_id", "api_name", "data_source", "error_type", "success")


@register("dq_cleaning_report", CLEAN_SQL + """
SELECT 0 AS step_no, 'csv' AS step, count(*) AS rows, sum(CASE WHEN success = 0 THEN 1 ELSE 0 END) AS failures FROM csv
UNION ALL SELECT 1, 'db', count(*), sum(CASE WHEN success = 0 THEN 1 ELSE 0 END) FROM db
UNION ALL SELECT 2, 'db_dedup', count(*), sum(CASE WHEN success = 0 THEN 1 ELSE 0 END) FROM dd
UNION ALL SELECT 3, 'db_new', count(*), sum(CASE WHEN success = 0 THEN 1 ELSE 0 END) FROM nw
UNION ALL SELECT 4, 'cleaned', count(*), sum(CASE WHEN success = 0 THEN 1 ELSE 0 END) FROM cleaned""")
def q_clean_report(spark, sf):
    from faultline.operators import aggregates as A
    from faultline.operators.joins import new_rows
    csv, db = clean_inputs(spark, sf)
    dd = A.dedup_first(db, ["api_name", "timestamp", "data_source"], ("event_id",))
    nw = new_rows(dd, csv, ("api_name", "timestamp"))
    cleaned = QL.clean(csv, db, cap=0.25)
    return QL.cleaning_report([("csv", csv), ("db", db), ("db_dedup", dd), ("db_new", nw), ("cleaned", cleaned)])


def _audit_sql():
    cov = "\nUNION ALL\n".join(
        f"SELECT data_source AS source, '{f}' AS feature, 100.0 * sum(CASE WHEN {f} IS NOT NULL AND {f} <> 0 "
        f"THEN 1 ELSE 0 END) / greatest(count(*), 1) AS pct FROM full_feat GROUP BY 1" for f in C.AUDIT_KEY_FEATURES)
    return Q.full_features_with() + f""",
tot AS (SELECT count(*) AS n FROM full_feat),
sb AS (SELECT data_source AS source, 100.0 * count(*) / (SELECT n FROM tot) AS pct FROM full_feat GROUP BY 1),
cov AS ({cov}),
lowcov AS (SELECT source FROM cov GROUP BY 1 HAVING sum(CASE WHEN pct < {C.AUDIT_COVERAGE_PCT} THEN 1 ELSE 0 END) >= 3),
ps AS (SELECT data_source AS source, count(*) AS n_total, sum(1 - success) AS n_fail FROM full_feat GROUP BY 1),
fm AS (SELECT data_source AS source, error_type AS mode, count(*) AS c FROM full_feat WHERE success = 0 GROUP BY 1, 2),
o AS (SELECT data_source, row_number() OVER (ORDER BY api_name, "timestamp", event_id) - 1 AS gidx FROM full_feat),
ch AS (SELECT gidx, CASE WHEN lag(data_source) OVER w IS NOT NULL AND lag(data_source) OVER w IS DISTINCT FROM data_source
                    THEN gidx END AS chg FROM o WINDOW w AS (ORDER BY gidx)),
l AS (SELECT gidx, max(chg) OVER (ORDER BY gidx ROWS BETWEEN 28 PRECEDING AND CURRENT ROW) AS lc FROM ch),
bc AS (SELECT 100.0 * coalesce(sum(CASE WHEN lc IS NOT NULL THEN 1 ELSE 0 END), 0) / greatest(count(*), 1) AS pct
       FROM l WHERE gidx >= 29)
SELECT 'DROP' AS action, source, 'rows below the low-share threshold' AS reason FROM sb WHERE pct < {C.AUDIT_SOURCE_LOW_PCT}
UNION ALL SELECT 'DOWNSAMPLE', source, 'source dominates the table' FROM sb WHERE pct > {C.AUDIT_SOURCE_HIGH_PCT}
UNION ALL SELECT 'DROP', source, '3+ key features under the coverage threshold' FROM lowcov
UNION ALL SELECT DISTINCT 'CONSIDER DROPPING', source, 'low failure rate' FROM ps
          WHERE 100.0 * n_fail / greatest(n_total, 1) < {C.AUDIT_FAILURE_MIN_PCT}
UNION ALL SELECT DISTINCT 'REVIEW', fm.source, 'single failure mode dominates' FROM fm JOIN ps USING (source)
          WHERE 100.0 * fm.c / ps.n_fail > {C.AUDIT_DOMINANT_MODE_PCT}
UNION ALL SELECT 'FIX BOUNDARY', NULL, 'sequences cross source boundaries' FROM bc WHERE pct > 1"""


@register("dq_audit", _audit_sql())
def q_audit(spark, sf):
    return QL.audit(reliable_checkpoint(feature_table(spark, sf)))  # one table for all reports


# --- drift -----------------------------------------------------------------------------------
def _halves(spark, sf, ft=None):
    """The drift features of the earlier and the later half of the events."""
    ft = feature_table(spark, sf) if ft is None else ft
    ft = reliable_checkpoint(ft.select("event_id", *C.DRIFT_FEATURES))
    n = ft.count()
    from faultline.plans.scored import chrono_positions
    pos = chrono_positions(spark, sf)
    j = reliable_checkpoint(ft.join(pos.select("event_id", "pos"), "event_id"))
    return j.filter(F.col("pos") < n // 2), j.filter(F.col("pos") >= n // 2)


def _ks_sql() -> str:
    feats = C.DRIFT_FEATURES
    longs = lambda side: "\nUNION ALL\n".join(
        f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, {1 if side == 'a' else 0} AS ca, "
        f"{0 if side == 'a' else 1} AS cb FROM {side}" for f in feats)
    terms = " + ".join(f"{2.0 * (-1) ** (j - 1)!r} * exp({-2.0 * j * j!r} * lam * lam)" for j in range(1, 101))
    return Q.full_features_with() + f""",
pos AS (SELECT event_id, row_number() OVER (ORDER BY "timestamp", event_id) - 1 AS pos FROM telemetry),
nn AS (SELECT count(*) AS n FROM full_feat),
j AS (SELECT f.*, pos.pos FROM full_feat f JOIN pos USING (event_id)),
a AS (SELECT j.* FROM j, nn WHERE pos < n // 2),
b AS (SELECT j.* FROM j, nn WHERE pos >= n // 2),
u AS ({longs('a')}
UNION ALL
{longs('b')}),
cnt AS (SELECT feature, value, sum(ca) AS ca, sum(cb) AS cb FROM u WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2),
tot AS (SELECT feature, sum(ca) AS na, sum(cb) AS nb FROM cnt GROUP BY 1),
cum AS (SELECT *, sum(ca) OVER w AS cum_ca, sum(cb) OVER w AS cum_cb FROM cnt
        WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT feature, max(abs(cum_ca / na - cum_cb / nb)) AS ks, first(na) AS n_a, first(nb) AS n_b
      FROM cum JOIN tot USING (feature) GROUP BY 1),
lm AS (SELECT *, (sqrt(CAST(n_a AS DOUBLE) * CAST(n_b AS DOUBLE) / CAST(n_a + n_b AS DOUBLE)) + 0.12
                  + 0.11 / sqrt(CAST(n_a AS DOUBLE) * CAST(n_b AS DOUBLE) / CAST(n_a + n_b AS DOUBLE))) * ks AS lam FROM g),
ksr AS (SELECT feature, ks, n_a, n_b,
               CASE WHEN ks <= 0 THEN 1.0 ELSE least(greatest(0.0 + {terms}, 0.0), 1.0) END AS p_value FROM lm)
"""


@register("dr_ks_half_vs_half", _ks_sql() + "SELECT * FROM ksr")
def q_ks(spark, sf):
    a, b = _halves(spark, sf)
    return QL.ks_2samp(a, b, C.DRIFT_FEATURES)


@register("dr_drift_decision", _ks_sql() + f"""
SELECT sum(CASE WHEN ks > {C.KS_THRESHOLD} AND p_value < {C.KS_P_THRESHOLD} THEN 1 ELSE 0 END) AS n_drifted,
       count(*) AS n_features,
       sum(CASE WHEN ks > {C.KS_THRESHOLD} AND p_value < {C.KS_P_THRESHOLD} THEN 1 ELSE 0 END) >= {C.DRIFT_MIN_FEATURES}
         AS dataset_drift FROM ksr""")
def q_drift_decision(spark, sf):
    a, b = _halves(spark, sf)
    return QL.drift_decision(QL.ks_2samp(a, b, C.DRIFT_FEATURES))


STATE_COLS = ("response_time", "status_code", "success", "request_count")


def _state_rows_sql(where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM telemetry WHERE {c} IS NOT NULL AND {where}" for c in STATE_COLS)


def _stored_states(spark, sf):
    """States of failed and of other requests, appended one after the other."""
    path = scratch_dir(spark, "baseline_states")
    t = FX.telemetry(spark, sf)
    for part in (F.col("success") == 0, ~F.coalesce(F.col("success") == 0, F.lit(False))):
        QL.baseline_state(t.filter(part), STATE_COLS).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@register("dr_baseline_states", T + f""", u AS ({_state_rows_sql()})
SELECT feature, count(*)::BIGINT AS n_rows, count(DISTINCT value)::BIGINT AS n_distinct, min(value) AS lo, max(value) AS hi,
       quantile_disc(value, 0.25) AS q25, quantile_disc(value, 0.5) AS q50, quantile_disc(value, 0.75) AS q75,
       quantile_disc(value, 0.95) AS q95
FROM u GROUP BY feature""")
def q_baseline_states(spark, sf):
    """DR-01 on all rows: stored day states merged, with exact quantiles."""
    return QL.state_summary(QL.merge_states(_stored_states(spark, sf)))


@register("dr_baseline_states_by_day", T + """, u AS (SELECT "timestamp"::DATE AS day, response_time AS value FROM telemetry)
SELECT CAST(day AS VARCHAR) AS day, count(*)::BIGINT AS n_rows, count(DISTINCT value)::BIGINT AS n_distinct FROM u WHERE value IS NOT NULL GROUP BY day""")
def q_baseline_by_day(spark, sf):
    """DR-01: what the stored states hold of a feature, day by day."""
    s = _stored_states(spark, sf).where("feature = 'response_time'").groupBy("day", "value").agg(F.sum("n").alias("n"))
    return s.groupBy(F.col("day").cast("string").alias("day")).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))


@register("dr_drift_baseline", Q.full_features_with() + ", smp AS (SELECT * FROM full_feat ORDER BY "
          + HU("event_id", "baseline") + ", event_id LIMIT 5000)\n" + "\nUNION ALL\n".join(
              f"SELECT event_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM smp" for f in C.DRIFT_FEATURES))
def q_baseline(spark, sf):
    return QL.drift_baseline(reliable_checkpoint(feature_table(spark, sf).select("event_id", *C.DRIFT_FEATURES)))


@register("dr_imbalance", T + f"""
SELECT 1.0 - avg(coalesce(success, 1)) AS failure_rate, 1.0 - avg(coalesce(success, 1)) < {C.IMBALANCE_FLOOR} AS imbalance
FROM telemetry""")
def q_imbalance(spark, sf):
    return QL.imbalance(FX.telemetry(spark, sf))


def _daily_runs(spark, sf):
    """Day-over-day drift: run = day d compares day d (a) with day d-1 (b)."""
    ft = feature_table(spark, sf).select(F.to_date("timestamp").alias("day"), *C.DRIFT_FEATURES)
    ft = reliable_checkpoint(ft)
    days = ft.select("day").distinct()
    first = days.agg(F.min("day")).scalar()
    cur = ft.filter(F.col("day") > first).withColumn("run", F.date_format("day", "yyyy-MM-dd"))
    prev = ft.withColumn("run", F.date_format(F.date_add("day", 1), "yyyy-MM-dd"))
    prev = prev.join(cur.select("run").distinct(), "run", "left_semi")
    return cur, prev


def _timeline_sql() -> str:
    feats = C.DRIFT_FEATURES
    longs = lambda side: "\nUNION ALL\n".join(
        f"SELECT run, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, {1 if side == 'cur' else 0} AS ca, "
        f"{0 if side == 'cur' else 1} AS cb FROM {side}" for f in feats)
    terms = " + ".join(f"{2.0 * (-1) ** (j - 1)!r} * exp({-2.0 * j * j!r} * lam * lam)" for j in range(1, 101))
    return Q.full_features_with() + f""",
ftd AS (SELECT *, CAST("timestamp" AS DATE) AS day FROM full_feat),
fd AS (SELECT min(day) AS f FROM ftd),
cur AS (SELECT strftime(day, '%Y-%m-%d') AS run, ftd.* FROM ftd, fd WHERE day > f),
runs AS (SELECT DISTINCT run FROM cur),
prev AS (SELECT * FROM (SELECT strftime(day + INTERVAL 1 DAY, '%Y-%m-%d') AS run, ftd.* FROM ftd)
         WHERE run IN (SELECT run FROM runs)),
u AS ({longs('cur')}
UNION ALL
{longs('prev')}),
cnt AS (SELECT run, feature, value, sum(ca) AS ca, sum(cb) AS cb FROM u WHERE value IS NOT NULL AND NOT isnan(value)
        GROUP BY 1, 2, 3),
tot AS (SELECT run, feature, sum(ca) AS na, sum(cb) AS nb FROM cnt GROUP BY 1, 2),
cum AS (SELECT *, sum(ca) OVER w AS cum_ca, sum(cb) OVER w AS cum_cb FROM cnt
        WINDOW w AS (PARTITION BY run, feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT run, feature, max(abs(cum_ca / na - cum_cb / nb)) AS ks, first(na) AS n_a, first(nb) AS n_b
      FROM cum JOIN tot USING (run, feature) GROUP BY 1, 2),
lm AS (SELECT *, (sqrt(CAST(n_a AS DOUBLE) * CAST(n_b AS DOUBLE) / CAST(n_a + n_b AS DOUBLE)) + 0.12
                  + 0.11 / sqrt(CAST(n_a AS DOUBLE) * CAST(n_b AS DOUBLE) / CAST(n_a + n_b AS DOUBLE))) * ks AS lam FROM g),
ksr AS (SELECT run, feature, ks,
               CASE WHEN ks <= 0 THEN 1.0 ELSE least(greatest(0.0 + {terms}, 0.0), 1.0) END AS p_value FROM lm)
SELECT run, feature AS signal, ks, p_value AS p, ks > {C.KS_THRESHOLD} AND p_value < {C.KS_P_THRESHOLD} AS drifted
FROM ksr"""


@register("dr_drift_timeline", _timeline_sql())
def q_timeline(spark, sf):
    a, b = _daily_runs(spark, sf)
    ks = QL.ks_2samp(a, b, C.DRIFT_FEATURES, by=("run",))
    dec = QL.drift_decision(ks, by=("run",))
    log = QL.heal_records(ks, dec)
    return QL.drift_timeline(log)


@register("dr_ks_exact", "WITH RECURSIVE " + FX.telemetry_sql() + """,
v AS (SELECT api_name, CAST("timestamp" AS DATE) AS day, hour("timestamp") < 12 AS early, unnest(['response_time', 'request_count']) AS feature,
             unnest([CAST(response_time AS DOUBLE), CAST(request_count AS DOUBLE)]) AS x FROM telemetry),
c AS (SELECT api_name, day, feature, x, count(*) FILTER (early) AS a, count(*) FILTER (NOT early) AS b FROM v GROUP BY ALL),
s AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER g AS n, sum(b) OVER g AS m FROM c
      WINDOW w AS (PARTITION BY api_name, day, feature ORDER BY x), g AS (PARTITION BY api_name, day, feature)),
d AS MATERIALIZED (SELECT api_name, day, feature, max(n)::BIGINT AS n, max(m)::BIGINT AS m, max(abs(ca * m - cb * n))::BIGINT AS gap FROM s WHERE n > 0 AND m > 0 GROUP BY ALL),
p(api_name, day, feature, n, m, gap, k, mass, hit) AS (
  SELECT *, 0::BIGINT, list_transform(range(n + 1), lambda i: CASE WHEN i = 0 THEN 1.0 ELSE 0.0 END::DOUBLE), 0.0::DOUBLE FROM d
  UNION ALL
  SELECT api_name, day, feature, n, m, gap, k + 1, list_transform(range(n + 1), lambda i: CASE WHEN abs(i * m - (k + 1 - i) * n) >= gap THEN 0.0 ELSE nxt[i + 1] END),
         hit + list_sum(list_transform(range(n + 1), lambda i: CASE WHEN abs(i * m - (k + 1 - i) * n) >= gap THEN nxt[i + 1] ELSE 0.0 END))
  FROM (SELECT *, list_transform(range(n + 1), lambda i: mass[i + 1] * greatest(m - (k - i), 0) / (n + m - k)
               + CASE WHEN i > 0 THEN mass[i] * (n - i + 1) / (n + m - k) ELSE 0.0 END) AS nxt FROM p WHERE k < n + m))
SELECT api_name, CAST(day AS VARCHAR) AS day, feature, n AS n_a, m AS n_b, round(gap / (n * m)::DOUBLE, 9) AS ks,
       round(CASE WHEN gap = 0 THEN 1.0 ELSE least(hit, 1.0) END, 9) AS p_value FROM p WHERE k = n + m""")
def q_ks_exact(spark, sf):
    """Mornings against afternoons of every API and day."""
    t = FX.telemetry(spark, sf).withColumn("day", F.to_date("timestamp").cast("string"))
    early = F.hour("timestamp") < 12
    ks = QL.ks_2samp(t.where(early), t.where(~early), ["response_time", "request_count"], by=("api_name", "day"), exact=True)
    return ks.select("api_name", "day", "feature", F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b"),
                     F.round("ks", 9).alias("ks"), F.round("p_value", 9).alias("p_value"))

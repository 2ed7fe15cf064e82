"""Registered queries: sources/sinks round trips (SRC-*, SNK-*), normalisers
(NRM-*), scalar functions (SCL-*), joins and set operations (JN-*, SET-*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import constants as C
from faultline.functions import scalars as S
from faultline.functions.scalars import hash_uniform_sql as HU
from faultline.functions.scalars import np_round_sql as R
from faultline.operators import joins as J
from faultline.operators import normalise as N
from faultline.plans.catalog import register
from faultline.session import scratch_dir
from faultline.sources import files
from faultline.sources import fixtures as FX

T_ = "WITH " + FX.telemetry_sql() + "\n"


def d(x) -> str:
    return f"{float(x)!r}::DOUBLE"


# --- sources / sinks ------------------------------------------------------------------------------
@register("src_csv_roundtrip", T_ + """
SELECT "timestamp", api_name, response_time, status_code, success, error_type, request_count FROM telemetry""")
def q_csv_roundtrip(spark, sf):
    """SNK-01 then SRC-01: write the telemetry as header CSV, scan it back with
    an explicit schema and timestamp coercion."""
    path = scratch_dir(spark, "telemetry_csv")
    t = FX.telemetry(spark, sf).select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        "api_name", "response_time", "status_code", "success", "error_type", "request_count")
    files.write_table(t, path, fmt="csv")
    back = files.read_telemetry_csv(spark, path)
    return back.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@register("src_tolerant_csv", T_ + """
SELECT api_name, count(*) AS rows, sum(1 - success) FILTER (event_id % 50 <> 1) AS failures FROM telemetry WHERE event_id % 50 <> 0 GROUP BY 1""")
def q_tolerant(spark, sf):
    """SRC-05: every 50th record is written with two fields too many and is
    dropped; the one after it lacks its last field and is kept."""
    path = scratch_dir(spark, "tolerant_csv")
    t = FX.telemetry(spark, sf)
    line = F.concat_ws(",", F.col("event_id").cast("string"), "api_name", F.when(F.col("event_id") % 50 != 1, F.col("success").cast("string")),
                       F.when(F.col("event_id") % 50 == 0, F.lit("### corrupt,line ###")))
    t.select(line.alias("value")).write.mode("overwrite").text(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("api_name", T.StringType()),
                           T.StructField("success", T.IntegerType())])
    back = files.read_csv_tolerant(spark, path, schema, header=False)
    return back.groupBy("api_name").agg(F.count(F.lit(1)).alias("rows"),
                                        F.sum(F.lit(1) - F.col("success")).alias("failures"))


@register("src_headerless_gz", """
SELECT o_orderkey AS orderkey, o_custkey AS custkey, o_orderstatus AS status FROM orders""")
def q_headerless(spark, sf):
    """SRC-04: headerless gzip text with supplied names."""
    path = scratch_dir(spark, "headerless")
    o = FX.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    o.write.mode("overwrite").option("header", False).option("compression", "gzip").csv(path)
    return files.read_headerless(spark, path, ["orderkey", "custkey", "status"], ["bigint", "bigint", "string"])


@register("src_pruned_scan", """SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_returnflag = 'R'""")
def q_pruned(spark, sf):
    """SRC-02: only two columns reach the scan (ReadSchema) and the filter is
    pushed into the parquet reader (PushedFilters)."""
    df = files.read_pruned(spark, FX.sf_path(sf, "lineitem"), ["l_orderkey", "l_extendedprice", "l_returnflag"])
    return df.filter(F.col("l_returnflag") == "R").select("l_orderkey", "l_extendedprice")


@register("snk_append_with_ids", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')
       + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders WHERE o_orderstatus <> 'F'""")
def q_append_ids(spark, sf):
    """SNK-02/03: two appends; ids continue from MAX(id)."""
    path = scratch_dir(spark, "append_ids")
    o = FX.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    files.append_with_ids(spark, o.filter(F.col("o_orderstatus") == "F"), path, ("o_orderdate", "o_orderkey"))
    files.append_with_ids(spark, o.filter(F.col("o_orderstatus") != "F"), path, ("o_orderdate", "o_orderkey"))
    return spark.read.parquet(path).select("o_orderkey", "id")


@register("snk_report_json_roundtrip", T_ + """
SELECT api_name, count(*) AS n, sum(1 - success) AS failures FROM telemetry GROUP BY 1""")
def q_report_json(spark, sf):
    """SNK-04 then a JSON read: summary rows as JSON documents."""
    path = scratch_dir(spark, "report_json")
    rep = (FX.telemetry(spark, sf).groupBy("api_name")
           .agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(1) - F.col("success")).alias("failures")))
    files.write_report_json(rep, path)
    return spark.read.schema("api_name string, n bigint, failures bigint").json(path)


# --- normalisers ------------------------------------------------------------------------------------
def card_raw(spark, sf):
    li = FX.table(spark, sf, "lineitem")
    mn = li.select(F.min("l_shipdate")).scalar()
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
        (F.unix_timestamp("l_shipdate") - F.unix_timestamp(F.lit(mn).cast("timestamp"))
         + F.col("l_linenumber") * 60).cast("double").alias("Time"),
        F.col("l_extendedprice").alias("Amount"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09), 1).otherwise(0).alias("Class"))


CARD_SQL = f"""WITH raw AS (
  SELECT l_orderkey * 8 + l_linenumber AS row_id,
         CAST(epoch(l_shipdate) - epoch((SELECT min(l_shipdate) FROM lineitem)) + l_linenumber * 60 AS DOUBLE) AS "Time",
         l_extendedprice AS "Amount",
         CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN 1 ELSE 0 END AS "Class" FROM lineitem)
SELECT row_id,
  CAST(TIMESTAMP '2025-01-01 00:00:00' + to_microseconds(CAST("Time" * 1e6 AS BIGINT)) AS TIMESTAMP) AS "timestamp",
  'transaction_api' AS api_name,
  greatest({d(8.0)}, {R(f"({d(-80.0)} * ln({d(1.0)} - {HU('row_id', 'cardfraud:rt')}) + {d(60.0)}) * CASE WHEN \"Class\" = 1 THEN {d(3.0)} + {d(5.0)} * {HU('row_id', 'cardfraud:mult')} ELSE {d(1.0)} END", 2)}) AS response_time,
  CASE WHEN "Class" = 1 THEN 500 ELSE 200 END AS status_code,
  CASE WHEN "Class" = 1 THEN 0 ELSE 1 END AS success,
  CASE WHEN "Class" = 1 THEN 'fraud_transaction_failure' END AS error_type,
  least(greatest(CAST(round_even(ln(coalesce("Amount", 0.0) + {d(2.0)}) * {d(3.0)}, 0) AS INT), 1), 500) AS request_count,
  0.0 AS error_rate_boost, 1.0 AS rt_multiplier,
  CASE WHEN "Class" = 1 THEN 'fraud_transaction' ELSE 'normal' END AS event_label
FROM raw"""


@register("nrm_card_fraud", CARD_SQL)
def q_card(spark, sf):
    return N.normalise_card_fraud(card_raw(spark, sf), "transaction_api")


def pay_raw(spark, sf):
    o = FX.table(spark, sf, "orders")
    mn = o.select(F.min("o_orderdate")).scalar()
    typ = (F.when(F.col("o_orderpriority").startswith("1"), "TRANSFER")
           .when(F.col("o_orderpriority").startswith("2"), "CASH_OUT")
           .when(F.col("o_orderpriority").startswith("3"), "PAYMENT")
           .when(F.col("o_orderpriority").startswith("4"), "CASH_IN").otherwise("debit"))
    return o.select(F.col("o_orderkey").alias("row_id"),
                    ((F.unix_timestamp("o_orderdate") - F.unix_timestamp(F.lit(mn).cast("timestamp"))) / 3600
                     + F.col("o_orderkey") % 24).cast("int").alias("step"),
                    typ.alias("type"), F.col("o_totalprice").alias("amount"),
                    F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("isFraud"))


def _paysim_sql():
    err = "CASE upper(type) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.PAYSIM_ERROR.items()) + " END"
    base = "coalesce(CASE upper(type) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in N.PAYSIM_BASE_RT.items()) \
        + " END, 150)"
    u1, u2 = HU("row_id", "paysim:noisea"), HU("row_id", "paysim:noiseb")
    normal = f"(sqrt({d(-2.0)} * ln(greatest({u1}, {d(1e-12)}))) * cos({d(2 * 3.141592653589793)} * {u2}))"
    mult = f"CASE WHEN \"isFraud\" = 1 THEN {d(2.5)} + {d(3.5)} * {HU('row_id', 'paysim:mult')} ELSE {d(1.0)} END"
    return f"""WITH raw AS (
  SELECT o_orderkey AS row_id,
         CAST(trunc((epoch(o_orderdate) - epoch((SELECT min(o_orderdate) FROM orders))) / 3600 + o_orderkey % 24) AS INT) AS step,
         CASE WHEN starts_with(o_orderpriority, '1') THEN 'TRANSFER' WHEN starts_with(o_orderpriority, '2') THEN 'CASH_OUT'
              WHEN starts_with(o_orderpriority, '3') THEN 'PAYMENT' WHEN starts_with(o_orderpriority, '4') THEN 'CASH_IN'
              ELSE 'debit' END AS type,
         o_totalprice AS amount, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS "isFraud" FROM orders)
SELECT row_id,
  CAST(TIMESTAMP '2025-01-01 00:00:00' + to_microseconds(CAST(CAST(step AS DOUBLE) * 3600.0 * 1e6 AS BIGINT)) AS TIMESTAMP) AS "timestamp",
  'transaction_api' AS api_name,
  greatest({d(8.0)}, {R(f"CAST({base} AS DOUBLE) * {mult} + {normal} * {d(20.0)}", 2)}) AS response_time,
  CASE WHEN "isFraud" = 1 THEN 500 ELSE 200 END AS status_code,
  CASE WHEN "isFraud" = 1 THEN 0 ELSE 1 END AS success,
  CASE WHEN "isFraud" = 1 THEN {err} END AS error_type,
  least(greatest(CAST(round_even(ln(1 + abs(coalesce(amount, 0.0))) * {d(2.0)}, 0) AS INT), 1), 500) AS request_count,
  0.0 AS error_rate_boost, 1.0 AS rt_multiplier,
  CASE WHEN "isFraud" = 1 THEN 'fraudulent_payment' ELSE 'normal' END AS event_label
FROM raw"""


@register("nrm_payments", _paysim_sql())
def q_paysim(spark, sf):
    return N.normalise_payments(pay_raw(spark, sf), "transaction_api")


def weblog_raw(spark, sf):
    pg = FX.table(spark, sf, "pages").select("page_id", "url")
    ev = FX.table(spark, sf, "events").select("event_id", "ts", "value")
    j = pg.join(ev, pg.page_id == ev.event_id, "left")
    status = (F.when(F.col("page_id") % 20 == 0, 500).when(F.col("page_id") % 20 == 1, 404)
              .when(F.col("page_id") % 20 == 2, 403).when(F.col("page_id") % 20 == 3, 503).otherwise(200))
    return j.select(F.col("page_id").alias("row_id"), F.col("ts").cast("string").alias("timestamp"),
                    status.cast("string").alias("status"), (F.col("value") * 1000).alias("bytes"), "url")


def _weblog_sql():
    from faultline.sources.fixtures import _http_error_type_sql
    ok = "status_code < 400"
    mult = f"CASE WHEN NOT ({ok}) THEN {d(1.5)} + {d(2.5)} * {HU('row_id', 'weblog:err')} ELSE {d(1.0)} END"
    base = f"greatest({d(8.0)}, {R(f'greatest(coalesce(TRY_CAST(bytes AS DOUBLE), 0.0), 0.0) / {d(1000.0)} + {d(50.0)}', 2)})"
    return f"""WITH raw AS (
  SELECT p.page_id AS row_id, CAST(e.ts AS VARCHAR) AS "timestamp",
         CAST(CASE WHEN p.page_id % 20 = 0 THEN 500 WHEN p.page_id % 20 = 1 THEN 404 WHEN p.page_id % 20 = 2 THEN 403
                   WHEN p.page_id % 20 = 3 THEN 503 ELSE 200 END AS VARCHAR) AS status,
         e.value * 1000 AS bytes, p.url
  FROM pages p LEFT JOIN events e ON p.page_id = e.event_id),
p AS (SELECT *, TRY_CAST("timestamp" AS TIMESTAMP) AS parsed, coalesce(TRY_CAST(status AS INT), 200) AS status_code FROM raw),
mn AS (SELECT min(date_trunc('day', parsed)) AS m FROM p)
SELECT row_id,
  coalesce(parsed + (TIMESTAMP '2025-01-01 00:00:00' - mn.m),
           TIMESTAMP '2025-01-01 00:00:00' + to_seconds(row_id * 60)) AS "timestamp",
  CASE WHEN regexp_matches(lower(url), 'trade|transaction|payment') THEN 'transaction_api' ELSE 'market_data_api' END AS api_name,
  {R(f'greatest({base} * {mult}, {d(8.0)})', 2)} AS response_time,
  status_code, CAST({ok} AS INT) AS success,
  {_http_error_type_sql('status_code')} AS error_type, 1 AS request_count,
  0.0 AS error_rate_boost, 1.0 AS rt_multiplier,
  CASE WHEN status_code < 400 THEN 'normal' WHEN status_code = 429 THEN 'ddos_attack'
       WHEN status_code IN (401, 403) THEN 'permission_error' WHEN status_code = 404 THEN 'bad_url'
       WHEN status_code >= 500 THEN 'vendor_outage' ELSE 'normal' END AS event_label
FROM p, mn"""


@register("nrm_weblog", _weblog_sql())
def q_weblog(spark, sf):
    return N.normalise_weblog(weblog_raw(spark, sf), "market_data_api")


KDD_TIES = ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]  # row ids repeat
KDD_LABELS = ["normal.", " Neptune.", "smurf", "mailbomb.", "saint", "rootkit.", "mystery"]


def kdd_raw(spark, sf):
    li = FX.table(spark, sf, "lineitem")
    lab = F.element_at(F.array(*[F.lit(x) for x in KDD_LABELS]), F.col("l_linenumber").cast("int"))
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), lab.alias("label"),
                     F.when(F.col("l_linenumber") != 3, F.col("l_quantity") / 5).alias("duration"),
                     F.when(F.col("l_linenumber") != 4, F.col("l_extendedprice")).alias("src_bytes"),
                     F.when(F.col("l_linenumber") != 5, F.col("l_linenumber") % 3).alias("num_failed_logins"), *KDD_TIES)


def _kdd_sql():
    """Written from the mapping's description: families by label list, one record a
    minute from 1 February 2024, every label but normal is an attack."""
    u = lambda s: HU("row_id", f"intrusion:{s}")
    groups = " ".join("WHEN lab IN ({}) THEN '{}'".format(", ".join(f"'{x}'" for x in labels), fam) for fam, labels in (
        ("normal", ["normal"]),
        ("dos", ["back", "land", "neptune", "pod", "smurf", "teardrop", "mailbomb", "apache2", "processtable", "udpstorm"]),
        ("probe", ["ipsweep", "nmap", "portsweep", "satan", "mscan", "saint"]),
        ("r2l", ["ftp_write", "guess_passwd", "imap", "multihop", "phf", "spy", "warezclient", "warezmaster"]),
        ("u2r", ["buffer_overflow", "loadmodule", "perl", "rootkit"])))
    labels = " ".join(f"WHEN {i + 1} THEN '{x}'" for i, x in enumerate(KDD_LABELS))
    return f"""WITH raw AS (
  SELECT l_orderkey * 8 + l_linenumber AS row_id, CASE l_linenumber {labels} END AS label,
         CASE WHEN l_linenumber <> 3 THEN l_quantity / 5 END AS duration, CASE WHEN l_linenumber <> 4 THEN l_extendedprice END AS src_bytes,
         CASE WHEN l_linenumber <> 5 THEN l_linenumber % 3 END AS num_failed_logins, {', '.join(KDD_TIES)} FROM lineitem),
c AS (SELECT *, regexp_replace(lower(trim(label)), '\\.+$', '') AS lab, row_number() OVER (ORDER BY row_id, {', '.join(KDD_TIES)}) - 1 AS i FROM raw),
f AS (SELECT *, CASE {groups} ELSE 'unknown' END AS fam, lab = 'normal' AS fine, {u('api')} AS pick FROM c)
SELECT row_id, TIMESTAMP '2024-02-01 00:00:00' + to_minutes(CAST(i AS BIGINT)) AS "timestamp",
       CASE WHEN pick < CASE WHEN fine THEN 0.3 ELSE 0.2 END THEN 'market_data_api' WHEN pick < CASE WHEN fine THEN 0.5 ELSE 0.4 END THEN 'crypto_api'
            WHEN pick < CASE WHEN fine THEN 0.7 ELSE 0.6 END THEN 'transaction_api' WHEN pick < CASE WHEN fine THEN 0.9 ELSE 0.8 END THEN 'forex_api'
            ELSE 'stock_price_api' END AS api_name, fam AS attack_family,
       least(greatest(coalesce(CAST(duration AS DOUBLE), 1.0), 0.1), 10.0) AS response_time,
       CASE WHEN fine THEN 200 ELSE 503 END AS status_code, CASE WHEN fine THEN 1 ELSE 0 END AS success,
       CASE WHEN NOT fine THEN 'network_attack_detected' END AS error_type,
       CAST(floor(least(greatest(coalesce(CAST(src_bytes AS DOUBLE), 1000.0) / 1000.0, 1.0), 10000.0)) AS INT) AS request_count,
       least(greatest(2.0 * coalesce(CAST(num_failed_logins AS DOUBLE), 0.0), 0.0), 8.0) AS burst_ratio,
       CASE WHEN fine THEN 1 ELSE CAST(floor(3.0 + {u('elevated')} * 3.0) AS INT) END AS n_apis_elevated,
       CASE WHEN fine THEN {u('stress')} * 0.2 ELSE 0.8 + {u('stress')} * 0.2 END AS systemic_stress_index,
       CASE WHEN fine THEN 0.1 + {u('corr')} * 0.3 ELSE 0.5 + {u('corr')} * 0.5 END AS corr_with_similar_api,
       'kaggle_nslkdd' AS data_source
FROM f"""


@register("nrm_intrusion", _kdd_sql())
def q_kdd(spark, sf):
    return N.map_intrusion(kdd_raw(spark, sf), order=("row_id", *KDD_TIES))


@register("nrm_integrate_report", "WITH card AS (" + CARD_SQL.replace("\n", "\n  ") + "),\npay AS ("
          + _paysim_sql() + ")\nSELECT 'card_fraud' AS data_source, count(*) AS rows_added, 1.0 - avg(success) AS failure_rate FROM card"
          + "\nUNION ALL SELECT 'paysim', count(*), 1.0 - avg(success) FROM pay")
def q_integrate(spark, sf):
    _, rep = N.integrate({"card_fraud": N.normalise_card_fraud(card_raw(spark, sf), "transaction_api"),
                          "paysim": N.normalise_payments(pay_raw(spark, sf), "transaction_api")})
    return rep


# --- scalar functions, lookups, set ops ------------------------------------------------------------
@register("scl_functions", T_ + f"""
SELECT event_id,
  CASE WHEN request_count / 100.0 >= 0.65 THEN 'HIGH' WHEN request_count / 100.0 >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
  regexp_replace(lower(trim(' ' || upper(api_name) || '..')), '\\.+$', '') AS clean,
  {d(1.0)} / ({d(1.0)} + exp(-(response_time / 100.0))) AS sig,
  CASE status_code WHEN 200 THEN 'ok' ELSE 'err' END AS status_class,
  date_trunc('minute', "timestamp") AS minute,
  CAST(json_extract_string(props_json, '$.k') AS INT) AS k,
  coalesce(CASE api_name {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.BACKUP_API.items())} END, 'none') AS backup
FROM (SELECT t.*, e.props AS props_json FROM telemetry t JOIN events e USING (event_id))""")
def q_scalars(spark, sf):
    t = FX.telemetry(spark, sf).join(FX.table(spark, sf, "events").select("event_id", F.col("props").alias("props_json")),
                                    "event_id")
    m = F.create_map(*[F.lit(x) for kv in C.BACKUP_API.items() for x in kv])
    return t.select(
        "event_id",
        S.risk_label(F.col("request_count") / F.lit(100.0)).alias("risk"),
        S.clean_label(F.concat(F.lit(" "), F.upper("api_name"), F.lit(".."))).alias("clean"),
        S.sigmoid(F.col("response_time") / F.lit(100.0)).alias("sig"),
        F.when(F.col("status_code") == 200, "ok").otherwise("err").alias("status_class"),
        S.floor_minute("timestamp").alias("minute"),
        S.json_path("props_json", "$.k").cast("int").alias("k"),
        S.map_get(m, F.col("api_name"), "none").alias("backup"))


@register("jn_event_tags", "WITH " + FX.tagged_telemetry_sql() + """
SELECT event_id, event_label, error_rate_boost, rt_multiplier FROM tagged""")
def q_event_tags(spark, sf):
    return FX.tagged_telemetry(spark, sf).select("event_id", "event_label", "error_rate_boost", "rt_multiplier")


@register("jn_least_risk_backup", T_ + f""", rates AS (SELECT api_name, 1.0 - avg(success) AS failure_rate FROM telemetry GROUP BY 1),
apos AS (SELECT * FROM (VALUES {", ".join(f"('{a}', {i + 1})" for i, a in enumerate(C.ALL_APIS))}) v(api_name, pos)),
rp AS (SELECT r.*, apos.pos FROM rates r JOIN apos USING (api_name)),
bk AS (SELECT a.api_name, a.failure_rate, b.api_name AS backup_api, b.failure_rate AS backup_rate,
              row_number() OVER (PARTITION BY a.api_name ORDER BY b.failure_rate, b.pos) AS rk
       FROM rp a JOIN rp b ON a.api_name <> b.api_name)
SELECT api_name, failure_rate, backup_api, backup_rate FROM bk WHERE rk = 1""")
def q_least_risk(spark, sf):
    rates = FX.telemetry(spark, sf).groupBy("api_name").agg((F.lit(1.0) - F.avg("success")).alias("failure_rate"))
    return J.least_risk_backup(rates)


@register("jn_fixed_backup", T_ + f""", rates AS (SELECT api_name, 1.0 - avg(success) AS failure_rate FROM telemetry GROUP BY 1)
SELECT r.api_name, r.failure_rate, b.api_name AS backup_api, b.failure_rate AS backup_rate
FROM rates r LEFT JOIN rates b ON b.api_name = CASE r.api_name {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.BACKUP_API.items())} END""")
def q_fixed_backup(spark, sf):
    rates = FX.telemetry(spark, sf).groupBy("api_name").agg((F.lit(1.0) - F.avg("success")).alias("failure_rate"))
    return J.fixed_backup(rates)


@register("set_upsert", T_ + """, existing AS (SELECT * FROM telemetry WHERE event_id % 3 <> 0),
batch AS (SELECT * FROM telemetry WHERE event_id % 3 = 0 OR event_id % 7 = 0)
SELECT event_id, api_name FROM existing WHERE "timestamp" NOT IN (SELECT "timestamp" FROM batch)
UNION ALL SELECT event_id, api_name FROM batch""")
def q_upsert(spark, sf):
    """SET-04 / JN-03: anti join on timestamp + union."""
    t = FX.telemetry(spark, sf).select("event_id", "api_name", "timestamp")
    existing = t.filter(F.col("event_id") % 3 != 0)
    batch = t.filter((F.col("event_id") % 3 == 0) | (F.col("event_id") % 7 == 0))
    return J.replace_overlap(existing, batch, "timestamp").select("event_id", "api_name")


@register("set_union_by_name", T_ + """
SELECT event_id, api_name, NULL::VARCHAR AS error_type FROM telemetry WHERE success = 1
UNION ALL SELECT event_id, api_name, error_type FROM telemetry WHERE success = 0""")
def q_union(spark, sf):
    """SET-01: union by name, missing columns NULL-filled."""
    t = FX.telemetry(spark, sf)
    a = t.filter("success = 1").select("event_id", "api_name")
    b = t.filter("success = 0").select("event_id", "api_name", "error_type")
    return a.unionByName(b, allowMissingColumns=True)


@register("set_minus_keys", T_ + """
SELECT event_id FROM telemetry WHERE event_id NOT IN (SELECT event_id FROM telemetry WHERE success = 0)""")
def q_minus(spark, sf):
    """SET-02: difference on keys (left anti join)."""
    t = FX.telemetry(spark, sf).select("event_id", "success")
    return t.join(t.filter("success = 0").select("event_id"), "event_id", "left_anti").select("event_id")


def flows_raw(spark, sf):
    li = FX.table(spark, sf, "lineitem")
    lab = (F.when(F.col("l_returnflag") == "R", F.concat(F.lit("DoS-"), F.col("l_linestatus")))
           .when(F.col("l_linenumber") == 7, F.lit("Malicious scan")).otherwise(F.lit("benign")))
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), lab.alias("label"),
                     F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") * 1000).alias("flow_duration"),
                     F.when(F.col("l_linenumber") != 4, F.col("l_quantity") * 40).alias("packets"))


def _flows_sql():
    u = lambda s: HU("row_id", f"flows:{s}")
    return f"""WITH raw AS (
  SELECT l_orderkey * 8 + l_linenumber AS row_id,
         CASE WHEN l_returnflag = 'R' THEN 'DoS-' || l_linestatus WHEN l_linenumber = 7 THEN 'Malicious scan'
              ELSE 'benign' END AS label,
         CASE WHEN l_linenumber <> 3 THEN l_extendedprice * 1000 END AS flow_duration,
         CASE WHEN l_linenumber <> 4 THEN l_quantity * 40 END AS packets FROM lineitem),
a AS (SELECT *, coalesce(regexp_matches(lower(label), 'attack|anomal|malici|dos|intrusion'), false) AS attack FROM raw)
SELECT row_id, least(greatest(coalesce(CAST(flow_duration AS DOUBLE), 1.0) / 1e6, 0.1), 10.0) AS response_time,
       CAST(least(greatest(coalesce(CAST(packets AS DOUBLE), 100.0), 1.0), 10000.0) AS INT) AS request_count,
       CASE WHEN attack THEN 0 ELSE 1 END AS success,
       CASE WHEN attack THEN 'network_attack_detected' END AS error_type,
       CASE WHEN attack THEN 503 ELSE 200 END AS status_code,
       CASE WHEN attack THEN CAST(floor(3.0 + {u('nel')} * 3.0) AS INT) ELSE 1 END AS n_apis_elevated,
       CASE WHEN attack THEN 0.7 + {u('stress')} * 0.3 ELSE {u('stress')} * 0.3 END AS systemic_stress_index,
       CASE WHEN attack THEN 3.0 + {u('burst')} * 5.0 ELSE {u('burst')} END AS burst_ratio,
       'kaggle_network_traffic' AS data_source
FROM a"""


@register("nrm_traffic_flows", _flows_sql())
def q_flows(spark, sf):
    return N.map_traffic_flows(flows_raw(spark, sf))


@register("nrm_card_fraud_v2", """WITH raw AS (
  SELECT l_orderkey * 8 + l_linenumber AS row_id, l_extendedprice AS "Amount", l_discount AS "V1", l_tax AS "V3",
         CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN 1 ELSE 0 END AS "Class" FROM lineitem),
mm AS (SELECT min("V1") AS a1, max("V1") AS b1, min("V3") AS a3, max("V3") AS b3 FROM raw)
SELECT row_id, 'transaction_api' AS api_name, least(greatest(CAST("Amount" AS DOUBLE) / 100.0, 0.1), 30.0) AS response_time,
       CASE WHEN "Class" = 1 THEN 0 ELSE 1 END AS success,
       CASE WHEN "Class" = 1 THEN 'fraud_transaction_failure' END AS error_type,
       CASE WHEN "Class" = 1 THEN 402 ELSE 200 END AS status_code,
       ("V1" - a1) / (b1 - a1) * 5.0 AS burst_ratio, ("V3" - a3) / (b3 - a3) * 1.0 AS systemic_stress_index,
       CASE WHEN "Class" = 1 THEN 0.15 ELSE 0.6 END AS corr_with_similar_api, 'kaggle_creditcard' AS data_source
FROM raw, mm""")
def q_card_v2(spark, sf):
    li = FX.table(spark, sf, "lineitem")
    raw = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
                    F.col("l_extendedprice").alias("Amount"), F.col("l_discount").alias("V1"),
                    F.col("l_tax").alias("V3"),
                    F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09), 1).otherwise(0).alias("Class"))
    return N.map_card_fraud_v2(raw)


@register("nrm_timeseries_labels", T_ + """
SELECT api_name AS file, "timestamp", 'system_series' AS api_name, response_time,
       CASE WHEN status_code = 503 THEN 503 ELSE 200 END AS status_code,
       CASE WHEN status_code = 503 THEN 0 ELSE 1 END AS success,
       CASE WHEN status_code = 503 THEN 'system_latency_anomaly' END AS error_type
FROM telemetry""")
def q_nab(spark, sf):
    """SRC-06 + JN-13 + NRM-06: anomaly labels (the 503 timestamps of each API
    series) written as JSON lines {file: [ts]}, read back, flagged onto the series."""
    t = FX.telemetry(spark, sf)
    series_df = t.select(F.col("api_name").alias("file"), "timestamp", F.col("response_time").alias("value"))
    path = scratch_dir(spark, "nab_labels")
    lab = t.filter(F.col("status_code") == 503).select(
        F.to_json(F.create_map(F.col("api_name"), F.array(F.col("timestamp").cast("string")))).alias("value"))
    lab.write.mode("overwrite").text(path)
    labels = files.read_anomaly_labels(spark, path)
    return N.normalise_timeseries(series_df, labels, "system_series")


NET_LABELS = ["Normal", " neptune ", "Exploits", "portsweep", "0", "zero-day", "Backdoor"]


def network_raw(spark, sf):
    li = FX.table(spark, sf, "lineitem")
    lab = F.element_at(F.array(*[F.lit(x) for x in NET_LABELS]), (F.col("l_linenumber") - 1) % 7 + 1)
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), lab.alias("label"),
                     (F.col("l_quantity") / 10).alias("dur"), F.col("l_extendedprice").alias("sbytes"),
                     F.col("l_shipdate").cast("string").alias("timestamp"))


def _network_sql():
    labs = ", ".join(f"'{x}'" for x in NET_LABELS)
    known = ", ".join(f"'{k}'" for k in N.NETWORK_LABELS)

    def pick(i, quote):
        parts = []
        for k, v in N.NETWORK_LABELS.items():
            val = "NULL" if v[i] is None else (f"'{v[i]}'" if quote else str(v[i]))
            parts.append(f"WHEN '{k}' THEN {val}")
        return "CASE key " + " ".join(parts) + " END"
    ms = f"greatest({d(8.0)}, {R(f'coalesce(TRY_CAST(dur AS DOUBLE), 0.0) * {d(1000.0)}', 2)})"
    raw = "coalesce(TRY_CAST(dur AS DOUBLE), 0.0)"
    mult = f"CASE WHEN success = 0 THEN {d(2.0)} + {d(3.0)} * {HU('row_id', 'network:attack')} ELSE {d(1.0)} END"
    return f"""WITH raw AS (
  SELECT l_orderkey * 8 + l_linenumber AS row_id, [{labs}][((l_linenumber - 1) % 7) + 1] AS label,
         l_quantity / 10 AS dur, l_extendedprice AS sbytes, CAST(l_shipdate AS VARCHAR) AS "timestamp" FROM lineitem),
med AS (SELECT quantile_cont({ms}, 0.5) AS m FROM raw),
k AS (SELECT *, lower(trim(label)) AS lab FROM raw),
k2 AS (SELECT *, CASE WHEN lab IN ({known}) THEN lab WHEN starts_with(lab, '0') OR lab = 'normal' THEN 'normal' ELSE '1' END AS key FROM k),
m AS (SELECT *, {pick(1, False)} AS success FROM k2)
SELECT row_id, coalesce(TRY_CAST("timestamp" AS TIMESTAMP), TIMESTAMP '2025-01-01' + to_seconds(CAST(row_id AS BIGINT))) AS "timestamp",
  'transaction_api' AS api_name,
  {R(f"greatest({d(8.0)}, CASE WHEN med.m > 50000 THEN {R(raw, 2)} ELSE {ms} END * {mult})", 2)} AS response_time,
  {pick(2, False)} AS status_code, success, {pick(3, True)} AS error_type,
  least(greatest(1, CAST(floor(ln(1 + abs(coalesce(TRY_CAST(sbytes AS DOUBLE), 1.0)))) AS INT)), 1000) AS request_count,
  0.0 AS error_rate_boost, 1.0 AS rt_multiplier, {pick(0, True)} AS event_label
FROM m, med"""


@register("nrm_network", _network_sql())
def q_network(spark, sf):
    return N.normalise_network(network_raw(spark, sf), "transaction_api")


# --- JN-04 / JN-05 with a calendar that is a table -------------------------------------------------
@register("jn_calendar_table", "WITH " + FX.telemetry_sql() + """,
cal AS (SELECT event_id AS seq, CASE WHEN event_id % 3 <> 0 THEN api_name END AS api, "timestamp" AS a, "timestamp" + to_microseconds(CAST(response_time * 600 AS BIGINT) * 1000000) AS b,
               'incident-' || status_code AS label, (event_id % 90) / 100.0::DOUBLE AS boost, 1.0 + (event_id % 7) AS mult FROM telemetry WHERE success = 0),
m AS (SELECT t.event_id, max(seq) FILTER (api IS NULL) AS g, max(seq) FILTER (api IS NOT NULL) AS o
      FROM telemetry t JOIN cal ON t."timestamp" BETWEEN a AND b AND (api IS NULL OR api = t.api_name) GROUP BY 1)
SELECT t.event_id, coalesce(o.label, g.label, 'normal') AS event_label, greatest(coalesce(g.boost, 0), coalesce(o.boost, 0))::DOUBLE AS error_rate_boost,
       greatest(coalesce(g.mult, 1), coalesce(o.mult, 1))::DOUBLE AS rt_multiplier
FROM telemetry t LEFT JOIN m USING (event_id) LEFT JOIN cal g ON g.seq = m.g LEFT JOIN cal o ON o.seq = m.o""")
def q_calendar_table(spark, sf):
    """Every failure opens an incident of up to some 80 hours, of its API or (one
    in three) of all: hundreds of entries hold each row."""
    from faultline.operators import intervals
    t = FX.telemetry(spark, sf)
    end = F.timestamp_micros(F.unix_micros(F.col("timestamp").cast("timestamp")) + F.round(F.col("response_time") * 600).cast("long") * 1_000_000)
    cal = t.where("success = 0").select(
        F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 != 0, F.col("api_name")).alias("api_name"), F.col("timestamp").alias("start"), end.alias("end"),
        F.concat(F.lit("incident-"), F.col("status_code").cast("string")).alias("event_label"),
        ((F.col("event_id") % 90) / F.lit(100.0)).alias("error_rate_boost"), (F.lit(1.0) + F.col("event_id") % 7).alias("rt_multiplier"))
    return intervals.tag_from_calendar(t, cal).select("event_id", "event_label", "error_rate_boost", "rt_multiplier")


@register("nrm_raw_file", T_ + """,
r AS (SELECT event_id, "timestamp" AS t, api_name, CASE WHEN event_id % 17 <> 0 THEN response_time END AS rt, status_code, success, request_count, data_source FROM telemetry)
SELECT CAST(event_id AS VARCHAR) AS "Ref", t + (TIMESTAMP '2025-01-01' - (SELECT date_trunc('day', min(t)) FROM r)) AS "timestamp", api_name, rt AS response_time, status_code,
       CASE WHEN event_id % 11 = 0 THEN 0 ELSE success END AS success, NULL::VARCHAR AS error_type, CASE WHEN event_id % 13 = 0 THEN 1 ELSE request_count END AS request_count,
       CASE WHEN event_id % 3 = 0 THEN 'raw-file' ELSE data_source END AS data_source FROM r""")
def q_raw_file(spark, sf):
    """The log as a CSV of strings under other names, its time split in two and its
    time column mostly unusable, with cells that do not parse."""
    t, i = FX.telemetry(spark, sf), F.col("event_id")
    said = F.when(i % 11 == 0, "").when(i % 2 == 0, F.col("success").cast("string")).otherwise(F.when(F.col("success") == 1, " True").otherwise("no"))
    raw = t.select(
        i.cast("string").alias("Ref"), F.when(i % 9 == 0, F.col("timestamp").cast("string")).otherwise("n/a").alias("TS"),
        F.date_format("timestamp", "yyyy-MM-dd").alias("Day"), F.date_format("timestamp", "HH:mm:ss.SSSSSS").alias("Clock"), F.col("api_name").alias("Endpoint"),
        F.when(i % 17 == 0, "n/a").otherwise(F.col("response_time").cast("string")).alias("LATENCY"), F.col("status_code").cast("string").alias("Http_Status"),
        said.alias("OK"), F.when(i % 13 == 0, "many").otherwise(F.col("request_count").cast("string")).alias("Hits"),
        F.when(i % 3 != 0, F.col("data_source")).alias("Source"))
    path = scratch_dir(spark, "raw_csv")
    raw.write.option("header", True).csv(path)
    back = spark.read.option("header", True).schema(raw.schema).csv(path)
    return N.normalise_raw(back, "raw-file", keep=("Ref",), target="2025-01-01 00:00:00")

"""Golden cases frozen from the reference behaviour (see FIXTURES.md §3)."""

import math

import pytest
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.operators import decide, metrics, policy, sampling, stateful, surrogate


def test_route_scenario_14_ticks(spark):
    A, B, Cr = "a", "b", "c"
    routes = [A, B, Cr]
    timeline = [
        {A: .12, B: .14, Cr: .20}, {A: .22, B: .15, Cr: .19}, {A: .41, B: .16, Cr: .21},
        {A: .58, B: .17, Cr: .22}, {A: .67, B: .19, Cr: .25}, {A: .63, B: .61, Cr: .28},
        {A: .40, B: .58, Cr: .24}, {A: .30, B: .50, Cr: .26}, {A: .28, B: .44, Cr: .27},
        {A: .31, B: .40, Cr: .25}, {A: .29, B: .38, Cr: .23}, {A: .61, B: .59, Cr: .57},
        {A: .58, B: .56, Cr: .60}, {A: .30, B: .33, Cr: .40},
    ]
    df = spark.createDataFrame([("s", t, r) for t, r in enumerate(timeline)], "session string, tick int, risks map<string,double>")
    out = stateful.route(df, "session", "tick", "risks", routes, A, 0.55, 0.35, 3, chunk_rows=4)
    got = [(r["active"], r["state"], r["alert"]) for r in out.orderBy("tick").collect()]
    expect = ([(A, "NORMAL", False)] * 2 + [(A, "PREWARM", False)] + [(B, "REROUTED", False)] * 2
              + [(Cr, "REROUTED", False)] * 4 + [(A, "NORMAL", False)] * 2 + [(A, "SYSTEMIC", True)] * 2
              + [(A, "NORMAL", False)])
    assert got == expect


@pytest.mark.parametrize("row,cat", [
    ({"systemic_stress_index": 0.7}, "cascade"),
    ({"n_apis_elevated": 2.0}, "cascade"),
    ({"burst_ratio": 2.5}, "overload"),
    ({"traffic_change": 1.5}, "overload"),
    ({"rt_multiplier": 2.0}, "timeout"),
    ({"latency_spike": 1.2}, "timeout"),
    ({"error_burst": 1.0}, "error_surge"),
    ({"error_rate_boost": 0.5}, "error_surge"),
    ({"instability_index": 0.1}, "intermittent"),
    ({"systemic_stress_index": 0.7, "burst_ratio": 5.0, "rt_multiplier": 3.0}, "cascade"),
    ({"burst_ratio": 5.0, "rt_multiplier": 3.0, "error_burst": 2.0}, "overload"),
])
def test_diagnose_branches_and_priority(spark, row, cat):
    cols = ["systemic_stress_index", "n_apis_elevated", "avg_error_rate_others", "max_error_rate_others",
            "burst_ratio", "traffic_change", "rt_multiplier", "latency_spike", "latency_slope", "error_burst",
            "error_rate_boost", "error_rate_rolling", "instability_index"]
    vals = tuple(float(row.get(c, 0.0)) for c in cols)
    df = spark.createDataFrame([vals], ", ".join(f"{c} double" for c in cols))
    r = decide.diagnose(df).select("diagnosis.*").first()
    assert r["category"] == cat
    exp_text = decide.explain(F.struct(F.lit(r["category"]).alias("category"),
                                       F.lit(r["confidence"]).alias("confidence")))
    txt = df.select(exp_text.alias("t")).first()["t"]
    assert txt.startswith(f"[{cat.upper()} ")


def test_conformal_qhat_scores_01_to_10(spark):
    df = spark.createDataFrame([(i / 10.0, 0) for i in range(1, 11)], "p double, y int")
    # |y - p| = p; level = min(1, ceil(11 * 0.9) / 10) = 1.0 -> max score
    assert metrics.conformal_level(10, 0.10) == 1.0
    assert metrics.conformal_q(df, 0.10) == pytest.approx(1.0)


def test_cap_failure_rate_keeps_16_failures(spark):
    rows = [(i, 1) for i in range(80)] + [(100 + i, 0) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, success int")
    out = sampling.cap_failure_rate(df, 0.20)
    assert out.filter("success = 0").count() == 16
    assert out.filter("success = 1").count() == 80


def test_cap_group_share_x_equals_90(spark):
    rows = ([(i, "other", 1) for i in range(300)] + [(1000 + i, "t", 0) for i in range(10)]
            + [(2000 + i, "t", 1) for i in range(200)])
    df = spark.createDataFrame(rows, "event_id long, api_name string, success int")
    out = sampling.cap_group_share(df, "t", 0.25)
    assert out.filter("api_name = 't' AND success = 1").count() == 90
    assert out.filter("api_name = 't' AND success = 0").count() == 10
    assert out.filter("api_name = 'other'").count() == 300


def test_reactive_policy_backup_rows(spark):
    outcomes = [0, 1, 1, 1, 0, 1, 0]
    df = spark.createDataFrame([(i, "x", i, 0.0, y) for i, y in enumerate(outcomes)],
                               "event_id long, api_name string, row_idx long, p double, y int")
    out = policy.reactive(df).orderBy("row_idx").select("row_idx", "action").collect()
    backup = [r["row_idx"] for r in out if r["action"] == "switch"]
    assert backup == [2, 4, 6]


@pytest.mark.parametrize("inp,probs,action,lead", [
    (("transaction_api", 0.015, 1.0, 0.08, 0.9, 0.0),
     [(0.079, 0.009, 0.149), (0.087, 0.006, 0.169), (0.096, 0.0, 0.191)], "none", None),
    (("transaction_api", 0.06, 2.2, 0.32, 1.7, 3.0),
     [(0.385, 0.217, 0.553), (0.35, 0.174, 0.527), (0.316, 0.131, 0.501)], "pre_warm", 15),
    (("crypto_api", 0.16, 5.5, 0.68, 2.3, 11.0),
     [(0.974, 0.921, 1.0), (0.857, 0.755, 0.959), (0.74, 0.578, 0.902)], "reroute", 1),
])
def test_surrogate_cases(spark, inp, probs, action, lead):
    df = spark.createDataFrame([inp], "api_name string, error_rate_rolling double, rt_multiplier double, "
                                      "error_volatility double, burst_ratio double, recent_failures double")
    r = surrogate.surrogate_forecast(df).first()
    for h, (p, lo, hi) in zip((1, 5, 15), probs):
        assert round(r[f"p_h{h}"], 3) == pytest.approx(p, abs=1e-9)
        assert round(r[f"lower_h{h}"], 3) == pytest.approx(lo, abs=1e-9)
        assert round(r[f"upper_h{h}"], 3) == pytest.approx(hi, abs=1e-9)
    assert r["recommended_action"] == action
    assert r["lead_time_min"] == lead


def test_remedy_lookup_and_decay(spark):
    df = spark.createDataFrame([("timeout", 0.8, 2), ("unknown", 0.5, 9)], "category string, risk double, ticks int")
    out = decide.decay_risk(decide.remedies(df), "risk", "ticks").orderBy("category").collect()
    t, u = out[0], out[1]
    assert t["remedy_action"] == "backoff" and t["risk_after"] == pytest.approx(0.8 - 2 * 0.12)
    assert u["remedy_action"] == "retry_jitter" and u["fix_complete"] and u["risk_after"] == pytest.approx(0.05)

import datetime as dt
import random

from faultline.operators import quality as QL


def test_states_merge_to_the_whole_table(spark):
    rng = random.Random(3)
    rows = [(dt.datetime(2024, 1, 1 + i % 5), rng.choice([None, float("nan"), 1.5, 2.0, -3.25, float(i % 17)]), i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "timestamp timestamp, x double, k int")
    whole = QL.merge_states(QL.baseline_state(df, ["x", "k"]))
    parts = QL.baseline_state(df.where("k = 0"), ["x", "k"]).union(QL.baseline_state(df.where("k <> 0"), ["x", "k"]))
    as_set = lambda d: sorted(map(tuple, d.collect()))
    assert as_set(QL.merge_states(parts)) == as_set(whole)
    x = sorted(r[1] for r in rows if r[1] is not None and r[1] == r[1])
    got = {r.feature: r for r in QL.state_summary(whole).collect()}["x"]
    assert (got.n_rows, got.n_distinct, got.lo, got.hi) == (len(x), len(set(x)), x[0], x[-1])
    for p in (25, 50, 75, 95):
        assert got[f"q{p}"] == x[-(-p * len(x) // 100) - 1]
    assert QL.state_summary(QL.merge_states(QL.baseline_state(df.limit(0), ["x"]))).collect() == []


def test_distance_of_two_states_equals_that_of_their_rows(spark):
    rng = random.Random(4)
    rows = [(dt.datetime(2024, 1, 1), round(rng.gauss(i % 2, 1), 1), i % 2) for i in range(700)]
    df = spark.createDataFrame(rows, "timestamp timestamp, x double, side int")
    a, b = df.where("side = 0"), df.where("side = 1")
    want = QL.ks_2samp(a, b, ["x"]).first()
    got = QL.ks_counts(*(QL.merge_states(QL.baseline_state(s, ["x"])) for s in (a, b))).first()
    assert (got.n_a, got.n_b) == (want.n_a, want.n_b)
    assert abs(got.ks - want.ks) < 1e-12 and abs(got.p_value - want.p_value) < 1e-12

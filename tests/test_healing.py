import datetime as dt
import json
import random

import pytest

from faultline import constants as C
from faultline.operators import healing

HI, LO, COOL = C.HIGH_RISK, C.LOW_RISK, C.ROUTE_COOLDOWN
FIX = {r[0]: r[1:] for r in C.REMEDIES}


def by_hand(ticks, rates):
    """The loop as described: set risk, tick remedies, step this API's engine, act."""
    risk = {a: rates.get(a, 0.10) for a in C.ALL_APIS}
    engine = {a: {"on": a, "label": "NORMAL", "cool": 0} for a in C.ALL_APIS}
    fixing, away, out = {}, set(), []
    for api, p, category in ticks:
        risk[api] = p
        for a in list(fixing):
            risk[a] = max(0.0, risk[a] - fixing[a][1])
            fixing[a][0] -= 1
            if fixing[a][0] <= 0:
                del fixing[a]
        e = engine[api]
        fit = [a for a in C.ALL_APIS if a != e["on"] and risk[a] < HI]
        target = min(fit, key=lambda a: risk[a]) if fit else None
        if all(r >= HI for r in risk.values()):
            e["label"] = "SYSTEMIC"
        elif risk[e["on"]] >= HI:
            if target is None:
                e["label"] = "SYSTEMIC"
            else:
                e["label"] = "REROUTED" if e["on"] == api else e["label"]
                e["on"], e["cool"] = target, COOL
        elif e["on"] == api:
            e["label"] = "PREWARM" if risk[api] >= LO else "NORMAL"
        elif risk[api] >= LO:
            e["cool"] = COOL
        else:
            e["cool"] -= 1
            if e["cool"] <= 0:
                e["on"], e["label"], e["cool"] = api, "NORMAL", 0
        phase = cause = fix = None
        if e["label"] == "REROUTED" and e["on"] != api:
            action = "switch"
            if api not in fixing:
                cause = category if category in FIX else "intermittent"
                fix, n, cut = FIX[cause]
                fixing[api], phase = [n, cut], "reroute+diagnose+fix"
                away.add(api)
        elif e["label"] == "PREWARM":
            action = "prewarm"
        elif e["label"] == "NORMAL" and e["on"] == api and api in away:
            action = phase = "restore"
            away.discard(api)
        elif e["label"] == "SYSTEMIC":
            action = "hold"
        else:
            action = "retry" if p > LO else "normal"
        out.append((action, e["label"], e["on"], phase, cause, fix))
    return out


def ticks(n, seed, quiet=()):
    rng, rows, level = random.Random(seed), [], dict.fromkeys(C.ALL_APIS, 0.2)
    for i in range(n):
        api = rng.choice([a for a in C.ALL_APIS if i < 40 or a not in quiet])
        if rng.random() < .04:
            shock = rng.choice([None, 0.97])
            level = {a: shock or rng.choice([0.1, 0.3, 0.5, 0.75, 0.9]) for a in level}
        p = round(min(1.0, max(0.0, level[api] + rng.choice([0.0, rng.gauss(0, 0.08)]))), 4)
        rows.append((api, p, rng.choice([*FIX, "other"])))
    return rows


@pytest.mark.parametrize("seed,quiet", [(1, ()), (2, (C.ALL_APIS[0], C.ALL_APIS[3])), (3, tuple(C.ALL_APIS[1:]))])
def test_cases_hold_exactly_for_the_entries_they_admit(seed, quiet):
    """Cases of chunks run from other entries, applied down the whole sequence, give the states of the plain run."""
    h = healing.Healer(C.ALL_APIS, HI, LO)
    rows = ticks(1500, seed, quiet)
    size = 9
    true = [h.start({})]
    for a in range(0, len(rows), size):
        run = healing.Run(h, true[-1])
        for r in rows[a: a + size]:
            run.tick(*r)
        true.append(json.loads(json.dumps(healing.leave(run.case(), true[-1]))))
        whole = {"risk": run.risk, "mode": run.mode, "remedy": run.remedy, "away": sorted(run.away)}
        assert json.loads(json.dumps(whole)) == true[-1]
    rng, met = random.Random(seed), 0
    for c, a in enumerate(range(0, len(rows), size)):
        for other in [h.start({}), *rng.sample(true, 12)]:
            run = healing.Run(h, other)
            for r in rows[a: a + size]:
                run.tick(*r)
            case = json.loads(json.dumps(run.case()))
            assert healing.holds(case, other)
            if healing.holds(case, true[c]):
                met += other != true[c]
                assert json.loads(json.dumps(healing.leave(case, true[c]))) == true[c + 1]
    assert met > 0


def frame(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(t0 + dt.timedelta(minutes=i), *r) for i, r in enumerate(rows)], "ts_bucket timestamp, api_name string, p double, category string")


def test_five_hundred_chunks_equal_the_plain_loop(spark):
    rows = ticks(12_000, 5) + ticks(18_500, 6, (C.ALL_APIS[2],))
    rates = {C.ALL_APIS[1]: 0.7}
    want = by_hand(rows, rates)
    assert {w[0] for w in want} == {"switch", "prewarm", "restore", "hold", "retry", "normal"}
    got = healing.self_heal(frame(spark, rows), rates, chunk_rows=60).orderBy("ts_bucket").collect()
    assert [(r.action, r.route_state, r.active, r.phase, r.root_cause, r.remedy_action) for r in got] == want


def test_no_ticks(spark):
    assert healing.self_heal(frame(spark, ticks(3, 1)).limit(0), {}).collect() == []

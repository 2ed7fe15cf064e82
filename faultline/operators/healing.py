"""The self-healing replay (DEC-12) and its summary (DEC-13).

All APIs share one risk map, every tick lowers the risk of APIs under repair, and each
API has a route engine of its own.  The state is not finite, so a stretch of ticks has
no small table of all its effects.  But a run looks at little of its entry: the modes
of the APIs that tick in it, the running remedies, and of risks not yet set anew only
on which side of some number they lie after so many decays (each a shift, clamped at
zero).  A run from one entry therefore gives a *case*: guards on what it looked at, and
an exit that is constant where it was decided inside and otherwise the entry's own part,
shifted and clamped.  A case holds for every entry that meets its guards.

Ticks are cut into chunks and every chunk is run, first from the state that the ticks
just before it lead to from the start state.  A walk over the chunks' cases then names,
for each chunk, the entry that its predecessors' exits give, and which of these no case
covers; those are run again, in parallel, each from its entry.  The first uncovered
chunk always has its true entry, so the walk gets further each round; as remedies end
after a few ticks and modes settle within some hundred, long chunks take two or three
walks.  States travel between the two as rows of written tables.  The walk reads a row per chunk and case: chunks follow the number of
(minute, API) ticks, which the time span bounds, over ``chunk_rows``.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.operators import series
from faultline.operators.stateful import route_machine
from faultline.session import reliable_checkpoint, ship_package

HEAL_OUT = ("action string, route_state string, active string, phase string, root_cause string, "
            "remedy_action string")
REMEDY = {name: (action, ticks, cut) for name, action, ticks, cut in C.REMEDIES}
#: action by (label, traffic on the API's own route); others retry or pass.
HEAL_ACTION = {("REROUTED", False): "switch", ("PREWARM", True): "prewarm", ("PREWARM", False): "prewarm",
               ("SYSTEMIC", True): "hold", ("SYSTEMIC", False): "hold"}


class Healer:
    """Thresholds and the route engines of all APIs."""

    def __init__(self, apis, hi: float, lo: float):
        self.apis, self.hi, self.lo = list(apis), hi, lo
        self.engine = {a: route_machine(self.apis, a, C.ROUTE_COOLDOWN) for a in self.apis}

    def start(self, rates: dict) -> dict:
        """Risk and route mode by API, remedies as (ticks left, cut), APIs that await a restore."""
        return {"risk": {a: float(rates.get(a, 0.10)) for a in self.apis}, "mode": {a: self.engine[a].start[0] for a in self.apis},
                "remedy": {}, "away": []}


def decayed(risk: float, cut: float, times: int) -> float:
    for _ in range(times):
        risk = max(0.0, risk - cut)
    return risk


class Run:
    """The state while ticks pass, and what of the entry was looked at."""

    def __init__(self, healer: Healer, entry: dict):
        self.h, self.entry = healer, entry
        self.risk, self.mode, self.away = dict(entry["risk"]), dict(entry["mode"]), set(entry["away"])
        self.remedy = {a: list(x) for a, x in entry["remedy"].items()}
        self.age = dict.fromkeys(healer.apis, 0)  # decays of risks that are still the entry's
        self.ticked: set = set()
        self.low: dict = {}  # (api, age) -> (bound, 0 if it may be met else 1), the greatest seen
        self.high: dict = {}  # (api, age) -> (bound, 0 if it may not be met else 1), the least seen
        self.pairs: set = set()

    def _bound(self, api: str, is_under: bool, bound: float, strict: bool) -> None:
        """Risk < bound (strict) or <= bound was found to hold or not."""
        if api in self.age:
            key = (api, self.age[api])
            if is_under:
                self.high[key] = min(self.high.get(key, (float("inf"), 1)), (bound, 0 if strict else 1))
            else:
                self.low[key] = max(self.low.get(key, (float("-inf"), 0)), (bound, 0 if strict else 1))

    def below(self, api: str, bound: float) -> bool:
        out = self.risk[api] < bound
        self._bound(api, out, bound, True)
        return out

    def least(self, of: list[str]) -> str:
        """The API of least risk, the first of equals."""
        best = min(of, key=lambda a: self.risk[a])  # min keeps the first
        for other in of:
            if other != best:
                if best in self.age and other in self.age:
                    self.pairs.add((best, self.age[best], other, self.age[other], of.index(best) < of.index(other)))
                elif best in self.age:
                    self._bound(best, True, self.risk[other], of.index(other) < of.index(best))
                else:
                    self._bound(other, False, self.risk[best], of.index(best) < of.index(other))
        return best

    def _symbol(self, api: str, active: str) -> str:
        """What the engine of ``api``, now on ``active``, needs of the risks (the
        classes of ``stateful.route_symbol``; parts it won't read are blank)."""
        apis, hi, lo = self.h.apis, self.h.hi, self.h.lo
        bad = not any(self.below(a, hi) for a in [api, *(x for x in apis if x != api)])
        level, target = 0, "-"
        if not bad:
            level = 2 if not self.below(active, hi) else 1 if not self.below(active, lo) else 0
            if level == 2 or level == 1 and active == api:
                fit = [a for a in apis if a != active and self.below(a, hi)]
                target = str(apis.index(self.least(fit))) if fit else "-"
        at = apis.index(active)
        levels = [str(level) if i == at else "0" for i in range(len(apis))]
        targets = [target if i == at else "-" for i in range(len(apis))]
        return ",".join([str(int(bad)), str(int(self.risk[api] < lo)), *levels, *targets])

    def tick(self, api: str, p: float, category: str) -> tuple:
        h = self.h
        self.risk[api] = float(p)
        self.age.pop(api, None)
        self.ticked.add(api)
        for a, (n, cut) in list(self.remedy.items()):
            self.risk[a] = max(0.0, self.risk[a] - cut)
            if a in self.age:
                self.age[a] += 1
            if n > 1:
                self.remedy[a][0] = n - 1
            else:
                del self.remedy[a]
        engine = h.engine[api]
        mode = engine.move(self.mode[api], self._symbol(api, engine.modes[self.mode[api]][0]))[0]
        self.mode[api] = mode
        active, label, _ = engine.modes[mode]
        action, phase, cause, fix = HEAL_ACTION.get((label, active == api)), None, None, None
        if action == "switch" and api not in self.remedy:
            cause = category if category in REMEDY else "intermittent"
            fix, ticks, cut = REMEDY[cause]
            self.remedy[api], phase = [ticks, cut], "reroute+diagnose+fix"
            self.away.add(api)
        elif (label, active) == ("NORMAL", api) and api in self.away:
            action = phase = "restore"
            self.away.discard(api)
        return action or ("retry" if p > h.lo else "normal"), label, active, phase, cause, fix

    def case(self) -> dict:
        e, seen = self.entry, sorted(self.ticked)
        return {"mode": {a: e["mode"][a] for a in seen}, "away": {a: a in e["away"] for a in seen}, "remedy": e["remedy"],
                "low": [[*k, *v] for k, v in self.low.items()], "high": [[*k, *v] for k, v in self.high.items()], "pairs": sorted(self.pairs),
                "exit": {"mode": {a: self.mode[a] for a in seen}, "away": {a: a in self.away for a in seen}, "remedy": self.remedy,
                         "risk": {a: r for a, r in self.risk.items() if a not in self.age}, "age": self.age}}


def _after(state: dict, api: str, age: int) -> float:
    return decayed(state["risk"][api], state["remedy"].get(api, (0, 0.0))[1], age)


def holds(case: dict, s: dict) -> bool:
    """Whether a run from ``s`` decides everything as the case's run did."""
    return (all(s["mode"][a] == m for a, m in case["mode"].items()) and all((a in s["away"]) == x for a, x in case["away"].items())
            and {a: tuple(x) for a, x in s["remedy"].items()} == {a: tuple(x) for a, x in case["remedy"].items()}
            and all(_after(s, a, k) > b or not over and _after(s, a, k) == b for a, k, b, over in case["low"])
            and all(_after(s, a, k) < b or met and _after(s, a, k) == b for a, k, b, met in case["high"])
            and all(_after(s, a, i) < _after(s, b, k) or first and _after(s, a, i) == _after(s, b, k) for a, i, b, k, first in case["pairs"]))


def leave(case: dict, s: dict) -> dict:
    """The exit of a case entered with ``s``."""
    x = case["exit"]
    away = (set(s["away"]) - {a for a, on in x["away"].items() if not on}) | {a for a, on in x["away"].items() if on}
    return {"risk": x["risk"] | {a: _after(s, a, k) for a, k in x["age"].items()}, "mode": s["mode"] | x["mode"], "remedy": x["remedy"], "away": sorted(away)}


def _ticks(pdf: pd.DataFrame):
    return pdf.sort_values("_i")[["_i", "api_name", "p", "category"]].itertuples(index=False)


def self_heal(ticks: DataFrame, rates: dict, order=("ts_bucket", "api_name"), chunk_rows: int = 50_000, warm_rows: int = 1000) -> DataFrame:
    """DEC-12 over scored ticks (ts_bucket, api_name, p, category) in one global
    order: the action, route, phase and remedy of every tick.  An API without a
    rate starts at risk 0.10."""
    ship_package(ticks.sparkSession)
    healer = Healer(C.ALL_APIS, C.HIGH_RISK, C.LOW_RISK)
    start = json.dumps(healer.start(rates))
    idx = series.with_row_index(ticks, key=None, order=order, idx_col="_i")
    idx = reliable_checkpoint(idx.withColumn("_chunk", F.floor(F.col("_i") / chunk_rows).cast("long")))
    slim = idx.select("_i", "_chunk", "api_name", "p", "category")

    def first_cases(pdf: pd.DataFrame) -> pd.DataFrame:
        run = Run(healer, json.loads(start))
        for _, api, p, category in _ticks(pdf[~pdf["_home"]]):
            run.tick(api, p, category)
        run = Run(healer, {"risk": run.risk, "mode": run.mode, "remedy": run.remedy, "away": sorted(run.away)})
        home = pdf[pdf["_home"]]
        for _, api, p, category in _ticks(home):
            run.tick(api, p, category)
        return pd.DataFrame([(int(pdf["_blk"].iloc[0]), json.dumps(run.case()))] if len(home) else [], columns=["chunk", "case"])

    def run_chunk(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf) and len(entry):
            for raw in entry["entry"]:
                run = Run(healer, json.loads(raw))
                for _, api, p, category in _ticks(pdf):
                    run.tick(api, p, category)
                out.append((int(pdf["_chunk"].iloc[0]), json.dumps(run.case())))
        return pd.DataFrame(out, columns=["chunk", "case"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = json.loads(start), []
        for chunk, mine in pdf.groupby("chunk"):
            cases = [json.loads(x) for x in mine["case"]]
            case = next((c for c in cases if holds(c, state)), None)
            out.append((chunk, json.dumps(state), case is not None))
            state = leave(case or cases[-1], state)  # of an uncovered chunk the likely exit, to be confirmed by the next walk
        return pd.DataFrame(out, columns=["chunk", "entry", "known"])

    def replay(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        run = Run(healer, json.loads(entry["entry"].iloc[0]))
        return pd.DataFrame([(i, *run.tick(api, p, category)) for i, api, p, category in _ticks(pdf)],
                            columns=["_i", *[x.split()[0] for x in HEAL_OUT.split(", ")]])

    near = series.blocked(slim, "_i", chunk_rows, back=min(warm_rows, chunk_rows))
    cases = reliable_checkpoint(near.groupBy("_blk").applyInPandas(first_cases, "chunk long, case string"))
    while True:
        walked = reliable_checkpoint(cases.groupBy().applyInPandas(walk, "chunk long, entry string, known boolean"))
        wanted = walked.where("not known").select("chunk", "entry")
        if wanted.isEmpty():
            break
        cases = reliable_checkpoint(cases.unionByName(
            slim.groupBy("_chunk").cogroup(wanted.groupBy("chunk")).applyInPandas(run_chunk, "chunk long, case string")))
    out = slim.groupBy("_chunk").cogroup(walked.groupBy("chunk")).applyInPandas(replay, f"_i long, {HEAL_OUT}")
    return idx.drop("_chunk").join(out, "_i").drop("_i")


def heal_summary(events: DataFrame) -> DataFrame:
    """DEC-13: counts by action, by root cause and by remedy (long form)."""
    fixed = F.col("phase") == "reroute+diagnose+fix"
    pairs = F.array(F.struct(F.lit("action").alias("dimension"), F.col("action").alias("value")),
                    F.when(fixed, F.struct(F.lit("root_cause").alias("dimension"), F.col("root_cause").alias("value"))),
                    F.when(fixed, F.struct(F.lit("remedy").alias("dimension"), F.col("remedy_action").alias("value"))))
    return events.select(F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("x")).groupBy("x.dimension", "x.value").count()

"""Order-dependent state machines (DEC-11, DEC-14, DEC-16).

The route engine, circuit breaker and canary are tables of rules over a few modes
(``faultline.operators.machines`` runs them exactly over sequences of any length).
The self-healing replay is in ``faultline.operators.healing``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.operators import machines, series

# --- DEC-11 route engine ---------------------------------------------------------------------
#: label, target and countdown of each action; None keeps the label.  Columns:
#: (label, where the traffic goes, countdown, alert).
ROUTE_ACTIONS = {
    "serve": ("NORMAL", "stay", "keep", False),
    "prewarm": ("PREWARM", "stay", "keep", False),
    "reroute": ("REROUTED", "backup", "full", False),
    "rehop": (None, "backup", "full", False),
    "cooldown": (None, "stay", "less", False),
    "failback": ("NORMAL", "primary", "none", False),
    "hold_backup": (None, "stay", "full", False),
    "hold_alert_systemic": ("SYSTEMIC", "stay", "keep", True),
    "hold_alert_no_backup": ("SYSTEMIC", "stay", "keep", True),
    "hold_alert_backup_degraded": ("SYSTEMIC", "stay", "keep", True),
}
#: action by (traffic on the primary, level of the active route: 2 is at or above
#: hi, 1 at or above lo; a backup below hi exists).
ON_ROUTE = {
    (True, 2, True): "reroute", (True, 2, False): "hold_alert_no_backup",
    (True, 1, True): "prewarm", (True, 1, False): "prewarm", (True, 0, True): "serve", (True, 0, False): "serve",
    (False, 2, True): "rehop", (False, 2, False): "hold_alert_backup_degraded",
}


def route_symbol(risks: Column, routes: list[str], primary: str, hi: float, lo: float) -> Column:
    """A row's risks as classes: "all bad, primary calm, level of each route, best
    other route of each route".  Missing risks are 1.0 as a candidate and for the
    primary's recovery, 0.0 for the active route."""
    def risk(r: str, missing: float) -> Column:
        return F.coalesce(F.try_element_at(risks, F.lit(r)).cast("double"), F.lit(missing))

    def best(r: str) -> Column:
        others = [F.struct(risk(x, 1.0).alias("v"), F.lit(i).alias("i")) for i, x in enumerate(routes) if x != r]
        fit = F.filter(F.array(*others), lambda o: o.v < hi) if others else F.array()
        return F.coalesce(F.array_min(fit).i.cast("string"), F.lit("-")) if others else F.lit("-")

    bad = F.lit(True)
    for r in routes:
        bad = bad & (risk(r, 1.0) >= hi)
    levels = [F.when(risk(r, 0.0) >= hi, "2").when(risk(r, 0.0) >= lo, "1").otherwise("0") for r in routes]
    return F.concat_ws(",", F.when(bad, "1").otherwise("0"), F.when(risk(primary, 1.0) < lo, "1").otherwise("0"), *levels, *[best(r) for r in routes])


def route_machine(routes: list[str], primary: str, cooldown: int) -> machines.Machine:
    """Modes (active route, label, countdown); outputs (action, prewarmed route, alert)."""
    labels = ("NORMAL", "PREWARM", "REROUTED", "SYSTEMIC")
    modes = [(r, label, c) for r in routes for label in labels for c in range(cooldown + 1)]
    n = len(routes)

    def rule(mode, symbol):
        active, label, count = mode
        part = symbol.split(",")
        at = routes.index(active)
        target = part[2 + n + at]
        level, calm = int(part[2 + at]), part[1] == "1"
        action = "hold_alert_systemic" if part[0] == "1" else ON_ROUTE.get((active == primary, level, target != "-"))
        if action is None:  # on a healthy backup
            action = "hold_backup" if not calm else "failback" if count <= 1 else "cooldown"
        new_label, where, countdown, alert = ROUTE_ACTIONS[action]
        to = {"stay": active, "primary": primary}.get(where) or routes[int(target)]
        left = {"keep": count, "full": cooldown, "less": count - 1, "none": 0}[countdown]
        warm = routes[int(target)] if action == "prewarm" and target != "-" else None
        return (to, new_label or label, left), (action, warm, alert)

    return machines.Machine(modes, (primary, "NORMAL", 0), rule)


ROUTE_OUT = "active string, state string, alert boolean, prewarm string, action string"


def route_outputs(before, after, out) -> tuple:
    return after[0], after[1], out[2], out[1], out[0]


def route(df: DataFrame, session: str, tick: str, risks: str, routes, primary: str, hi: float = C.ROUTE_HI,
          lo: float = C.ROUTE_LO, cooldown: int = C.ROUTE_COOLDOWN, chunk_rows: int = 50_000) -> DataFrame:
    """DEC-11 over rows (session, tick, risks map<route, risk>)."""
    routes = list(routes)
    d = df.withColumn("_symbol", route_symbol(F.col(risks), routes, primary, hi, lo)).withColumn("_zero", F.lit(0.0))
    out = machines.run(route_machine(routes, primary, cooldown), d, session, (tick,), "_zero", "_symbol", route_outputs, ROUTE_OUT, chunk_rows)
    return out.drop("_symbol", "_zero")


# --- DEC-14 circuit breaker ------------------------------------------------------------------
BREAKER_OUT = "state_before string, allowed boolean, state_after string, event string"


def breaker_machine(fails: int = C.BREAKER_FAILS, probe_s: float = C.BREAKER_PROBE_SECONDS) -> machines.Machine:
    """Closed with a streak of failures, or open; open lets one probe through
    after ``probe_s`` seconds.  Outputs (allowed, event)."""
    table = {(("CLOSED", k), "true"): (("CLOSED", 0), (True, None)) for k in range(fails)}
    table |= {(("CLOSED", k), "false"): (("CLOSED", k + 1), (True, None)) for k in range(fails - 1)}
    table |= {(("CLOSED", fails - 1), "false"): (("OPEN", 0), (True, "opened")),
              (("OPEN", 0), "true"): (("CLOSED", 0), (True, "closed")), (("OPEN", 0), "false"): (("OPEN", 0), (True, "reopened"))}
    return machines.Machine([("CLOSED", k) for k in range(fails)] + [("OPEN", 0)], ("CLOSED", 0), lambda mode, ok: table[mode, ok],
                            {("OPEN", 0): probe_s}, lambda mode, ok: (False, None))


def circuit_breaker(df: DataFrame, backend: str = "backend", ts: str = "ts_s", ok: str = "ok",
                    order=("ts_s", "event_id"), chunk_rows: int = 50_000) -> DataFrame:
    """DEC-14 over a request log (backend, ts seconds, ok)."""
    return machines.run(breaker_machine(), df, backend, order, ts, ok, lambda before, after, out: (before[0], out[0], after[0], out[1]),
                        BREAKER_OUT, chunk_rows)


# --- DEC-16 canary restore -------------------------------------------------------------------
CANARY_OUT = "route string, canary_stage int, primary_fraction double, event string"


def canary_machine(steps=tuple(C.CANARY_STEPS), hold_s: float = C.CANARY_HOLD_SECONDS) -> machines.Machine:
    """Stage None: all traffic on the primary; 0: all on the backup; k: step k of
    the canary, held ``hold_s`` seconds.  Symbols: confirmed "up" or "down", "-"."""
    name = [f"canary_{int(s * 100)}pct" for s in steps]
    table = {(None, "down"): (0, "reroute"), (0, "up"): (1, name[0])}
    table |= {(k, "up"): (k + 1, name[k]) if k + 1 < len(steps) else (None, "full_restore") for k in range(1, len(steps))}
    stages = list(range(1, len(steps)))
    timed = set(stages)
    return machines.Machine([None, 0, *stages], None, lambda mode, s: table.get((mode, s), None if mode in timed else (mode, None)),
                            {k: hold_s for k in stages}, lambda mode, s: None)


def canary(df: DataFrame, backend: str = "backend", ts: str = "ts_s", healthy: str = "healthy",
           order=("ts_s", "event_id"), chunk_rows: int = 50_000, confirm: int = 2, steps=tuple(C.CANARY_STEPS)) -> DataFrame:
    """DEC-16 over health polls (backend, ts seconds, healthy).  A reading counts
    once ``confirm`` polls in a row agree."""
    idx = series.with_row_index(df, key=backend, order=order, idx_col="_pos")
    near = series.blocked(idx, "_pos", 4096, back=confirm - 1)
    w = Window.partitionBy(backend, "_blk").orderBy("_pos")
    agree = F.lit(True)
    for k in range(1, confirm):
        agree = agree & F.coalesce(F.lag(healthy, k).over(w) == F.col(healthy), F.lit(False))
    d = near.withColumn("_symbol", F.when(agree & F.col(healthy), "up").when(agree & ~F.col(healthy), "down").otherwise("-"))
    d = d.where("_home").drop("_blk", "_home", "_pos")

    def outputs(before, after, event) -> tuple:
        share = 1.0 if after is None else float(steps[after - 1]) if after else 0.0
        return "primary" if after is None else "backup", after or 0, share, event
    return machines.run(canary_machine(steps), d, backend, order, ts, "_symbol", outputs, CANARY_OUT, chunk_rows).drop("_symbol")

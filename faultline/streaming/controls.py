"""Controls as streams (STR-05): circuit breaker, canary restore, risk decay.

Rows pass in event-time order (``faultline.streaming.ordered``).  The breaker and the
canary step the machines of the batch replay (DEC-14, DEC-16), so stream and batch
agree row by row; the mode and the time it was entered are one value state, the last
poll and its streak another.  The decay keeps the running remedy and wakes itself by
event-time timers, so that risk falls also while no row of the API arrives.  A key
that is back at its start after ``idle_s`` seconds without rows leaves no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import constants as C
from faultline.operators import stateful
from faultline.session import ship_package
from faultline.streaming.ordered import InOrder

IDLE_S = 24 * 3600
ROW = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts_us", T.LongType()), T.StructField("ok", T.BooleanType())])
MODE = T.StructType([T.StructField("mode", T.LongType()), T.StructField("since", T.DoubleType())])
POLL = T.StructType([T.StructField("healthy", T.BooleanType()), T.StructField("streak", T.LongType())])
FIX = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts_us", T.LongType()), T.StructField("category", T.StringType()),
                    T.StructField("risk", T.DoubleType())])
REPAIR = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("start_us", T.LongType()), T.StructField("category", T.StringType()),
                       T.StructField("risk", T.DoubleType()), T.StructField("ticks", T.LongType())])
DECAY_OUT = T.StructType([T.StructField("api_name", T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("tick_us", T.LongType()),
                          T.StructField("remedy_action", T.StringType()), T.StructField("ticks", T.LongType()),
                          T.StructField("risk_after", T.DoubleType()), T.StructField("fix_complete", T.BooleanType())])


class MachineStream(InOrder):
    """A machine over a key's rows; ``confirm`` readings in a row make a symbol of a
    poll ("up", "down", else "-"); without it the symbol is the row's own value."""

    held, order = ROW, ("ts_us", "event_id")

    def __init__(self, machine, outputs, names: list[str], confirm: int | None, idle_s: float):
        self.machine, self.outputs, self.names, self.confirm, self.idle_us = machine, outputs, names, confirm, int(idle_s * 1e6)

    def setup(self, handle) -> None:
        self.mode = handle.getValueState("mode", MODE)
        self.poll = handle.getValueState("poll", POLL)

    def _symbol(self, ok: bool, last: tuple) -> tuple[str, tuple]:
        if self.confirm is None:
            return "true" if ok else "false", last
        streak = last[1] + 1 if last[0] == ok else 1
        return ("up" if ok else "down") if streak >= self.confirm else "-", (ok, streak)

    def due(self, key, ready: pd.DataFrame, watermark: int) -> Iterator[pd.DataFrame]:
        state = self.machine.start
        if self.mode.exists():
            mode, since = self.mode.get()
            state = int(mode), since
        last = tuple(self.poll.get()) if self.poll.exists() else (None, 0)
        rows = []
        for event, us, ok in ready.itertuples(index=False):
            symbol, last = self._symbol(bool(ok), last)
            before = state
            state, out = self.machine.step(state, us / 1e6, symbol)
            rows.append((key[0], event, us, bool(ok), *self.outputs(self.machine.modes[before[0]], self.machine.modes[state[0]], out)))
        if rows:
            self.mode.update((state[0], state[1]))
            if self.confirm is not None:
                self.poll.update(last)
            self.wake((rows[-1][2] + self.idle_us) // 1000)
            yield pd.DataFrame(rows, columns=["backend", "event_id", "ts_us", "ok", *self.names])
        elif state == self.machine.start and self.mode.exists() and not self.poll.exists() and not self.pending.exists():
            self.mode.clear()  # as if the key had never been seen


def _machine_stream(stream: DataFrame, machine, outputs, out: str, confirm: int | None, delay: str, idle_s: float) -> DataFrame:
    ship_package(stream.sparkSession)
    rows = stream.withWatermark("timestamp", delay).select("timestamp", "backend", "event_id", F.unix_micros("timestamp").alias("ts_us"), "ok")
    names = [x.split()[0] for x in out.split(", ")]
    schema = f"backend string, event_id long, ts_us long, ok boolean, {out}"
    return rows.groupBy("backend").transformWithStateInPandas(MachineStream(machine, outputs, names, confirm, idle_s), schema, "append", "eventTime")


def stream_breaker(stream: DataFrame, delay: str = "10 minutes", idle_s: float = IDLE_S) -> DataFrame:
    """DEC-14 over a request stream (event_id, timestamp, backend, ok)."""
    return _machine_stream(stream, stateful.breaker_machine(), _breaker_out, stateful.BREAKER_OUT, None, delay, idle_s)


def stream_canary(stream: DataFrame, delay: str = "10 minutes", confirm: int = 2, idle_s: float = IDLE_S) -> DataFrame:
    """DEC-16 over a stream of health polls (event_id, timestamp, backend, ok)."""
    return _machine_stream(stream, stateful.canary_machine(), _canary_out, stateful.CANARY_OUT, confirm, delay, idle_s)


def _breaker_out(before, after, out) -> tuple:
    return before[0], out[0], after[0], out[1]


def _canary_out(before, after, event) -> tuple:
    share = 1.0 if after is None else float(C.CANARY_STEPS[after - 1]) if after else 0.0
    return "primary" if after is None else "backup", after or 0, share, event


class Decay(InOrder):
    """A remedy lowers its API's risk once a tick until it has run its ticks; while
    it runs, other fixes of the API are ignored."""

    held, order = FIX, ("ts_us", "event_id")

    def __init__(self, tick_s: float):
        self.tick_us = int(tick_s * 1e6)
        self.remedy = {name: rest for name, *rest in C.REMEDIES}

    def setup(self, handle) -> None:
        self.repair = handle.getValueState("repair", REPAIR)

    def due(self, key, ready: pd.DataFrame, watermark: int) -> Iterator[pd.DataFrame]:
        now = list(self.repair.get()) if self.repair.exists() else None
        rows = []

        def until(us: int) -> None:
            """The ticks of the running remedy that fall before ``us``."""
            nonlocal now
            while now is not None and now[1] + (now[4] + 1) * self.tick_us < us:
                now[4] += 1
                action, ticks, cut = self.remedy[now[2]]
                rows.append((key[0], now[0], now[1] + now[4] * self.tick_us, action, now[4], max(0.0, now[3] - now[4] * cut), now[4] >= ticks))
                if now[4] >= ticks:
                    now = None

        for event, us, category, risk in ready.itertuples(index=False):
            until(us + 1)  # a tick at the same time comes first
            if now is None:
                now = [int(event), int(us), category if category in self.remedy else "intermittent", float(risk), 0]
        until(watermark * 1000)
        if now is None:
            if self.repair.exists():
                self.repair.clear()
        else:
            self.repair.update(tuple(now))
            self.wake((now[1] + (now[4] + 1) * self.tick_us) // 1000)
        if rows:
            yield pd.DataFrame(rows, columns=DECAY_OUT.names)


def stream_decay(fixes: DataFrame, tick_s: float, delay: str = "10 minutes") -> DataFrame:
    """DEC-05 over a stream of fixes (event_id, timestamp, api_name, category,
    risk): the risk after every tick of ``tick_s`` seconds."""
    ship_package(fixes.sparkSession)
    rows = fixes.withWatermark("timestamp", delay).select("timestamp", "api_name", "event_id", F.unix_micros("timestamp").alias("ts_us"), "category", "risk")
    return rows.groupBy("api_name").transformWithStateInPandas(Decay(tick_s), DECAY_OUT, "append", "eventTime")

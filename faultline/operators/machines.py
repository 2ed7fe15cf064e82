"""Finite machines with timers, run exactly over long ordered sequences.

A machine has a fixed list of modes.  A rule maps (mode, symbol of a row) to the
next mode and the row's output; symbols are computed from rows by expressions.  A
mode may carry a timer: entered at some time, it is deaf until ``limit`` seconds
have passed, and then leaves at the first row for which its rule names a way out.

What a stretch of rows does to *any* entry state is itself a small value: the exit
state for each untimed mode, and for each timed mode a step function of the time
it was entered.  Stretches compose, so long sequences are cut into chunks, each
chunk is summarised in parallel, summaries are composed ``FAN`` at a time up a
tree, entry states are handed down the same tree, and every chunk is replayed
once from its true entry.  Nothing is guessed and nothing is repeated, no state
reaches the driver, and no task sees more than a chunk or FAN summaries.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable, Hashable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import series
from faultline.session import reliable_checkpoint

FAN = 512
State = tuple  # (mode number, time entered or None)


class Machine:
    """``rule(mode, symbol) -> (next mode, output) | None``; None, for a timed
    mode, means that it waits on.  ``limits``: seconds by timed mode.  ``idle(mode,
    symbol)`` is the output of a row on which a timed mode waits."""

    def __init__(self, modes: list, start: Hashable, rule: Callable, limits: dict | None = None, idle: Callable | None = None):
        self.modes, self.number = modes, {m: i for i, m in enumerate(modes)}
        self.start: State = (self.number[start], None)
        self.limit = {self.number[m]: s for m, s in (limits or {}).items()}
        self.rule, self.idle, self.known = rule, idle, {}

    def move(self, mode: int, symbol) -> tuple | None:
        key = (mode, symbol)
        if key not in self.known:
            to = self.rule(self.modes[mode], symbol)
            self.known[key] = None if to is None else (self.number[to[0]], to[1])
        return self.known[key]

    def step(self, state: State, ts: float, symbol) -> tuple[State, object]:
        mode, since = state
        way = None if mode in self.limit and ts - since < self.limit[mode] else self.move(mode, symbol)
        if way is None:
            return state, self.idle(self.modes[mode], symbol)
        return (way[0], ts if way[0] in self.limit else None), way[1]

    def summary(self, ts: list[float], symbols: list) -> dict:
        """What these rows do to any entry state."""
        n, timed = len(ts), list(self.limit)
        untimed = [m for m in range(len(self.modes)) if m not in self.limit]
        leaving = {m: [i for i in range(n) if self.move(m, symbols[i]) is not None] for m in timed}
        when = {m: [ts[i] for i in leaving[m]] for m in timed}
        left: dict[int, dict[int, State]] = {m: {} for m in timed}  # exit if mode m leaves at row i
        after = {m: (m, None) for m in untimed}  # exit if mode m is entered after row i

        def onward(mode: int, i: int) -> State:
            if mode not in self.limit:
                return after[mode]
            j = bisect_left(when[mode], ts[i] + self.limit[mode])
            while j < len(leaving[mode]) and leaving[mode][j] <= i:
                j += 1
            return left[mode][leaving[mode][j]] if j < len(leaving[mode]) else (mode, ts[i])

        for i in range(n - 1, -1, -1):
            for m in timed:
                way = self.move(m, symbols[i])
                if way is not None:
                    left[m][i] = onward(way[0], i)
            after = {m: onward(self.move(m, symbols[i])[0], i) for m in untimed}
        return {"go": {m: after[m] for m in untimed}, "wait": {m: _thin(when[m], [left[m][i] for i in leaving[m]]) for m in timed}}

    def apply(self, f: dict, state: State) -> State:
        mode, since = state
        if mode not in self.limit:
            return tuple(f["go"][mode])
        times, exits = f["wait"][mode]
        j = bisect_left(times, since + self.limit[mode])
        return tuple(exits[j]) if j < len(times) else state

    def compose(self, f: dict, g: dict) -> dict:
        """First f, then g."""
        wait = {}
        for m in self.limit:
            times, exits = f["wait"][m]
            later, more = g["wait"][m]
            wait[m] = _thin([*times, *later], [*(self.apply(g, tuple(e)) for e in exits), *more])
        return {"go": {m: self.apply(g, tuple(e)) for m, e in f["go"].items()}, "wait": wait}


def _thin(times: list, exits: list) -> tuple[list, list]:
    """Drop a step that its successor repeats."""
    exits = [tuple(e) for e in exits]
    keep = [i for i in range(len(times)) if i + 1 == len(times) or exits[i] != exits[i + 1]]
    return [times[i] for i in keep], [exits[i] for i in keep]


def _dump(f: dict) -> str:
    return json.dumps([[list(x) for x in f["go"].items()], [[m, *w] for m, w in f["wait"].items()]])


def _load(raw: str) -> dict:
    go, wait = json.loads(raw)
    return {"go": dict(go), "wait": {m: (t, e) for m, t, e in wait}}


def _entries(machine: Machine, funcs: DataFrame, key: str, kind: str, chunks: int) -> DataFrame:
    """(key, chunk, entry) of every summarised chunk, by way of the tree."""
    schema = f"`{key}` {kind}, chunk long, entry string"

    def walk(pdf: pd.DataFrame, state: State) -> pd.DataFrame:
        rows = []
        for k, c, f in pdf.sort_values("chunk")[[key, "chunk", "f"]].itertuples(index=False):
            rows.append((k, c, json.dumps(state)))
            state = machine.apply(_load(f), state)
        return pd.DataFrame(rows, columns=[key, "chunk", "entry"])

    if chunks <= FAN:
        return funcs.groupBy(key).applyInPandas(lambda pdf: walk(pdf, machine.start), schema)

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        f = None
        for raw in pdf["f"]:
            f = _load(raw) if f is None else machine.compose(f, _load(raw))
        return pd.DataFrame([(pdf[key].iloc[0], int(pdf["chunk"].iloc[0]) // FAN, _dump(f))], columns=[key, "chunk", "f"])

    def hand_down(pdf: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        return walk(pdf, tuple(json.loads(top["entry"].iloc[0])))

    parent = F.floor(F.col("chunk") / FAN).cast("long")
    up = reliable_checkpoint(funcs.groupBy(key, parent.alias("parent")).applyInPandas(join_up, f"`{key}` {kind}, chunk long, f string"))
    tops = _entries(machine, up, key, kind, -(-chunks // FAN))
    low = funcs.withColumn("parent", parent)
    high = tops.select(F.col(key).alias("top_key"), F.col("chunk").alias("parent_chunk"), "entry")
    return low.groupBy(key, "parent").cogroup(high.groupBy("top_key", "parent_chunk")).applyInPandas(hand_down, schema)


def run(machine: Machine, df: DataFrame, key: str, order: tuple, ts: str, symbol: str, outputs: Callable, schema: str,
        chunk_rows: int = 50_000) -> DataFrame:
    """``df`` with the columns of ``schema``, which ``outputs(mode before, mode
    after, output)`` gives as a tuple for each row of each key in ``order``."""
    idx = series.with_row_index(df, key=key, order=order, idx_col="_i")
    idx = idx.withColumn("_chunk", F.floor(F.col("_i") / chunk_rows).cast("long"))
    kind = dict(idx.dtypes)[key]
    names = [x.split()[0] for x in schema.split(", ")]

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        f = machine.summary(pdf["_ts"].tolist(), pdf["_symbol"].tolist())
        return pd.DataFrame([(pdf[key].iloc[0], int(pdf["_chunk"].iloc[0]), _dump(f))], columns=[key, "chunk", "f"])

    def replay(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        state, rows = tuple(json.loads(entry["entry"].iloc[0])), []
        for k, i, t, s in pdf[[key, "_i", "_ts", "_symbol"]].itertuples(index=False):
            before = state
            state, out = machine.step(state, t, s)
            rows.append((k, i, *outputs(machine.modes[before[0]], machine.modes[state[0]], out)))
        return pd.DataFrame(rows, columns=[key, "_i", *names])

    slim = idx.select(key, "_i", "_chunk", F.col(ts).cast("double").alias("_ts"), F.col(symbol).cast("string").alias("_symbol"))
    funcs = reliable_checkpoint(slim.groupBy(key, "_chunk").applyInPandas(summarise, f"`{key}` {kind}, chunk long, f string"))
    chunks = (funcs.agg(F.max("chunk")).first()[0] or 0) + 1
    entry = reliable_checkpoint(_entries(machine, funcs, key, kind, chunks)).select(F.col(key).alias("_key"), F.col("chunk").alias("_entry_chunk"), "entry")
    out = slim.groupBy(key, "_chunk").cogroup(entry.groupBy("_key", "_entry_chunk")).applyInPandas(replay, f"`{key}` {kind}, _i long, {schema}")
    return idx.drop("_chunk").join(out, [key, "_i"]).drop("_i")

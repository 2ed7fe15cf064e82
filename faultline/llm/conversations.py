"""Conversation structure repair: cheapest edits by Hirschberg's divide and conquer.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Read from the left,
what was put out so far is in one of four states: nothing, a system row, last a user
row, last an assistant row.  A row moves a state to another at some cost, after up to
two inserted rows; so a stretch of rows is a 4 x 4 table of costs, and stretches
compose.  Beside its cost, each entry of the table has the rank of its cheapest edits'
initials among those that start in the same state.  Initials of different ends are
never a prefix of one another (each ends with the same row's edit), so ranks compose
too, and the ASCII-least of all cheapest edits is found without writing any down.

To find the way through n stretches from a given start to a given end, a forward
vector (cost and rank of the four states in the middle) meets a backward vector of
costs; of the states with the least sum the one of least rank is crossed, and both
halves are solved the same way, in memory that does not grow with n beyond the
answer.  Rows that must go (blank, repeated) cost 4 each and take no part; inserts
stand after them, which is ASCII-less than before them.

Spark sorts the rows by conversation and turn over range partitions, so a
conversation that holds a third of all rows is spread out.  Conversations inside one
partition are solved where they lie.  Those that cross a border, or are longer than
``chunk_rows``, become tables per chunk, then per partition; these are solved from the
top down, and each chunk between the states it was given.  Texts take no part in
this; they meet their rows' edits in one last pass that is sorted by conversation and
streams (a digest of a whole conversation is sequential; no group is held in memory,
but the audit string, a result, is as long as its conversation).

Defined cases: null roles and texts are one space.  A null conversation id is a
conversation of its own.  Rows come by turn, nulls first, then role, then the digest
of the text; repeated rows are duplicates.  A role with another initial cannot be
kept.  An empty table gives an empty result, a conversation without rows empty edits.
Further columns take no part, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import written
from faultline.session import ship_package

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
STATES = range(4)  # nothing yet, after a system row, after a user row, after an assistant row
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
NAME = {"u": "user", "a": "assistant"}
INITIALS = "sua"
BLANK, DUPLICATE = -1, -2  # codes of rows that must go; others are 2 * initial + truncated
Table = list  # [state][state] -> (cost, rank) or None

MARKED = "ck string, conv_id string, tn int, tv long, role string, digest binary, m long, code int"
SOLVED = MARKED + ", part int, chunk int, pos int, q int, p int"


def inserted(state: int) -> list[tuple[int, str]]:
    """States that 0, 1 and 2 inserted rows lead to, with the initials of those rows."""
    out = [(state, "")]
    for _ in range(2):
        at, done = out[-1]
        letter = "a" if at == 2 else "u"
        out.append((NEXT[at, letter], done + letter))
    return out


def _move(code: int) -> list[list]:
    """[state][state] -> (cost, edits, initials put out) of one row."""
    initial, late = (INITIALS + "-")[code // 2], TRUNCATED * (code % 2)
    best = [[None] * 4 for _ in STATES]
    for q in STATES:
        for at, extra in inserted(q):
            ways = [(at, DELETE, "D", "")]
            if (at, initial) in NEXT:
                ways.append((NEXT[at, initial], KEEP + late, "K", initial))
            ways += [(NEXT[at, x], REROLE + late, "R", x) for x in "ua" if (at, x) in NEXT]
            for p, cost, edit, out in ways:
                new = (cost + INSERT * len(extra), "I" * len(extra) + edit, extra + out)
                if best[q][p] is None or new < best[q][p]:
                    best[q][p] = new
    return best


MOVES = [_move(code) for code in range(8)]
#: The rows to insert at the end: (cost, initials) by state.
TAIL = [(0, ""), (2 * INSERT, "ua"), (INSERT, "a"), (0, "")]


def _ranked(row: list) -> list:
    """(cost, sortable) entries as (cost, rank)."""
    order = {x: i for i, x in enumerate(sorted(e[1] for e in row if e is not None))}
    return [None if e is None else (e[0], order[e[1]]) for e in row]


TABLES: list[Table] = [[_ranked(row) for row in move] for move in MOVES]


def forward(vector: list, table: Table) -> list:
    """Cost and rank of each state after one more stretch."""
    new = [None] * 4
    for q in STATES:
        if vector[q] is not None:
            cost, rank = vector[q]
            for p in STATES:
                if table[q][p] is not None:
                    e = (cost + table[q][p][0], (rank, table[q][p][1]))
                    if new[p] is None or e < new[p]:
                        new[p] = e
    return _ranked(new)


def backward(table: Table, costs: list) -> list:
    """Cost from each state through one stretch to the end."""
    return [min((e[0] + c for e, c in zip(row, costs) if e is not None and c is not None), default=None) for row in table]


def start_at(state: int) -> list:
    return [(0, 0) if q == state else None for q in STATES]


def compose(tables: list[Table]) -> Table:
    out = []
    for q in STATES:
        v = start_at(q)
        for t in tables:
            v = forward(v, t)
        out.append(v)
    return out


def cross(tables: list[Table], first: int, last: int, lo: int, hi: int) -> Iterator[int]:
    """The state after each of the stretches lo..hi on the least way from ``first`` to ``last``."""
    if hi - lo == 1:
        yield last
        return
    mid = (lo + hi) // 2
    v = start_at(first)
    for i in range(lo, mid):
        v = forward(v, tables[i])
    costs = [0 if q == last else None for q in STATES]
    for i in range(hi - 1, mid - 1, -1):
        costs = backward(tables[i], costs)
    at = min((v[q][0] + costs[q], v[q][1], q) for q in STATES if v[q] is not None and costs[q] is not None)[2]
    yield from cross(tables, first, at, lo, mid)
    yield from cross(tables, at, last, mid, hi)


def end_of(vector: list) -> int:
    """The state to end in: least cost with the rows inserted at the end, then least rank."""
    return min((e[0] + TAIL[q][0], e[1], q) for q, e in enumerate(vector) if e is not None)[2]


def solve(codes: list[int]) -> list[int]:
    """States after each row that may stay, of a whole conversation."""
    if not codes:
        return []
    tables = [TABLES[c] for c in codes]
    v = start_at(0)
    for t in tables:
        v = forward(v, t)
    return list(cross(tables, 0, end_of(v), 0, len(tables)))


# --- Spark -----------------------------------------------------------------------------------------

def _order(turn: Column) -> list[Column]:
    return [F.when(turn.isNull(), 0).otherwise(1).alias("tn"), F.coalesce(turn.cast("long"), F.lit(0)).alias("tv")]


def normal(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The columns the repair works on.  ``copies``: how often a row stands there
    (0: its conversation is known, the row is not there)."""
    n = F.col("copies") if "copies" in rows.columns else F.lit(1)
    value = F.coalesce(F.col(text), F.lit(" "))
    return rows.select(F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("ck"), F.col(conv).cast("string").alias("conv_id"),
                       *_order(F.col(turn)), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.unhex(F.sha2(value, 256)).alias("digest"),
                       n.cast("long").alias("m"), value.alias("text"))


def marked(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number and the code of their first one's fault."""
    rest = F.rtrim(F.col("text"), F.lit(SPACE))
    late = ~F.substring(rest, -1, 1).isin(".", "!", "?")
    initial = F.when(F.substring("role", 1, 1) == "s", 0).when(F.substring("role", 1, 1) == "u", 1).when(F.substring("role", 1, 1) == "a", 2).otherwise(3)
    code = F.when(rest == "", BLANK).otherwise(2 * initial + late.cast("int"))
    keys = ["ck", "conv_id", "tn", "tv", "role", "digest"]
    d = rows.where("m > 0").select(*keys, "m", code.alias("code")).groupBy(*keys).agg(F.sum("m").alias("m"), F.min("code").alias("code"))
    first = d.groupBy("ck", "role", "digest").agg(F.min(F.struct("tn", "tv")).alias("first"))
    seen = (F.col("code") >= 0) & (F.col("first") != F.struct("tn", "tv"))
    return (d.join(first, ["ck", "role", "digest"]).withColumn("code", F.when(seen, DUPLICATE).otherwise(F.col("code")))
            .select(*[x.split()[0] for x in MARKED.split(", ")]))


def _solve_inside(chunk_rows: int):
    """Rows sorted by conversation: those that lie inside the partition and are
    short enough are solved; of others the rows that may stay are dealt to chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        schema = pa.schema([("ck", pa.string()), ("conv_id", pa.string()), ("tn", pa.int32()), ("tv", pa.int64()), ("role", pa.string()), ("digest", pa.binary()),
                            ("m", pa.int64()), ("code", pa.int32()), ("part", pa.int32()), ("chunk", pa.int32()), ("pos", pa.int32()), ("q", pa.int32()), ("p", pa.int32())])
        rows, state = [], {"ck": None, "first": True, "chunk": 0}

        def flush(whole: bool) -> pa.RecordBatch | None:
            live = [r for r in rows if r["code"] >= 0]
            if whole:
                q = 0
                for r, p in zip(live, solve([r["code"] for r in live])):
                    r["q"], r["p"], q = q, p, p
            for i, r in enumerate(live):
                r["pos"] = i
            out = pa.RecordBatch.from_pylist([{"part": part, "chunk": state["chunk"], "pos": -1, "q": None, "p": None} | r for r in rows], schema=schema) if rows else None
            rows.clear()
            return out

        for batch in batches:
            for r in batch.to_pylist():
                if r["ck"] != state["ck"]:
                    out = flush(not state["first"] and not state["chunk"])  # of the first a part may lie before
                    if out is not None:
                        yield out
                    state |= {"first": state["ck"] is None, "ck": r["ck"], "chunk": 0}
                elif len(rows) >= chunk_rows:
                    yield flush(False)
                    state["chunk"] += 1
                rows.append(r)
        out = flush(False)  # of the last a part may lie after
        if out is not None:
            yield out
    return run


def _frame(rows: list, columns: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])


CHUNK = "ck string, part int, chunk int, table string"
PART = "ck string, part int, table string"
WAY = "ck string, part int, chunk int, q int, p int"


def _chunk_table(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    codes = pdf.sort_values("pos")["code"].tolist()
    return _frame([(*key, json.dumps(compose([TABLES[c] for c in codes])))], CHUNK)


def _part_table(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return _frame([(*key, json.dumps(compose([json.loads(t) for t in pdf.sort_values("chunk")["table"]])))], PART)


def _part_ways(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("part")
    tables = [json.loads(t) for t in pdf["table"]]
    v = start_at(0)
    for t in tables:
        v = forward(v, t)
    ends = list(cross(tables, 0, end_of(v), 0, len(tables)))
    return _frame([(key[0], int(x), 0, q, p) for x, q, p in zip(pdf["part"], [0, *ends], ends)], WAY)


def _chunk_ways(key: tuple, chunks: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
    chunks = chunks.sort_values("chunk")
    first, last = int(way["q"].iloc[0]), int(way["p"].iloc[0])
    ends = list(cross([json.loads(t) for t in chunks["table"]], first, last, 0, len(chunks)))
    return _frame([(*key, int(x), q, p) for x, q, p in zip(chunks["chunk"], [first, *ends], ends)], WAY)


def _row_ways(key: tuple, rows: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("pos")
    first, last = int(way["q"].iloc[0]), int(way["p"].iloc[0])
    ends = list(cross([TABLES[c] for c in rows["code"].tolist()], first, last, 0, len(rows)))
    return rows.assign(q=[first, *ends][:-1], p=ends)[[c.split()[0] for c in SOLVED.split(", ")]]


def edits(rows: DataFrame, chunk_rows: int = 4096, part_rows: int = 1 << 20) -> DataFrame:
    """Every distinct row of ``normal`` rows with its code and, if it may stay, the states before and after it."""
    spark = rows.sparkSession
    d = written(marked(rows), "conversations-marked")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-d.count() // part_rows))
    order = ["ck", "tn", "tv", "role", "digest"]
    solved = written(d.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_solve_inside(chunk_rows), SOLVED), "conversations-solved")
    # conversations that cross a border or are long: tables per chunk, per partition, then back down
    rest = solved.where("code >= 0 and q is null")
    chunks = written(rest.groupBy("ck", "part", "chunk").applyInPandas(_chunk_table, CHUNK), "conversations-chunks")
    parts = chunks.groupBy("ck", "part").applyInPandas(_part_table, PART)
    ways = parts.groupBy("ck").applyInPandas(_part_ways, WAY)
    ways = written(chunks.groupBy("ck", "part").cogroup(ways.groupBy("ck", "part")).applyInPandas(_chunk_ways, WAY), "conversations-ways")
    late = rest.groupBy("ck", "part", "chunk").cogroup(ways.groupBy("ck", "part", "chunk")).applyInPandas(_row_ways, SOLVED)
    return solved.where("code < 0 or q is not null").unionByName(late)


SUMMARY = [("conv_id", pa.string()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
           ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
TURNS = [("conv_id", pa.string()), ("seq", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]


class _Conversation:
    """What a pass over one conversation's rows in order gathers."""

    def __init__(self, conv_id):
        self.conv_id, self.gaps, self.state, self.cost = conv_id, None, 0, 0
        self.count = {BLANK: 0, DUPLICATE: 0, 1: 0}
        self.illegal, self.before, self.turns = 0, None, None
        self.audit, self.sha, self.seq, self.keep = [], sha256(), 0, None

    def row(self, r: dict) -> Iterator[tuple[str, str, str | None]]:
        """(edit, role, text) of rows put out; a text of None follows."""
        n, code = r["m"], r["code"]
        if r["tn"]:
            low, high, turns, last = self.turns or (r["tv"], r["tv"], 0, None)
            self.turns = (low, r["tv"], turns + (last != r["tv"]), r["tv"])
        initial = r["role"][:1]
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.illegal += n - 1
        again = n - 1
        if code < 0:
            self.count[code] += n
            self.audit.append("D" * n)
            self.cost += DELETE * n
            return
        self.count[DUPLICATE] += again
        self.count[1] += code % 2
        cost, edit, out = MOVES[code][r["q"]][r["p"]]
        self.audit.append(edit + "D" * again)
        self.cost, self.state = self.cost + cost + DELETE * again, r["p"]
        for x in out[: len(edit) - 1]:
            yield "I", NAME[x], ""
        if edit[-1] != "D":
            yield edit[-1], r["role"] if edit[-1] == "K" else NAME[out[-1]], None

    def put(self, edit: str, role: str, text: str) -> tuple:
        self.sha.update(f"{chr(10) if self.seq else ''}{role}:{text}".encode())
        self.seq += 1
        return self.conv_id, self.seq, edit, role, text

    def end(self) -> Iterator[tuple]:
        cost, out = TAIL[self.state]
        self.cost += cost
        self.audit.append("I" * len(out))
        return (self.put("I", NAME[x], "") for x in out)

    def summary(self) -> tuple:
        gaps = 0 if self.turns is None else self.turns[1] - self.turns[0] + 1 - self.turns[2]
        return (self.conv_id, gaps, self.count[BLANK], self.count[DUPLICATE], self.count[1], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def _stream(turns: bool):
    """Rows sorted by conversation and order, an edit's row before its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(TURNS if turns else SUMMARY)
        now, key, wanted, rows = None, None, None, []

        def done():
            rest = list(now.end())
            rows.extend(rest if turns else [now.summary()])

        for batch in batches:
            for r in batch.to_pylist():
                if r["ck"] != key:
                    if now is not None:
                        done()
                    now, key, wanted = _Conversation(r["conv_id"]), r["ck"], None
                if r["kind"] == 0:
                    wanted = None
                    for edit, role, text in now.row(r):
                        if text is None:
                            wanted = edit, role
                        else:
                            out = now.put(edit, role, text)
                            if turns:
                                rows.append(out)
                elif r["kind"] == 1 and wanted is not None:
                    out = now.put(*wanted, r["text"])
                    wanted = None
                    if turns:
                        rows.append(out)
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in rows], schema=schema)
                rows = []
        if now is not None:
            done()
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in rows], schema=schema)
    return run


def _pass(rows: DataFrame, turns: bool, **options) -> DataFrame:
    ship_package(rows.sparkSession)
    n = normal(rows)
    none = lambda *names: [F.lit(None).cast("string" if c == "text" else "int").alias(c) for c in names]
    cols = ["ck", "conv_id", "tn", "tv", "role", "digest"]
    plan = edits(n, **options).select(*cols, "m", "code", "q", "p", *none("text"), F.lit(0).alias("kind"))
    text = n.where("m > 0").select(*cols, F.lit(0).cast("long").alias("m"), *none("code", "q", "p"), "text", F.lit(1).alias("kind"))
    known = n.where("m = 0").select("ck", "conv_id").distinct().select(
        "ck", "conv_id", F.lit(-1).alias("tn"), F.lit(0).cast("long").alias("tv"), F.lit("").alias("role"), F.lit(b"").alias("digest"),
        F.lit(0).cast("long").alias("m"), *none("code", "q", "p", "text"), F.lit(2).alias("kind"))
    every = plan.unionByName(text).unionByName(known)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = TURNS if turns else SUMMARY
    ddl = ", ".join(f"{c} {'long' if t == pa.int64() else 'string'}" for c, t in fields)
    out = every.repartition(parts, "ck").sortWithinPartitions(*cols[:1], *cols[2:], "kind").mapInArrow(_stream(turns), ddl)
    return out.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def repair(rows: DataFrame, **options) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text and, if there,
    ``copies``): its faults, the cost and initials of its cheapest edits, and the digest of what they give."""
    return _pass(rows, False, **options)


def repaired_turns(rows: DataFrame, **options) -> DataFrame:
    """The repaired rows themselves, numbered by ``seq`` from 1."""
    return _pass(rows, True, **options)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the damage that the digest of conversation and turn asks for."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.coalesce(F.col("text"), F.lit(" "))
    return rows.select("conv_id", "turn", F.when(h == 4, "user").otherwise(F.coalesce(F.col("role"), F.lit(" "))).alias("role"),
                       F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                       F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"))

import itertools
import random
import re
import zlib
from hashlib import sha256

import duckdb

from faultline.llm import conversations as C
from faultline.llm.queries import ORACLES, QUERIES

SPACE = " \t\n\x0b\x0c\r"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """rows: (role, text, must go, late) -> (cost, audit, lines), by trying every short edit sequence."""
    best = None
    todo = [(0, "", (), 0, 0)]  # cost, audit, lines, row, inserts in a row
    while todo:
        cost, audit, lines, i, ins = todo.pop()
        if best is not None and cost > best[0]:
            continue
        initials = "".join(x[:1] if not x.startswith(":") else " " for x in lines)
        if i == len(rows) and GOOD.match(initials):
            best = min(best or (cost, audit, lines), (cost, audit, lines))
        if not re.match(r"s?(ua)*u?\Z", initials):
            continue
        if ins < 2:
            todo += [(cost + 3, audit + "I", (*lines, f"{r}:"), i, ins + 1) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, go, late = rows[i]
            todo.append((cost + 4, audit + "D", lines, i + 1, 0))
            if not go:
                todo.append((cost + 3 * late, audit + "K", (*lines, f"{role}:{text}"), i + 1, 0))
                todo += [(cost + 3 + 3 * late, audit + "R", (*lines, f"{r}:{text}"), i + 1, 0) for r in ("user", "assistant")]
    return best


def by_strings(rows):
    """The same by a table of whole strings per state (longer rows)."""
    far = (10**9, "", ())
    s = [(0, "", ()), far, far, far]

    def add(e, cost, letter, line=None):
        return (e[0] + cost, e[1] + letter, e[2] if line is None else (*e[2], line))

    def closed(s):
        u = min(s[2], *(add(s[i], 3, "I", "user:") for i in (0, 1, 3)))
        return [s[0], s[1], u, min(s[3], add(u, 3, "I", "assistant:"))]

    for role, text, go, late in rows:
        e = closed(s)
        may = 10**9 if go else 3 * late

        def stay(x, initial, name):
            kept = may if role[:1] == initial else 10**9
            return [add(x, kept, "K", f"{role}:{text}")] + ([add(x, 3 + may, "R", f"{name}:{text}")] if name else [])
        s = [add(e[0], 4, "D"), min(add(e[1], 4, "D"), *stay(e[0], "s", None)),
             min([add(e[2], 4, "D"), *(y for i in (0, 1, 3) for y in stay(e[i], "u", "user"))]), min(add(e[3], 4, "D"), *stay(e[2], "a", "assistant"))]
    e = closed(s)
    return min(e[0], e[3])


def faults(rows):
    """rows in order: (turn, role, text) -> (role, text, must go, late), counts."""
    seen, out, count = set(), [], {"blank": 0, "dup": 0, "late": 0}
    for _, role, text in rows:
        rest = text.rstrip(SPACE)
        fault = "blank" if not rest else "dup" if (role, text) in seen else "late" if rest[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        out.append((role, text, fault in ("blank", "dup"), fault == "late"))
    return out, count


def brute(table, damage=True, solve=by_strings):
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        rows += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha256(r[2].encode()).digest()))
        marks, n = faults(rows)
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, lines = solve(marks)
        out.append((conv, gaps, n["blank"], n["dup"], n["late"], illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def table(n=150, seed=1):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "u", None, "", "user", "assistant"]
    texts = ["Yes.", "No", "", " \t", None, "What?\n", "fine!", "late one", "Ünï.", "a" * 30_000 + ".", "b", "c", "d."]
    rows = [(rng.randrange(25), rng.choice([None, *range(-2, 9)]), rng.choice(roles), rng.choice(texts) if rng.random() < .4 else f"t{rng.random()}{rng.choice(['.', '', '?'])}")
            for _ in range(n)]
    rows += [(None, t, r, "x.") for t, r in ((1, "user"), (2, "assistant"), (None, "user"))] + [(77, None, "user", "a."), (77, None, "user", "a.")]
    rows += [(88, 0, "user", "gone.")] if zlib.crc32(b"88:0") % 20 == 0 else []
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (gone, 0, "user", "All gone.")]


def tuples(df):
    return sorted((tuple(r[c] for c, _ in C.SUMMARY) for r in df.collect()), key=str)


def test_string_table_against_every_edit_sequence():
    rng = random.Random(2)
    for _ in range(150):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), f"{i}", rng.random() < .2, rng.random() < .3) for i in range(rng.randrange(5))]
        assert by_strings(rows) == cheapest(rows)


def test_divide_and_conquer_against_string_table():
    rng = random.Random(4)
    for n in [*range(12), 60, 301]:
        rows = [(rng.choice(["user", "assistant", "system", "x"]), "", False, rng.random() < .3) for _ in range(n)]
        codes = [2 * "suax".index(r[0][0]) + r[3] for r in rows]
        states = C.solve(codes)
        audit, cost, q = "", 0, 0
        for c, p in zip(codes, states):
            e = C.MOVES[c][q][p]
            audit, cost, q = audit + e[1], cost + e[0], p
        want = by_strings(rows)
        assert (cost + C.TAIL[q][0], audit + "I" * len(C.TAIL[q][1])) == want[:2]


def test_repair_matches_brute_force_in_one_and_in_many_chunks(spark):
    rows = table(400)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, m int, ck string")
    assert tuples(C.repair(C.damaged(df))) == brute(rows)
    assert tuples(C.repair(C.damaged(df), chunk_rows=2, part_rows=20)) == brute(rows)
    assert C.repair(C.damaged(df.limit(0))).collect() == []


def test_one_conversation_over_many_partitions(spark):
    rng = random.Random(8)
    rows = [(5, i, rng.choice(["user", "assistant", "system", "tool"]), f"{i}" + rng.choice([".", ""])) for i in range(1500)]
    rows += [(5, 2000 + i, "user", "ok.") for i in range(500)] + [(6, 0, "user", "hi."), (6, 1, "assistant", "ho.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert tuples(C.repair(df, chunk_rows=50, part_rows=100)) == brute(rows, damage=False)
    turns = sorted(tuple(r) for r in C.repaired_turns(df, chunk_rows=50, part_rows=100).collect())
    want = by_strings(faults([r[1:] for r in rows if r[0] == 5])[0])
    assert [f"{r}:{t}" for c, _, _, r, t in turns if c == 5] == list(want[2])
    assert "".join(e for c, _, e, _, _ in turns if c == 5) == want[1].replace("D", "")
    assert [t[3:] for t in turns if t[0] == 6] == [("user", "hi."), ("assistant", "ho.")]


def test_query_and_sql_agree_with_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows)
    assert tuples(QUERIES["op13_conversation_repair"](spark, sf)) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    odd = table(120, 9)
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", odd)
    assert sorted(con.execute(ORACLES["op13_conversation_repair"]).fetchall(), key=str) == brute(odd)

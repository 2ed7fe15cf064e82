import random

import numpy as np
import pytest

from faultline.llm import lines


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def vary(rng, s, n):
    s = list(s)
    for _ in range(n):
        at, kind = rng.randrange(len(s) + 1), rng.randrange(3)
        if kind == 0:
            s.insert(at, rng.choice("abé"))
        elif s and kind == 1:
            s.pop(min(at, len(s) - 1))
        elif s:
            s[min(at, len(s) - 1)] = rng.choice("abé")
    return "".join(s)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_distance(tau):
    rng = random.Random(tau)
    texts = []
    for _ in range(300):
        s = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 30)))
        texts += [s, vary(rng, s, rng.randrange(0, 6))]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    n = np.array([len(x) for x in texts])
    a, b = np.arange(0, 600, 2), np.arange(1, 600, 2)
    got = lines.within(a, b, codes, np.cumsum(n) - n, n, tau)
    assert got.tolist() == [edit(texts[i], texts[j]) <= tau for i, j in zip(a, b)]


def test_keys_meet_for_every_close_pair():
    rng = random.Random(5)
    for _ in range(300):
        s = "".join(rng.choice("ab") for _ in range(rng.randrange(20, 60)))
        t = vary(rng, s, 2)
        if len(t) >= 20 and s != t:
            row, key = lines.keys([s, t], 2, 20)
            short, long_ = (0, 1) if len(s) <= len(t) else (1, 0)
            assert set((key[(row == short) & (key & np.uint64(1) == 0)])) & set(key[(row == long_) & (key & np.uint64(1) == 1)] ^ np.uint64(1))


def brute(rows, tau=2, min_chars=20, short=False):
    def takes_part(x):
        return len(x) >= min_chars or short and x.strip() != ""
    occ = sorted({(lines.LAST if d is None else d, t, n, x) for d, t in rows if t is not None
                  for n, x in enumerate(t.split("\n")) if takes_part(x)}, key=lambda o: (o[0], o[1], o[2]))
    distinct = sorted({o[3] for o in occ})
    comp = {x: x for x in distinct}
    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if min(len(x), len(y)) >= min_chars and abs(len(x) - len(y)) <= tau and edit(x, y) <= tau:
                comp[find(x)] = find(y)
    first = {}
    for d, *_, x in occ:
        first[find(x)] = min(first.get(find(x), d), d)
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        seen, kept = set(), []
        for x in t.split("\n"):
            c = find(x) if takes_part(x) else None
            if c is None or (first[c] == (lines.LAST if d is None else d) and c not in seen):
                kept.append(x)
            if c is not None:
                seen.add(c)
        out.append((d, "\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,limit,short", [(1024, 32 << 20, False), (4, 0, False), (1024, 32 << 20, True), (4, 0, True)])
def test_dedup_matches_brute_force(spark, monkeypatch, block, limit, short):
    monkeypatch.setattr(lines, "BLOCK", block)
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(15, 60))) for _ in range(40)] + ["short", ""]
    rows = [(1, None), (2, ""), (4, "short\nword\nword\n\n"), (5, "x" * 19 + "\n" + "x" * 20 + "\n" + "é " * 30000), (6, "é " * 30000), (None, pool[0]), (3, pool[1] + "\n" + pool[1]), (3, pool[1] + "\n" + pool[1]), (3, pool[2])]
    for i in range(60):
        rows.append((10 + i, "\n".join(vary(rng, rng.choice(pool[: 5 if i % 2 else 42]), rng.choice([0, 0, 1, 2])) for _ in range(rng.randrange(1, 9)))))
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, id int")
    got = lines.dedup_lines(df, limit=limit, short=short)
    assert got.columns == ["doc_id", "text", "id", "_lines"]
    res = sorted([(r.doc_id, r.text, r._lines.n_lines, r._lines.n_removed) for r in got.collect()], key=str)
    assert res == brute(rows, short=short)
    assert lines.dedup_lines(df.limit(0), short=short).collect() == []


def test_short_lines_repeat_by_exact_text(spark):
    rows = [(1, "Les.\n\nLes.\n \nonce"), (2, "Les.\nles.\n\n \n" + "a long line of more than twenty characters"), (None, "Les."), (3, "Les"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r._lines.n_removed) for r in lines.dedup_lines(df, short=True).collect()}
    assert got == {1: ("Les.\n\n \nonce", 1), 2: ("les.\n\n \n" + "a long line of more than twenty characters", 1), None: ("", 1), 3: ("Les", 0), 4: (None, 0)}

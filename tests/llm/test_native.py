"""Decontamination, licences and mixing on small tables with awkward rows."""
import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from faultline.llm import decontam, licences, mixing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=13):
    win = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        if i is not None and w:
            for a in range(len(w) - n + 1):
                win.setdefault(tuple(w[a:a + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, own = words(t), set(), set()
        for n in {len(x) for x in win}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in win:
                    hit |= set(range(a, a + n))
                    own |= win[tuple(w[a:a + n])]
        out.append((d, len(w), len(hit), sorted(own), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_contamination_matches_brute_force(spark, limit):
    p = [f"w{i % 7} x{i}" for i in range(40)]
    item = " ".join(p[:15])
    items = [(1, item), (2, "Short ITEM"), (2, "éa"), (10, item + " tail end"), (None, "null id here"), (3, None), (4, " .,! "), (5, "a a a a a a a a a a a a a a a a")]
    docs = [(1, None), (2, ""), (3, "..."), (4, item.upper()), (4, item.upper()), (4, "other row"), (None, "some SHORT item, and null id here"),
            (6, "a " * 500), (7, " ".join(p) + " " + "filler " * 2000), (8, "éa"), (9, "short-item short.item"), (10, " ".join(p[2:9]))]
    d = spark.createDataFrame([(i, t, 3, "c") for i, t in docs], "doc_id long, text string, n long, w string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(d, b, limit=limit).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in got], key=str) == brute(docs, items)
    clean = decontam.decontaminate(d, b, limit=limit)
    assert clean.columns == d.columns
    assert sorted([(r.doc_id, r.text) for r in clean.collect()], key=str) == sorted(
        [(i, t) for (i, t) in docs if not brute([(i, t)], items)[0][4]], key=str)
    assert decontam.contamination(d.limit(0), b).collect() == []
    assert not any(r.contaminated for r in decontam.contamination(d, b.limit(0)).collect())


def test_licences(spark):
    mit = next(t for n, t in licences.NOTICES if n == "MIT" and "\n" in t)
    rows = [(1, None), (2, ""), (3, "Some text.\nReleased under the MIT license\nMore."), (4, "© 2020 Me\nCopyright (c) 2019 Them. All rights.\n\n  THE MIT LICENCE\n" + mit.replace(". ", ".  ")),
            (None, "licensed under cc by-nc 4.0"), (3, "Released under the MIT License, or not."), (5, "x\n" * 3000 + "Licensed under the Apache Licence, version 2.0"), (5, "x\n" * 3000 + "Licensed under the Apache Licence, version 2.0")]
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, lines string")
    got = sorted([tuple(r) for r in licences.licence_scan(df).collect()], key=str)
    assert got == sorted([(1, "", 0, False), (2, "", 0, False), (3, "MIT", 1, False), (4, "MIT", 1, True), (None, "CC-BY-NC-4.0", 1, True), (3, "", 0, False),
                          (5, "Apache-2.0", 1, False), (5, "Apache-2.0", 1, False)], key=str)
    assert licences.licence_scan(df.limit(0)).collect() == []


def test_licences_however_they_are_wrapped(spark):
    mit = next(t for n, t in licences.NOTICES if n == "MIT" and "\n" in t).replace("\n", " ")
    usual = mit.replace("SHALL THE ", "SHALL THE\n").replace("COPYRIGHT HOLDERS BE", "COPYRIGHT HOLDERS BE")
    at_clause = mit.replace("AUTHORS OR COPYRIGHT", "AUTHORS OR\nCOPYRIGHT")
    bsd = next(t for n, t in licences.NOTICES if n == "BSD-3-Clause" and "\n" in t)
    rows = [(1, mit), (2, "MIT License\n\nCopyright 2021 Me\n" + usual), (3, "Copyright (c) 2020, Me\nAll rights reserved.\n\n" + at_clause),
            (4, "Copyright © Me\nAll rights reserved.\n" + bsd.replace(" ", "\n")), (5, mit.replace("COPYRIGHT HOLDERS BE LIABLE", "")),
            (6, "(c) 2020 Me\n" + bsd.replace("3. Neither", "(c) Neither")), (7, mit + " word" * 200000)]
    got = {r.doc_id: (r.licences, r.whole_text) for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", True), 2: ("MIT", True), 3: ("MIT", True), 4: ("BSD-3-Clause", True), 5: ("", False), 6: ("", False), 7: ("", False)}


WHOLE = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3",
         "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no published licence texts on this machine")
def test_whole_texts_of_long_licences(spark):
    rows = []
    for i, f in enumerate(WHOLE.values()):
        with open(f"/usr/share/common-licenses/{f}") as h:
            rows.append((i, h.read().upper()))
    got = licences.licence_scan(spark.createDataFrame(rows, "doc_id int, text string")).orderBy("doc_id").collect()
    assert [n in r.licences.split(",") and r.whole_text for n, r in zip(WHOLE, got)] == [True] * len(WHOLE)


def test_mixing_reaches_its_marginals(spark):
    rows = [(i, "word " * (20 if i % 3 else 150), ["a", "b", None][i % 7 % 3], ["en", "de"][i % 5 // 3]) for i in range(3000)]
    rows += [(None, None, None, None), (-1, "", "a", "en"), (5, "word " * 20, "b", "en")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, lang string, topic string")
    got = mixing.mix(df, budget=0.3)
    assert got.columns == ["doc_id", "text", "source", "lang", "topic", "_mix"] and got.count() == len(rows)
    total = got.agg(F.sum("_mix.n_tokens")).first()[0]
    for dim, col in (("source", F.coalesce("source", F.lit(""))), ("lang", F.coalesce("lang", F.lit("")))):
        share = {r.k: r for r in got.groupBy(col.alias("k")).agg(F.sum("_mix.n_tokens").alias("t"), F.sum(F.col("_mix.n_tokens") * F.col("_mix.probability")).alias("e")).collect()}
        goal = {k: r.t ** mixing.TEMPER[dim] for k, r in share.items()}
        for k, r in share.items():
            if k:
                assert abs(r.e / (0.3 * total) - goal[k] / sum(goal.values())) < 0.03
    kept = got.where("_mix.sampled").agg(F.sum("_mix.n_tokens")).first()[0]
    assert abs(kept / total - 0.3) < 0.04
    again = mixing.mix(df.repartition(5), budget=0.3).where("_mix.sampled").select("doc_id").collect()
    assert sorted(map(str, again)) == sorted(map(str, got.where("_mix.sampled").select("doc_id").collect()))
    assert mixing.mix(df.limit(0)).collect() == []

"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm.common import table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@register("op1_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
""")
def op1_topk(spark, sf_dir):
    from faultline.llm.topk import topk_search
    return topk_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@register("op5_simhash")
def op5_simhash(spark, sf_dir):
    from faultline.llm.simhash import simhash_components
    return simhash_components(table(spark, sf_dir, "documents"), shingle=3, bits=3)


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all(coalesce({LOWERED}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _licence_sql() -> str:
    from faultline.llm import licences as m
    q = lambda s: s.replace("'", "''")
    t = f"regexp_replace({LOWERED}, '{m.COPYRIGHT}', '', 'g')"
    for a, b in m.SPELLINGS:
        t = f"replace({t}, '{a}', '{b}')"
    t = f"regexp_replace(regexp_replace({t}, '{m.OUTSIDE}', ' ', 'g'), '{m.EDGES}', '', 'g')"
    lines = f"list_filter(string_split(coalesce({t}, ''), chr(10)), lambda x: x <> '')"
    rows = [(n, title + body) for n, body in m.NOTICES for title in (m.TITLES.get(n, [""]) if "\n" in body else [""])]
    values = ", ".join(f"('{n}', '{q(b)}')" for n, b in rows)
    digests = ", ".join(f"('{n}', '{x}')" for n, x in m.DIGESTS)
    return f"""
WITH k AS (SELECT licence, sha256(array_to_string({lines}, ' ')) AS digest FROM (VALUES {values}) v(licence, text)
           UNION SELECT licence, digest FROM (VALUES {digests}) w(licence, digest)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {lines} AS lines FROM documents),
u AS (SELECT rid, array_to_string(lines, ' ') AS unit, true AS whole FROM d UNION ALL SELECT rid, unnest(lines), false FROM d),
f AS (SELECT rid, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, count(DISTINCT licence) AS n, bool_or(whole) AS w
      FROM u JOIN k ON sha256(u.unit) = k.digest GROUP BY rid)
SELECT d.doc_id, coalesce(f.licences, '') AS licences, coalesce(f.n, 0)::INTEGER AS n_licences, coalesce(f.w, false) AS whole_text
FROM d LEFT JOIN f USING (rid)
"""


@register("op3_licences", _licence_sql())
def op3_licences(spark, sf_dir):
    from faultline.llm.licences import licence_scan
    return licence_scan(table(spark, sf_dir, "documents"))


@register("op4_decontaminate", rf"""
WITH iw AS (SELECT item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS g
        FROM (SELECT item_id, w, l, unnest(generate_series(1, len(w) - l + 1)) AS i
              FROM (SELECT *, least(13, len(w)) AS l FROM iw WHERE len(w) > 0))),
dw AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
dg AS (SELECT rid, i, l, array_to_string(w[i:i + l - 1], ' ') AS g
       FROM (SELECT rid, w, l, unnest(generate_series(1, len(w) - l + 1)) AS i FROM dw, (SELECT DISTINCT l FROM win))),
hit AS (SELECT rid, i, l, item_id FROM dg JOIN win USING (g, l)),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + l - 1)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s
       FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hw USING (rid) LEFT JOIN it USING (rid)
""")
def op4_decontaminate(spark, sf_dir):
    from faultline.llm.decontam import contamination
    c = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return c.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def _mix_sql() -> str:
    from faultline.llm import mixing as m
    out = [rf"""WITH b AS (SELECT doc_id, text, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  greatest(len(regexp_extract_all(coalesce(text, ''), '{m.WORD}')), 1)::BIGINT AS n,
  greatest(coalesce(length(text), 0), 1) AS size FROM documents),
t AS (SELECT *, CASE WHEN text IS NOT NULL AND len(regexp_extract_all(text, '{m.SYMBOLS}')) * 50 >= size THEN 'symbols'
  WHEN text IS NOT NULL AND len(regexp_extract_all(text, '[0-9]')) * 20 >= size THEN 'numbers'
  WHEN n < 100 THEN 'brief' WHEN n < 1000 THEN 'article' ELSE 'long' END AS topic FROM b),
cells AS (SELECT source, lang, topic, sum(n)::DOUBLE AS tokens FROM t GROUP BY ALL)"""]
    for d in m.DIMS:
        out.append(f"g_{d} AS (SELECT {d}, pow(sum(tokens), {m.TEMPER[d]}) AS g FROM cells GROUP BY {d}), "
                   f"goal_{d} AS (SELECT {d}, g / sum(g) OVER () AS goal_{d} FROM g_{d})")
    joins = " ".join(f"JOIN goal_{d} USING ({d})" for d in m.DIMS)
    out.append(f"w0 AS (SELECT *, tokens AS w FROM cells {joins})")
    k = 0
    for _ in range(m.ROUNDS):
        for d in m.DIMS:
            out.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (w * goal_{d} / sum(w) OVER (PARTITION BY {d}) AS w) FROM w{k})")
            k += 1
    out.append(f"w AS MATERIALIZED (SELECT source, lang, topic, tokens, w / sum(w) OVER () AS w FROM w{k})")
    out.append(f"f0 AS (SELECT {m.BUDGET} * sum(tokens) AS want, {m.BUDGET} * sum(tokens) AS f FROM w)")
    for i in range(m.FACTOR_ROUNDS):
        out.append(f"f{i + 1} AS MATERIALIZED (SELECT any_value(want) AS want, any_value(f) * any_value(want) / sum(least(tokens, f * w)) AS f FROM w, f{i})")
    out.append(f"p AS (SELECT source, lang, topic, round(least(1.0, f * w / tokens), 6) AS probability FROM w, f{m.FACTOR_ROUNDS})")
    return ", ".join(out) + f"""
SELECT doc_id, source, lang, topic, n AS n_tokens, probability,
  ('0x' || substr(md5('{m.SEED}' || coalesce(doc_id::VARCHAR, text, '')), 1, 12))::BIGINT::DOUBLE / {16**12}.0 < probability AS sampled
FROM t JOIN p USING (source, lang, topic)"""


@register("op10_mixing", _mix_sql())
def op10_mixing(spark, sf_dir):
    from faultline.llm.mixing import mix
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"),
        "_mix.topic", "_mix.n_tokens", "_mix.probability", "_mix.sampled")


@register("op6_line_dedup")
def op6_line_dedup(spark, sf_dir):
    from faultline.llm.lines import dedup_lines
    d = dedup_lines(table(spark, sf_dir, "documents"), short=True)
    return d.select("doc_id", F.col("_lines.n_lines").cast("long").alias("n_lines"), F.col("_lines.n_removed").cast("long").alias("n_removed"),
                    F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
                    F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@register("op9_language")
def op9_language(spark, sf_dir):
    """Documents and pages, each on its own evidence."""
    from faultline.llm.langid import identify_documents, identify_pages
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    a = identify_documents(docs, docs, ["doc_id"]).select("doc_id", F.lit(None).cast("long").alias("page_id"), "_lang.*")
    b = identify_pages(pages, docs, ["page_id"]).select(F.lit(None).cast("long").alias("doc_id"), "page_id", "_lang.*")
    return a.union(b)


@register("op7_main_text")
def op7_main_text(spark, sf_dir):
    from faultline.llm.html import extract
    return extract(table(spark, sf_dir, "pages"))


@register("op8_lm_score")
def op8_lm_score(spark, sf_dir):
    from faultline.llm.lm import score_documents
    return score_documents(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


@register("op2_repeats")
def op2_repeats(spark, sf_dir):
    from faultline.llm.repeats import remove_repeats
    r = remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    kept = F.col("_rest.kept")
    return r.select("doc_id", F.col("_rest.n_bytes").alias("n_bytes"), (F.col("_rest.n_bytes") - F.octet_length(kept)).alias("n_removed"),
                    F.size("_rest.spans").cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"))


@register("op11_exact_dedup", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT *, row_number() OVER w AS rank, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST, rid))
SELECT doc_id, keep_id, group_size, rank = 1 AS kept, sha256(norm) AS text_sha256 FROM r
""")
def op11_exact_dedup(spark, sf_dir):
    from faultline.llm.exact import exact_dedup
    return exact_dedup(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "_exact.*")


@register("op12_hard_negatives", """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid, a.vec_id AS anchor_id, c.rid AS crid, c.vec_id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= 5),
w AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.rid, p.crid ORDER BY n.score DESC, n.vec_id) AS rank
  FROM p JOIN s n ON n.rid = p.rid AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 10
""")
def op12_hard_negatives(spark, sf_dir):
    from faultline.llm.negatives import mine
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def _repair_sql() -> str:
    none = "{'c': 1000000000, 'a': '', 'o': []::VARCHAR[]}"

    def add(x: str, cost: str, letter: str, line: str | None = None) -> str:
        out = f"{x}.o" if line is None else f"list_append({x}.o, {line})"
        return f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'o': {out}}}"

    def least(*xs: str) -> str:
        return f"list_min([{', '.join(xs)}])"

    def stays(x: str, initial: str, name: str | None) -> list[str]:
        kept = f"CASE WHEN left(role, 1) = '{initial}' THEN may ELSE 1000000000 END"
        return [add(x, kept, "K", "role || ':' || text")] + ([add(x, "3 + may", "R", f"'{name}:' || text")] if name else [])

    closed = f"""SELECT *, {least('s[4]', add('u', '3', 'I', "'assistant:'"))} AS a FROM (
      SELECT *, {least('s[3]', *[add(f's[{i}]', '3', 'I', "'user:'") for i in (1, 2, 4)])} AS u FROM"""
    return rf"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) r(n))),
h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
        lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS h FROM conversations, tab),
d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, range(2) c(n) WHERE h <> 0 AND (n = 0 OR h = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d),
o AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS late FROM n),
r AS (SELECT *, CASE WHEN blank OR dup THEN 1000000000 WHEN late THEN 3 ELSE 0 END AS may FROM o),
ids AS (SELECT DISTINCT conv_id FROM conversations),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, [{{'c': 0, 'a': '', 'o': []::VARCHAR[]}}, {none}, {none}, {none}] AS s FROM ids
  UNION ALL
  SELECT conv_id, i, [{add('s[1]', '4', 'D')}, {least(add('s[2]', '4', 'D'), *stays('s[1]', 's', None))},
    {least(add('u', '4', 'D'), *[x for e in ('s[1]', 's[2]', 'a') for x in stays(e, 'u', 'user')])},
    {least(add('a', '4', 'D'), *stays('u', 'a', 'assistant'))}] AS s
  FROM ({closed} (SELECT r.conv_id, r.i, r.role, r.text, r.may, dp.s FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1)))),
last AS (SELECT conv_id, {least('s[1]', 'a')} AS e FROM ({closed} (SELECT * FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)))),
f AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (dup AND NOT blank) AS duplicate, count(*) FILTER (late AND NOT dup AND NOT blank) AS truncated,
    count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY conv_id)
SELECT l.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, e.c::BIGINT AS cost, e.a AS audit, sha256(coalesce(array_to_string(e.o, chr(10)), '')) AS repaired_sha256
FROM last l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id
"""


@register("op13_conversation_repair", _repair_sql())
def op13_conversation_repair(spark, sf_dir):
    from faultline.llm.conversations import damaged, repair
    return repair(damaged(table(spark, sf_dir, "conversations")))


QUERIES["pipeline"] = corpus_pipeline.run

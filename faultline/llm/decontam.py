"""Benchmark decontamination: prefix-filtered set join with exact verification.

Every benchmark item is cut into windows of 13 words (an item of fewer words is
one window).  Word shingles of both sides are ordered by their rarity in the
corpus.  As a window must be contained whole, its necessary prefix is one
shingle, the rarest: only documents that hold it can hold the window.  Each such
meeting fixes where the window would start; length and position bounds drop what
would stick out, and the words at that place are compared exactly.

The main path uses DataFrame functions only.  The texts are read twice and never
shuffled while the candidates fit a measured broadcast bound; beyond it they are
joined by (doc_id, text hash).

Defined cases: a null or wordless text has no words and no hit; items with a null
id or no words take no part; rows repeated in documents give repeated results;
texts of one item id are all windows of that item.  Columns of the documents
beside doc_id and text are carried through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import BROADCAST_BYTES, ascii_lower, broadcast_checked, fresh, written

WINDOW = 13
SHINGLE = 3
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what separates words once A-Z are lower-case


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), GAP), "")


def _shingles(w: Column, size: int) -> Column:
    """Hash of the ``size`` words that start at each position."""
    last = F.size(w) - size
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))
    return F.when(last >= 0, hashes).otherwise(F.array().cast("array<bigint>"))


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct windows: their words as one string, length, and the items that have them."""
    w = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(window)))
    w = w.select("item", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at"))
    return (w.select(F.slice("w", F.col("at"), F.col("len")).alias("w"), "item").groupBy("w")
            .agg(F.collect_set("item").alias("items"))
            .select(F.array_join("w", " ").alias("words"), "w", F.size("w").alias("len"), "items"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: n_words, spans (array of start,
    end in words: verified windows, sorted) and items (sorted ids as strings)."""
    own_words, result = fresh(docs, "_words", "_dc")
    win = written(_windows(benchmark, window), "decontam-windows")
    sizes = sorted(r[0] for r in win.select(F.least("len", F.lit(SHINGLE))).distinct().collect())  # at most SHINGLE values
    empty = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    text_id = F.xxhash64(F.col("text"))
    if not sizes:
        none = F.struct(F.size(words(F.col("text"))).alias("n_words"), F.array_remove(F.array(empty), empty).alias("spans"),
                        F.array().cast("array<string>").alias("items"))
        return docs.withColumn(result, none), result

    def hashed(df: DataFrame, size: int, *keep: str) -> DataFrame:
        return df.select(*keep, F.posexplode(_shingles(F.col("w"), size)).alias("pos", "h")).withColumn("size", F.lit(size))

    def all_hashed(df: DataFrame, of_size, *keep: str) -> DataFrame:
        parts = [hashed(of_size(df, s), s, *keep) for s in sizes]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    own = written(all_hashed(win, lambda df, s: df.where(F.least("len", F.lit(SHINGLE)) == s), "words", "len", "items"), "decontam-own")
    wanted = broadcast_checked(written(own.select("h", "size").distinct(), "decontam-wanted"), 32, limit)
    tokens = docs.select(F.col("doc_id").cast("long").alias("d"), text_id.alias("t"), words(F.col("text")).alias("w"))
    tokens = tokens.withColumn("n", F.size("w"))
    met = written(all_hashed(tokens, lambda df, s: df, "d", "t", "n").join(wanted, ["h", "size"]), "decontam-met")

    rarity = met.groupBy("h", "size").count()
    prefix = (own.join(rarity, ["h", "size"], "left").groupBy("words")
              .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "h", "pos", "size", "len", "items")).alias("p"))
              .where("p.count > 0").select("words", "p.h", "p.size", F.col("p.pos").alias("off"), "p.len", "p.items"))
    prefix = broadcast_checked(written(prefix, "decontam-prefix"), 512, limit)
    start = F.col("pos") - F.col("off")
    cand = (met.join(prefix, ["h", "size"]).where((start >= 0) & (start + F.col("len") <= F.col("n")))
            .select("d", "t", F.struct(start.alias("start"), "len", "words", "items").alias("c")))
    cand = written(cand.groupBy("d", "t").agg(F.collect_set("c").alias("cands")), "decontam-cand")
    # bytes that a broadcast of the candidates would take
    volume = cand.agg(F.sum(F.lit(64) + F.aggregate("cands", F.lit(0), lambda a, c: a + 64 + F.octet_length(c.words) + 32 * F.size(c["items"])))).first()[0] or 0
    cand = F.broadcast(cand) if volume <= limit else cand

    out = docs.withColumn(own_words, words(F.col("text"))).alias("docs")
    cand = cand.alias("cand")
    out = out.join(cand, F.col("docs.doc_id").cast("long").eqNullSafe(F.col("cand.d")) & (text_id_of("docs") == F.col("cand.t")), "left")
    w = F.col(f"docs.{own_words}")
    seen = F.array_sort(F.filter(F.coalesce("cand.cands", F.array_remove(F.array(_no_cand()), _no_cand())),
                                 lambda c: F.array_join(F.slice(w, c.start + 1, c.len), " ") == c.words))
    dc = F.struct(F.size(w).alias("n_words"),
                  F.transform(seen, lambda c: F.struct(c.start.alias("start"), (c.start + c.len).alias("end"))).alias("spans"),
                  F.array_sort(F.array_distinct(F.flatten(F.transform(seen, lambda c: c["items"])))).alias("items"))
    return out.select(*[F.col(f"docs.`{c}`") for c in docs.columns], dc.alias(result)), result


def text_id_of(alias: str) -> Column:
    return F.xxhash64(F.col(f"{alias}.text"))


def _no_cand() -> Column:
    return F.struct(F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit("").alias("words"), F.array().cast("array<string>").alias("items"))


def covered(spans: Column) -> Column:
    """Number of words in the union of sorted (start, end) spans."""
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(spans, first, lambda a, s: F.struct(
        (a.n + F.greatest(F.lit(0), s.end - F.greatest(a.upto, s.start))).alias("n"), F.greatest(a.upto, s.end).alias("upto")),
        lambda a: a.n)


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20, **kw) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items and contaminated (a hit, and at least
    one word in ``share`` hit) of every document."""
    d, c = scan(docs, benchmark, **kw)
    hit, n = covered(F.col(f"{c}.spans")), F.col(f"{c}.n_words").cast("long")
    return (d.select("doc_id", n.alias("n_words"), hit.alias("n_hit"), F.col(f"{c}.spans").alias("spans"), F.col(f"{c}.items").alias("items"))
            .withColumn("contaminated", F.expr(f"n_hit > 0 and {share} * n_hit >= n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: int = 20, **kw) -> DataFrame:
    """``docs`` without the contaminated rows, columns unchanged."""
    d, c = scan(docs, benchmark, **kw)
    hit = covered(F.col(f"{c}.spans"))
    return d.where(~((hit > 0) & (share * hit >= F.col(f"{c}.n_words")))).select(*[f"`{c}`" for c in docs.columns])

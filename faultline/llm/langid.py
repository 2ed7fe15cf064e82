"""Language identification by Bayesian evidence fusion.

Text: a byte-trigram model (hashed, add-half smoothed) fitted on a bounded sample
of each language's labelled documents gives each row's log-likelihood under every language, over
its whole text, tempered to ``EVIDENCE`` trigrams' weight as neighbours depend on
one another.  Declared markup language and address suffix: P(value | language)
from soft counts of the text posteriors, grouped by value.  Host: a prior per host
smoothed towards its domain, and that towards the whole corpus, from soft counts
grouped by host and domain.  The log evidences add up; the softmax is the posterior.

A row is rejected if it has no text evidence (null, or without a letter),
if a text of ``EVIDENCE`` trigrams or more is less likely under every language
than under a uniform spread, or if no language reaches ``accept``.

Defined cases: null declared language, suffix or host add no evidence (a null
host takes the corpus prior); repeated rows get equal results; if no labelled row
exists, every language is null and every row is rejected.  Other columns are
carried through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import BROADCAST_BYTES, LOWER, UPPER, broadcast_checked, written

#: About so many labelled rows of each language, chosen by a hash of their id, fit the model.
TRAIN_ROWS = 8000
BUCKETS = 1 << 14
EVIDENCE = 30.0
KAPPA = 20.0  # rows that a parent's prior counts for
ACCEPT = 0.5
SCALE = 1 << 16  # log probabilities are held as integers: sums do not depend on batches
SLICE = 1 << 19  # the arrays of a slice take about 60 bytes a byte of text
FOLD = np.arange(256, dtype=np.uint32)
FOLD[:128] = 32  # white space, punctuation and symbols are all a gap
FOLD[list(LOWER.encode())] = FOLD[list(UPPER.encode())] = list(LOWER.encode())
FOLD[list(b"0123456789")] = 0


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of every byte trigram; BUCKETS for one that says nothing of the
    language, as it holds a digit or two gaps side by side."""
    b = FOLD[data]
    some = (b[:-1] > 0) & (b[1:] > 0) & ((b[:-1] != 32) | (b[1:] != 32))
    word = some[:-1] & some[1:]
    x = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D))
    return np.where(word, (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(18), np.uint32(BUCKETS))


def _slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row ends with a leading 0) of the texts, about SLICE bytes at a
    time; the bytes are views of the batch, not copies."""
    column = column.fill_null("").cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE, "right")) - 1)
        yield a, data[ends[a]: ends[b]], ends[a: b + 1] - ends[a]
        a = b


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for first, data, cut in _slices(batch.column("text")):
            for i in range(len(cut) - 1):
                piece = data[cut[i]: cut[i + 1]]
                if len(piece) >= 3:
                    add = np.bincount(trigrams(piece), minlength=BUCKETS + 1)[:BUCKETS]
                    lang = langs[first + i]
                    total[lang] = total[lang] + add if lang in total else add
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probability tables from about ``rows`` rows of each
    language of ``labelled`` (id, text, lang), all if it has no more, one at least.
    What reaches the driver is bounded by the languages times the buckets."""
    draw = F.pmod(F.xxhash64(F.lit("train"), "id"), F.lit(1_000_000))
    known = labelled.where("lang is not null and text is not null").withColumn("_draw", draw)
    share = known.groupBy("lang").agg((F.lit(rows * 1_000_000) / F.count("*")).alias("_under"), F.min("_draw").alias("_least"))
    share = broadcast_checked(written(share, "langid-share"), 64)
    sample = known.join(share, "lang").where((F.col("_draw") < F.col("_under")) | (F.col("_draw") == F.col("_least")))
    got = (sample.select("lang", "text").mapInArrow(_counts, "lang string, bucket int, n long")
           .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(got["lang"].unique())
    model = np.full((len(langs), BUCKETS), 0.5)
    for i, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        model[i, own["bucket"]] += own["n"]
    model = np.log(model / model.sum(axis=1, keepdims=True)) if langs else model
    return langs, np.round(model * SCALE).astype(np.int32)


def _score(model: np.ndarray, keep: bool = False):
    """Log-likelihoods of the texts; with ``keep`` the texts stay beside them."""
    floor = -np.log(BUCKETS)
    model = np.pad(model, ((0, 0), (0, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ll, plain = np.zeros((batch.num_rows, len(model))), np.zeros(batch.num_rows, bool)
            for first, data, cut in _slices(batch.column("text")):
                at = trigrams(data) if len(data) >= 3 else np.zeros(0, np.uint32)
                letters = np.concatenate([[0], np.cumsum(FOLD[data] > 32)])
                letters = letters[cut[1:]] > letters[cut[:-1]]
                lo, hi = cut[:-1], np.maximum(cut[1:] - 2, cut[:-1])
                lo, hi = np.minimum(lo, len(at)), np.minimum(hi, len(at))
                seen = np.concatenate([[0], np.cumsum(at < BUCKETS)])
                count = seen[hi] - seen[lo]
                n = np.maximum(count, 1)
                rows = slice(first, first + len(lo))
                for k, table in enumerate(model):
                    total = np.concatenate([[0], np.cumsum(table[at], dtype=np.int64)])
                    mean = (total[hi] - total[lo]) / n / SCALE
                    ll[rows, k] = mean * np.minimum(n, EVIDENCE)
                    plain[rows] |= letters & ((mean > floor) | (count < EVIDENCE))
            names = [c for c in batch.schema.names if keep or c != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(list(ll), pa.list_(pa.float64())), pa.array(plain)],
                                             names=names + ["ll", "plain"])
    return run


def _softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sums(df: DataFrame, k: int, *by: str) -> DataFrame:
    """Soft counts per language of each group, as an array ``c``."""
    return (df.groupBy(*by).agg(*[F.sum(F.get("post", F.lit(i))).alias(f"c{i}") for i in range(k)])
            .select(*by, F.array(*[F.col(f"c{i}") for i in range(k)]).alias("c")))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _smooth(own: Column, parent: Column) -> Column:
    """Soft counts to a prior that the parent counts ``KAPPA`` rows in."""
    return F.transform(own, lambda v, i: (v + KAPPA * F.get(parent, i)) / (_total(own) + KAPPA))


def identify(df: DataFrame, langs: list[str], model: np.ndarray, text: Column | str, declared: Column, address: Column | None, host: Column,
             carry: list[str], accept: float = ACCEPT, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The columns ``carry`` of ``df`` with ``_lang``: language, posterior and
    accepted (a carried column of that name is replaced).  A ``text`` given by its
    name and carried goes to Python and back once, not beside itself in the row."""
    k = len(langs)
    once = text if isinstance(text, str) and text in carry and len(carry) > 1 and df.schema[text].dataType == T.StringType() else None
    text = F.col(f"`{text}`") if isinstance(text, str) else text
    rows = [F.col(f"`{c}`") for c in carry]
    if not k:
        return df.select(*rows, F.struct(F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"),
                                         F.lit(False).alias("accepted")).alias("_lang"))
    suffix = F.lit(None) if address is None else F.lower(F.regexp_extract(address, r"^[a-zA-Z]+://[^/:?#]*\.([A-Za-z]+)(?:[/:?#]|$)", 1))
    seen = df.select(F.struct(*[r for r, c in zip(rows, carry) if c != once]).alias("row"), F.lower(declared).cast("string").alias("declared"), suffix.cast("string").alias("suffix"),
                     F.lower(host).cast("string").alias("host"), text.cast("string").alias("text"))
    schema = T.StructType([*(seen if once else seen.drop("text")).schema.fields]).add("ll", T.ArrayType(T.DoubleType())).add("plain", T.BooleanType())
    seen = seen.mapInArrow(_score(model, once is not None), schema)
    seen = seen.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+|[^.]+)$", 1)).withColumn("post", _softmax(F.col("ll")))
    seen = written(seen, "langid-text")

    total = seen.agg(*[F.sum(F.get("post", F.lit(i))) for i in range(k)]).first()
    whole = sum(x or 0.0 for x in total)
    corpus = F.array(*[F.lit(((x or 0.0) + 1.0) / (whole + k)) for x in total])
    zero = F.array(*[F.lit(0.0)] * k)
    hosts = _sums(seen.where("host is not null"), k, "host", "domain")
    domains = hosts.groupBy("domain").agg(*[F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(k)])
    domains = domains.select("domain", _smooth(F.array(*[F.col(f"c{i}") for i in range(k)]), corpus).alias("dp"))
    hosts = hosts.join(domains, "domain").select("host", _smooth(F.col("c"), F.col("dp")).alias("hp"))
    out = seen.join(broadcast_checked(written(hosts, "langid-hosts"), 128, limit), "host", "left")
    for name in ("declared", "suffix"):
        c = written(_sums(seen.where(F.col(name).isNotNull() & (F.col(name) != "")), k, name), f"langid-{name}")
        n, *per = c.agg(F.count("*"), *[F.sum(F.get("c", F.lit(i))) for i in range(k)]).first()
        share = F.array(*[F.log((F.get("c", F.lit(i)) + 0.5) / F.lit((per[i] or 0.0) + 0.5 * max(n, 1))) for i in range(k)])
        out = out.join(broadcast_checked(c.select(name, share.alias(f"e_{name}")), 128, limit), name, "left")
    logits = F.transform("ll", lambda v, i: v + F.log(F.get(F.coalesce("hp", corpus), i)) + F.get(F.coalesce("e_declared", zero), i)
                         + F.get(F.coalesce("e_suffix", zero), i))
    out = out.withColumn("p", _softmax(logits)).withColumn("top", F.array_max("p"))
    names = F.array(*[F.lit(x) for x in langs])
    return out.select(*[F.col("text").alias(c) if c == once else F.col(f"row.`{c}`") for c in carry if c.lower() != "_lang"], F.struct(
        F.get(names, (F.array_position("p", F.col("top")) - 1).cast("int")).alias("language"), F.round("top", 6).alias("posterior"),
        (F.col("plain") & (F.col("top") >= accept)).alias("accepted")).alias("_lang"))


def identify_documents(docs: DataFrame, labelled: DataFrame, carry: list[str], **kw) -> DataFrame:
    """Documents: the declared language is ``lang``, the host is ``source``."""
    langs, model = fit(labelled.select(F.col("doc_id").alias("id"), "text", "lang"))
    return identify(docs, langs, model, "text", F.col("lang"), None, F.col("source"), carry, **kw)


MARKUP = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def identify_pages(pages: DataFrame, labelled: DataFrame, carry: list[str], **kw) -> DataFrame:
    """Pages: text without markup, the declared language from <html lang>, suffix and host from the url."""
    langs, model = fit(labelled.select(F.col("doc_id").alias("id"), "text", "lang"))
    html = F.col("html")
    declared = F.nullif(F.regexp_extract(html, r"""(?i)<html[^>]*\blang\s*=\s*["']?([A-Za-z]+)""", 1), F.lit(""))
    host = F.nullif(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]*)", 1), F.lit(""))
    return identify(pages, langs, model, F.regexp_replace(html, MARKUP + "|&[A-Za-z]+;|&#[0-9A-Fa-fxX]+;", " "), declared, F.col("url"), host, carry, **kw)

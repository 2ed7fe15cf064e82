from pyspark.sql import functions as F

from faultline.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_without_declared_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    langs, model = langid.fit(docs.where(~held).select(F.col("doc_id").alias("id"), "text", "lang"))
    assert langs == ["de", "en", "es", "fr"]
    none = F.lit(None).cast("string")
    got = langid.identify(docs.where(held), langs, model, F.col("text"), none, None, none, ["doc_id", "lang"]).collect()
    assert len(got) > 150
    assert sum(r._lang.language == r.lang for r in got) / len(got) >= 0.97


def test_priors_by_hand(spark):
    """Rows without text lean on declared language and host alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(i, "th the and of in this that with " * 5 + "tion ing", "en", "a.x.net") for i in range(50)]
    rows += [(100, "zq", "en", "a.x.net"), (101, None, "en", "a.x.net"), (102, "", None, None), (103, "zq", None, None), (103, "zq", None, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, text string, lang string, host string, row string")
    langs, model = langid.fit(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    got = {r.id: r for r in langid.identify(df, langs, model, F.col("text"), F.col("lang"), None, F.col("host"), df.columns).collect()}
    assert got[0]._lang.language == "en" and got[0]._lang.accepted and got[0].row == "clash"
    assert not got[101]._lang.accepted and got[101]._lang.language == "en"
    assert not got[102]._lang.accepted
    assert len(got) == 54


def test_no_labels_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "some text", None, None)], "doc_id long, text string, lang string, source string")
    r = langid.identify_documents(df, df, ["doc_id"]).collect()
    assert r[0]._lang.language is None and not r[0]._lang.accepted
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert langid.identify_documents(df.limit(0), docs, ["doc_id"]).collect() == []


def test_long_text_counts_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    de, en = (" ".join(r.text for r in docs.where(F.col("lang") == x).limit(8).collect()) for x in ("de", "en"))
    df = spark.createDataFrame([(1, en[:3000] + de * 30), (2, de[:3000] + en * 30)], "doc_id long, text string")
    langs, model = langid.fit(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    none = F.lit(None).cast("string")
    got = {r.doc_id: r._lang.language for r in langid.identify(df, langs, model, F.col("text"), none, None, none, ["doc_id"]).collect()}
    assert got == {1: "de", 2: "en"}


def test_rare_language_has_a_class_beside_many_rows(spark):
    common = spark.range(4000).select(F.col("id"), F.lit("the words of this text and that").alias("text"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame([(-1, "una frase breve con palabras", "es"), (-2, "zwei kurze Worte und mehr", "de"), (None, "quelques mots", "fr")], "id long, text string, lang string")
    langs, model = langid.fit(common.union(rare), rows=20)
    assert langs == ["de", "en", "es", "fr"] and len(model) == 4


def test_memory_follows_the_slice_not_the_batch():
    """Texts are views of their batch, in slices; a batch as Spark sends it takes far less than its own size again."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    texts = [None if i % 50 == 7 else "" if i % 50 == 9 else "übel zu tragen 1234 " * (i % 200) for i in range(8000)]
    column = pa.array(["lead"] + texts).slice(1)
    back = [bytes(data[a:b]) for _, data, cut in langid._slices(column) for a, b in zip(cut[:-1], cut[1:])]
    assert back == [(t or "").encode() for t in texts]
    batch = pa.record_batch({"text": column})
    model = np.random.default_rng(1).integers(-900000, -100000, (4, langid.BUCKETS)).astype(np.int32)
    tracemalloc.start()
    (out,) = langid._score(model, True)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.column("text") == column and out.num_rows == 8000
    assert peak < 64 << 20, peak


def test_carried_text_is_sent_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(-1, None, "en", "s"), (-1, "", None, None)], "doc_id long, text string, lang string, source string")
    df = docs.select("doc_id", "text", "lang", "source").union(odd)
    got = langid.identify_documents(df, docs, df.columns)
    assert sorted(map(str, df.collect())) == sorted(map(str, got.select(*df.columns).collect()))
    beside = langid.identify_documents(df, docs, ["doc_id"])
    assert sorted(map(str, got.select("doc_id", "_lang").collect())) == sorted(map(str, beside.collect()))

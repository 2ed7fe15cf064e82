from pyspark.sql import functions as F
from test_lines import brute as brute_lines
from test_native import brute as brute_items
from test_simhash import brute as brute_groups

import corpus_pipeline as P
from faultline.llm import mixing

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 900 or doc_id < 25").orderBy("doc_id").limit(70)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs.collect()]
    extra = [(9001, rows[3][1], "en", "src0", 1), (9002, None, "en", "src0", None), (9003, "12 34", "de", None, 5), (9004, bench[0][1], "en", "src1", 7),
             (9005, rows[3][1] + " word", None, "src1", 7), (9006, "Unique opening words.\n" + rows[8][1].split("\n")[0] + ".", "en", "src1", 7)]
    docs = spark.createDataFrame(rows + extra, docs.schema)
    cols = docs.columns
    frames = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(cols)] == cols
        frames[name] = out = out.cache()
        docs = out
    text = {n: {r.doc_id: r.text for r in f.collect()} for n, f in frames.items()}
    start = {r[0]: r[1] for r in rows + extra}
    # language: only the null and the wordless row go
    assert set(start) - set(text["language"]) == {9002, 9003}
    assert {r.doc_id: r.lang for r in frames["language"].collect()}[9005] == "en"
    # lines
    want = {d: t for d, t, n, gone in brute_lines(list(text["language"].items()), short=True) if not (gone and not t)}
    assert text["lines"] == want
    assert all(r.n_chars == len(r.text) for r in frames["lines"].collect() if r.text != start[r.doc_id])
    # near duplicates: the smallest id of every group
    assert set(text["near_duplicates"]) == {c for _, _, c in brute_groups(list(text["lines"].items()))}
    # benchmark
    clean = {d for d, _, _, _, bad in brute_items(list(text["near_duplicates"].items()), bench) if not bad}
    assert set(text["decontaminate"]) == clean and 9004 not in clean
    # mixing draws from what is left, by the recorded probability
    drawn = {r.doc_id: r._mix for r in mixing.mix(frames["decontaminate"]).collect()}
    assert set(text["mix"]) == {d for d, m in drawn.items() if m.sampled} <= clean
    for f in frames.values():
        f.unpersist()


def test_run_and_empty_documents(spark):
    out = P.run(spark, SF)
    assert 0 < out.count() < 200 and out.select("doc_id").distinct().count() == out.count()
    empty = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(12)
    for c in ("_d", "_t", "_n", "_p", "_words", "_dc", "_mix", "_lang", "_lines", "_mix_topic", "row", "fp", "words", "topic"):
        docs = docs.withColumn(c, F.lit(7))
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns
        assert all(r._d == r._t == r.row == r.topic == 7 for r in out.collect())

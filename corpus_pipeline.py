"""Corpus pipeline: documents in, a de-duplicated, decontaminated and mixed corpus out.

Each stage is a function (spark, docs, sf_dir) -> DataFrame.  Its result is
written as Parquet and read again as the next stage's ``docs``; all but the last
return the columns of documents.

* language: documents whose language cannot be told are dropped; ``lang`` becomes
  the language found.
* lines: repeated lines leave the texts; documents left without any line are dropped.
* near_duplicates: one document of each SimHash group stays, that of the smallest doc_id.
* decontaminate: documents with a twentieth or more of their words in benchmark windows are dropped.
* mix: documents are drawn by probabilities raked to the target marginals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import table, written
from faultline.llm.decontam import decontaminate
from faultline.llm.langid import identify_documents
from faultline.llm.lines import dedup_lines
from faultline.llm.mixing import mix
from faultline.llm.simhash import simhash_dedup
from faultline.session import ship_package

ORACLE_SQL = None  # line links, SimHash and language ID are beyond SQL; tests hold the stages against brute force


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and wordless texts have no language and go; nulls of other columns are evidence for none."""
    ship_package(spark)
    out = identify_documents(docs, docs, docs.columns).where("_lang.accepted")
    return out.withColumn("lang", F.col("_lang.language")).select(*[f"`{c}`" for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines repeat by two edits, short ones by their exact text; rows that share doc_id and text fare alike."""
    ship_package(spark)
    out = dedup_lines(docs, short=True).where("_lines.n_removed = 0 or text <> ''")
    n = F.when(F.col("_lines.n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType)).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingle length and distance are those of the operator's contract; null and empty texts link with one another."""
    ship_package(spark)
    return simhash_dedup(docs, shingle=3, bits=3)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A text without words holds no window and stays."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null source and language are a category of their own; a null doc_id draws by its text."""
    ship_package(spark)
    extra = [F.col(f"_mix.{c}").alias(c) for c in ("n_tokens", "topic", "probability") if c not in docs.columns]
    return mix(docs).where("_mix.sampled").select(*[f"`{c}`" for c in docs.columns], *extra)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", benchmark), ("mix", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

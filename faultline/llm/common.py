"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import scratch_dir, sf_path, ship_package

#: A side is broadcast only after its written form was measured to be within
#: this many bytes (rows x declared row width); beyond it a shuffle join runs.
BROADCAST_BYTES = 32 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(sf_path(sf_dir, name))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: it is computed
    once, its lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_checked(df: DataFrame, row_bytes: int, limit: int | None = None) -> DataFrame:
    """``df`` (already written) with a broadcast hint if its rows, counted now,
    take at most ``limit`` bytes; otherwise unchanged, for a shuffle join."""
    limit = BROADCAST_BYTES if limit is None else limit
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, made longer where ``df`` already has such a column."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Texts that are all ASCII take the fast ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))

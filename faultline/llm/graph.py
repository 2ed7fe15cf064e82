"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to ``node, root`` with root the smallest node of the
    component.  Only nodes with an edge appear.

    Each round hangs every node's larger neighbours, then its smaller ones, on the
    smallest neighbour it sees; stars are the fixed point.  Every round is written
    to the shared folder, and only a row count and a checksum reach the driver.
    """
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc")
    state = _state(e)
    while state[0]:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        # small star: b's smaller neighbours and b itself hang on the least of them
        low = e.groupBy("b").agg(F.min("a").alias("m"))
        e = (e.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")),
                                                       F.struct(F.col("m").alias("a"), F.col("b")))).alias("x"))
             .select("x.*").where("a <> b").distinct())
        e = written(e, "cc")
        new = _state(e)
        if new == state:
            break
        state = new
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

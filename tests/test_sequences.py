import os
import random

import duckdb
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF0001
from faultline.operators import rows
from tools.oracle_check import TABLES, rows_of


def test_every_full_window_has_a_summary(spark):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF0001, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    name = "win_sequence_summaries_step1"
    got = E.queries()[name](spark, SF0001).toPandas()
    first = got.sort_values(["api_name", "row_idx"])["row_idx"][:5]
    assert first.tolist() == [29, 30, 31, 32, 33]
    assert rows_of(got, 6) == rows_of(con.execute(E.oracle_sql()[name]).df(), 6)


def test_window_summaries_are_the_window_functions(spark):
    """Nulls, NaN, constant and narrow columns, null keys and times that tie: as avg and
    regr_slope over the frame say, but not by a frame that is read anew for each row."""
    rnd = random.Random(5)
    rows_in = [(i, rnd.choice(["a", "a", "b", None]), None if i % 97 == 0 else i // 3, None if 200 < i < 300 or i % 7 == 0 else rnd.uniform(-9, 9),
                0.1, rnd.choice([None, *range(9)]), float("nan") if i % 50 == 3 else rnd.random(), rnd.choice([None, *[0, 1] * 20])) for i in range(600)]
    df = spark.createDataFrame(rows_in, "event_id long, api_name string, timestamp int, x double, k float, i int, n double, success int")
    cols = ["x", "k", "i", "n"]
    out = rows.sequence_summaries(df, cols, 8, 3, (1, 4))
    assert "regr" not in out._jdf.queryExecution().toString().lower()
    w = Window.partitionBy("api_name").orderBy("timestamp", "event_id")
    frame, at = w.rowsBetween(-7, 0), F.col("at").cast("double")
    want = df.withColumn("at", F.row_number().over(w) - 1).select(
        "event_id", "api_name", F.col("at").cast("long").alias("row_idx"),
        *[e for c in cols for e in (F.avg(c).over(frame).alias(f"{c}_mean"), F.col(c).alias(f"{c}_last"), F.regr_slope(F.col(c).cast("double"), at).over(frame).alias(f"{c}_slope"))],
        *[F.lead(F.lit(1) - F.col("success"), h).over(w).alias(f"y_h{h}") for h in (1, 4)]).where("row_idx >= 7 AND (row_idx - 7) % 3 = 0 AND y_h4 IS NOT NULL")
    assert out.dtypes == want.dtypes
    got = sorted(map(repr, out.collect()))
    assert len(got) > 100 and got == sorted(map(repr, want.collect()))

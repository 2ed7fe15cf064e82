"""Registered queries vs their DuckDB oracle SQL on the smallest fixture
(the full sweep at sf0.01 is ``python tools/oracle_check.py``)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, rows_of

from conftest import SF0001

FAST = [
    "flagship_diagnosis", "feature_table", "agg_daily_summary", "agg_failure_modes", "agg_health_metrics",
    "win_boundary_contamination", "ml_roc_auc", "ml_average_precision", "ml_conformal_coverage",
    "dec_policy_metrics", "dec_reactive_actions", "dec_debounce", "smp_sample_n", "smp_split_stratified",
    "dq_clean_pipeline", "dr_ks_half_vs_half", "led_validate_transfers", "led_balances", "nrm_weblog",
    "src_tolerant_csv", "str_error_windows_1min",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF0001, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_registered_has_callable():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF0001).toPandas()
    odf = con.execute(E.oracle_sql()[name]).df()
    sc, sr = rows_of(sdf, 6)
    oc, orr = rows_of(odf, 6)
    assert sc == oc
    assert len(sr) == len(orr)
    assert sr == orr


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert [f.name for f in df.schema.fields] == ["api_name", "category", "n_rows", "failures", "failure_rate",
                                                  "avg_confidence"]

"""Registry of runnable queries (Spark) and their DuckDB oracle SQL.

Each entry: name -> (callable(spark, sf_dir) -> DataFrame, oracle SQL or None).
Modules register their queries on import; ``load_all`` imports them all.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all():
    # Import for side effects (registration).
    from faultline.plans import (  # noqa: F401
        q_features, q_aggregates, q_evaluation, q_decisions, q_quality, q_ledger, q_misc, q_models, q_streaming, q_improve, q_rows,
    )
    return QUERIES, ORACLES

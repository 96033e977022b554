"""Registry of named queries and their DuckDB oracles.

Each registered query is ``fn(spark, sf_dir) -> DataFrame`` over the whole
bundled tables; its oracle is an independent SQL formulation that DuckDB runs
on the same parquet files (views named after the tables).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

_MODULES = ("market_plans", "portfolio_plans", "scalar_plans", "fundamentals_plans",
            "news_plans", "document_plans", "vector_plans", "corpus_plans", "stream_plans",
            "sink_plans")


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    for m in _MODULES:
        try:
            importlib.import_module(f"riskfold.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"riskfold.plans.{m}":
                raise


def queries() -> dict[str, Callable]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLES)

"""Queries of the corpus operators: opN_<name> over the whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_MODULES = ("decontaminate", "substring_dedup", "line_clean", "language_crf", "url_templates",
            "token_pack", "mixing", "simhash", "pii", "secret_scan", "periodic_runs", "harmonic_pack",
            "importance_resample")

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"riskfold.llm.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)

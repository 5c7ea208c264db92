"""Collects every registered query."""
from __future__ import annotations

import importlib

from . import registry

MODULES = ["q_relational", "q_columns", "q_reports", "q_windows", "q_allocation", "q_stats", "q_models", "q_streaming", "q_registry"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"capshare.plans.{m}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLE)

"""Registry of named queries: a Spark callable and, where SQL can say it, the DuckDB text of the same result."""
from __future__ import annotations

from collections.abc import Callable

from .ctes import build

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, using: str = "", recursive: bool = False):
    """Register ``fn(spark, sf_dir)``; ``using`` names the shared views that ``sql`` reads."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = build(using.split(), sql, recursive)
        return fn

    return wrap

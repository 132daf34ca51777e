"""Registry of the library's queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Add a query (spark, sf_dir) -> DataFrame under ``name``, with its SQL twin if SQL can express it."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"the name {name} is taken")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add

"""Registered queries: one callable (spark, folder) -> DataFrame and, where the result can
be stated in SQL, the DuckDB statement it must equal."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def load() -> None:
    from crossrank.catalog import (  # noqa: F401
        calendars,
        cascades,
        data_quality,
        evaluation,
        ingest,
        learning,
        panels,
        scores,
        statistics,
        stores,
    )

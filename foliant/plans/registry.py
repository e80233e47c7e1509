"""Registers queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """Queries, SQL, and a decorator that adds a function and its SQL to them."""
    queries: dict[str, Callable] = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query

"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """Two dictionaries and the decorator that fills them under a function's name."""
    queries: dict = {}
    sqls: dict = {}

    def query(sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return add

    return queries, sqls, query

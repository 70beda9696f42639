"""Registers queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable] = {}
        self.SQL: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        """Registers the decorated query under its function's name."""

        def register(f: Callable) -> Callable:
            self.QUERIES[f.__name__] = f
            if sql:
                self.SQL[f.__name__] = sql
            return f

        return register

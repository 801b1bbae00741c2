"""How a module registers its queries."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Queries by name, and their SQL. A query takes (spark, sf_dir)."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            key = name or f.__name__
            self.queries[key] = f
            if sql is not None:
                self.sql[key] = sql
            return f

        return keep

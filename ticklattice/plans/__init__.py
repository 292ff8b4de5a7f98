"""Registered queries: each module ``q_*`` applies operators to tables and names the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable


class Queries:
    """Queries of a module by name, and their SQL."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(f: Callable) -> Callable:
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return register

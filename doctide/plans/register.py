"""Registering of queries together with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Plans:
    """Queries by function name; `query(sql)` registers the function it decorates."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def keep(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return keep

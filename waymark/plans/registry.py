"""How queries are put on record: a function under its name, with its SQL if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(query: Query) -> Query:
            name = "q_" + query.__name__.rstrip("_")
            self.queries[name] = query
            if sql:
                self.oracles[name] = sql
            return query

        return add

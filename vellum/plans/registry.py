"""The catalogue of named queries: each a DataFrame plan, most with an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a plan under a name, with SQL over the same tables where SQL can say it."""

    def add(plan: Query) -> Query:
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return add

"""Where queries register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.plans.bindings import Bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Bindings as a query, with its SQL where there is one."""

    def register(run: Callable[[Bindings], DataFrame]) -> Callable[[Bindings], DataFrame]:
        QUERIES[name] = lambda spark, folder: run(Bindings(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return run

    return register

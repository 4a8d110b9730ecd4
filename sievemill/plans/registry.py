"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievemill.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(*tables: str, sql: str | None = None):
    """Register a plan over tables as the query of its name, with the SQL that DuckDB runs for it."""

    def add(plan: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, d: str) -> DataFrame:
            return plan(*[table(spark, d, t) for t in tables])

        QUERIES[plan.__name__] = run
        if sql:
            SQL[plan.__name__] = sql
        return plan

    return add


from sievemill.plans import pipeline, relational, sourcing, texts  # noqa: E402, F401

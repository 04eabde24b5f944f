"""A registry of queries with, where SQL can say it, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name and the SQL of those that SQL can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered already")
            self.queries[name] = f
            if sql:
                self.oracle[name] = sql
            return f

        return add


def table(spark: SparkSession, where: str, name: str) -> DataFrame:
    """One table of a data folder, lazily; columns are pruned by what a query uses."""
    return spark.read.parquet(f"{where}/{name}.parquet")

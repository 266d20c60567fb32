"""Registering queries with the SQL they are compared with."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessel.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        """Register a function of a table loader; ``sql`` gives the same result in SQL."""

        def add(f: Callable) -> Callable:
            self.queries[name] = lambda spark, d: f(Loader(spark, d))
            if sql:
                self.oracles[name] = sql
            return f

        return add


class Loader:
    """Tables of one folder by attribute: t.documents."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

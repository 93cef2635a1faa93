"""Registry of the query catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.tables import table, views


class Tables:
    """Tables of a data directory by attribute: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)


class Catalogue:
    """Queries of one module and the SQL they are compared with."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None) -> Callable:
        """Decorator: registers a function of ``Tables`` as a query."""

        def wrap(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.queries[name] = lambda spark, d: f(Tables(spark, d))
            if oracle is not None:
                self.oracles[name] = oracle
            return f

        return wrap

    def sql(self, name: str, tables: str, text: str, oracle: str | None = None) -> None:
        """Registers a Spark SQL text over the named tables; ``oracle`` where the other engine needs another text."""
        self.queries[name] = lambda spark, d: views(spark, d, *tables.split()).sql(text)
        self.oracles[name] = oracle or text

"""Collecting the queries of one family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablerelay.queries.fixtures import fixture, sql


class Tables:
    """The given tables and the fixtures of one run, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixture(self.spark, self.sf_dir, name)


class Book:
    """``QUERIES`` and ``SQL`` of a family, filled by the decorator."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, check: str | None = None) -> Callable:
        """Register a function of :class:`Tables` under its name, with its SQL."""

        def register(build: Callable[[Tables], DataFrame]) -> Callable:
            self.queries[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
            if check is not None:
                self.sql[build.__name__] = sql(check)
            return build

        return register

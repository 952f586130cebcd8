"""Counts over tables, and listings written as JSON or CSV."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_row_count(df: DataFrame) -> DataFrame:
    """One row holding the number of rows; 0 for an empty table."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def inventory_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row with the row count of each table, in a column named after it."""
    counted = [
        table_row_count(df).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()
    ]
    together = reduce(DataFrame.unionByName, counted)
    return together.agg(
        *[F.sum(F.when(F.col("table_name") == name, F.col("row_count"))).alias(name) for name in tables]
    )


def export_report(df: DataFrame, path: str, fmt: str = "json") -> str:
    """Write a listing as JSON lines or as CSV with a header and quoting."""
    if fmt == "json":
        df.write.option("ignoreNullFields", "false").json(path)
    elif fmt == "csv":
        df.write.option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"reports are written as 'json' or 'csv', not {fmt!r}")
    return path

"""Every operator as a runnable query over the given tables, with an SQL statement to check it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FAMILIES = (
    "reading", "incremental", "merging", "publishing", "snapshots", "history", "tasks",
    "notifications", "health", "scalars", "changes", "streams",
)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for family in FAMILIES:
        found.update(importlib.import_module(f"tablerelay.queries.{family}").QUERIES)
    return found


def all_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for family in FAMILIES:
        found.update(importlib.import_module(f"tablerelay.queries.{family}").SQL)
    return found

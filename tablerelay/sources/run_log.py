"""The JSON-lines run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_LOG_SCHEMA = "ts timestamp_ntz, level string, app string, evt string, msg string, ex string"

# Log levels from least to most severe.
LEVELS = ("Trace", "Debug", "Info", "Warn", "Error", "Fatal")


def level_rank(level: Column) -> Column:
    """Position of a level, case aside; NULL for an unknown one."""
    ranks = [F.when(F.lower(level) == name.lower(), rank) for rank, name in enumerate(LEVELS)]
    return F.coalesce(*ranks)


def at_least(df: DataFrame, minimum: str) -> DataFrame:
    lowered = [name.lower() for name in LEVELS]
    if minimum.lower() not in lowered:
        raise ValueError(f"unknown level {minimum!r}; levels are {', '.join(LEVELS)}")
    return df.where(F.lower("level").isin(lowered[lowered.index(minimum.lower()):]))


def read_run_log(spark: SparkSession, path: str, minimum: str = "Trace") -> DataFrame:
    """Log lines from ``minimum`` level upwards."""
    return at_least(spark.read.schema(RUN_LOG_SCHEMA).json(path), minimum)


def count_events(log: DataFrame) -> DataFrame:
    """Lines per event and level."""
    return log.groupBy("evt", "level").agg(F.count(F.lit(1)).alias("line_count"))

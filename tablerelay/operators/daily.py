"""Figures of runs and tasks kept by day, so that statistics merge days instead of reading rows.

A day's figures are counts, sums and extremes, which add up to those of any span of days. They
are stored in a folder a day: rows that come late make their day anew, and only it. Spans are
of whole days: that of the cutoff counts from its midnight.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablerelay.operators.health import BASELINE_KEYS
from tablerelay.operators.history import count_where
from tablerelay.session import ntz

TASK_STATUSES = ("Completed", "Failed")
RUN_STATUSES = ("Success", "Failed", "Running")
RUN_TOTALS = ("rows_read", "rows_inserted", "rows_updated", "rows_deleted")


def _by_day(rows: DataFrame, stamp: str, keys: Sequence[str], statuses: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """One row per day and keys; rows without a time belong to no day."""
    dated = rows.where(F.col(stamp).isNotNull()).withColumn("day", F.to_date(stamp))
    return dated.groupBy("day", *keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[count_where(F.col("status") == s).alias(f"n_{s.lower()}") for s in statuses],
        F.sum(F.col("duration_ms").cast("bigint")).alias("duration_sum"), F.count("duration_ms").alias("duration_n"),
        F.min("duration_ms").cast("bigint").alias("duration_min"), F.max("duration_ms").cast("bigint").alias("duration_max"),
        *[a for c in totals for a in (F.sum(F.col(c).cast("bigint")).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n"))],
    )


def task_days(tasks: DataFrame, stamp: str = "completed_at") -> DataFrame:
    """Figures of tasks by day, project and task type: of their completion, or of another time."""
    return _by_day(tasks, stamp, BASELINE_KEYS, TASK_STATUSES, ["rows_processed"])


def run_days(history: DataFrame) -> DataFrame:
    """Figures of runs by the day of their start and job."""
    return _by_day(history, "start_time", ["config_id"], RUN_STATUSES, RUN_TOTALS)


def save_days(figures: DataFrame, path: str) -> None:
    """Replace the days that ``figures`` has; others are not touched."""
    placed = figures.repartition("day").sortWithinPartitions("day")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def refresh_days(rows: DataFrame, fresh: DataFrame, path: str, stamp: str, make: Callable[[DataFrame], DataFrame]) -> None:
    """Make anew the days that ``fresh`` rows fall into, from all ``rows`` of those days."""
    days = fresh.select(F.to_date(stamp).alias("_day")).distinct()
    save_days(make(rows.withColumn("_day", F.to_date(stamp)).join(days, "_day", "left_semi").drop("_day")), path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(path)
    return stored.withColumn("day", F.col("day").cast("date"))


def _since(days: DataFrame, as_of: str | dt.datetime, span: int) -> DataFrame:
    return days.where(F.col("day") >= F.to_date(ntz(as_of)) - F.expr(f"INTERVAL '{span}' DAY"))


def _average(name: str) -> Column:
    return F.coalesce(F.sum(f"{name}_sum").cast("double") / F.nullif(F.sum(f"{name}_n"), F.lit(0)), F.lit(0.0))


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("bigint")


def baseline_from_days(days: DataFrame, as_of: str | dt.datetime, span: int = 30) -> DataFrame:
    """The baseline of :func:`tablerelay.operators.health.run_baseline`, from days of completion."""
    return _since(days, as_of, span).groupBy(*BASELINE_KEYS).agg(
        _total("n").alias("total_executions"), _average("duration").alias("avg_duration_ms"),
        _average("rows_processed").alias("avg_rows_processed"), (F.sum("n_completed").cast("double") / F.sum("n")).alias("success_rate"),
        F.coalesce(F.min("duration_min"), F.lit(0)).cast("bigint").alias("min_duration_ms"),
        F.coalesce(F.max("duration_max"), F.lit(0)).cast("bigint").alias("max_duration_ms"),
    )


def stats_from_days(days: DataFrame, as_of: str | dt.datetime, span: int = 30, by_config: bool = False) -> DataFrame:
    """The figures of :func:`tablerelay.operators.history.history_stats`, of all runs or by job."""
    within = _since(days, as_of, span)
    share = F.when(F.sum("n") > 0, F.sum("n_success").cast("double") / F.sum("n") * 100).otherwise(F.lit(0.0))
    figures = [
        _total("n").alias("total_executions"), _total("n_success").alias("success_count"), _total("n_failed").alias("failed_count"),
        _total("n_running").alias("running_count"), _average("duration").alias("avg_duration_ms"),
        *[_total(f"{c}_sum").alias(f"total_{c}") for c in RUN_TOTALS], share.alias("success_rate"),
    ]
    return within.groupBy("config_id").agg(*figures) if by_config else within.agg(*figures)


def success_from_days(days: DataFrame) -> DataFrame:
    """The figures of :func:`tablerelay.operators.tasks.daily_success_rate`, from days of request."""
    return days.groupBy(F.col("day").alias("request_day")).agg(
        _total("n").alias("total_tasks"), _total("n_completed").alias("completed"), _total("n_failed").alias("failed"),
        (F.sum("n_completed").cast("double") / F.sum("n") * 100).alias("success_rate"),
    )

"""Judging runs against the baseline of their project and task type."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerelay.functions import health as rules
from tablerelay.operators.history import count_where
from tablerelay.session import before

BASELINE_KEYS = ["project_id", "task_type"]


def run_baseline(tasks: DataFrame, as_of: str | dt.datetime, days: int = 30) -> DataFrame:
    """Per project and task type: figures over tasks completed within the last ``days``.

    The success rate is a share between 0 and 1.
    """
    recent = tasks.where(F.col("completed_at") >= before(as_of, days=days))
    everything = F.count(F.lit(1))
    return recent.groupBy(*BASELINE_KEYS).agg(
        everything.alias("total_executions"),
        F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_duration_ms"),
        F.coalesce(F.avg("rows_processed"), F.lit(0.0)).alias("avg_rows_processed"),
        (count_where(F.col("status") == "Completed").cast("double") / everything).alias("success_rate"),
        F.coalesce(F.min("duration_ms"), F.lit(0)).cast("bigint").alias("min_duration_ms"),
        F.coalesce(F.max("duration_ms"), F.lit(0)).cast("bigint").alias("max_duration_ms"),
    )


def run_deviation(tasks: DataFrame, baseline: DataFrame) -> DataFrame:
    """Tasks that ran, with their percent deviation from the baseline.

    The baseline has one row per project and task type, best as a written table. It is
    joined without a hint: Spark broadcasts it where its size allows that, and otherwise
    sort-merges and splits hot keys.
    """
    usual = baseline.select(
        *BASELINE_KEYS, "total_executions", "avg_duration_ms", "avg_rows_processed", "success_rate"
    )
    ran = tasks.where(F.col("duration_ms").isNotNull()).join(usual, BASELINE_KEYS, "left")
    filled = ran.withColumns(
        {
            "duration_seconds": F.col("duration_ms") / F.lit(1000.0),
            "avg_duration_seconds": F.coalesce("avg_duration_ms", F.lit(0.0)) / F.lit(1000.0),
            "rows_processed": F.coalesce("rows_processed", F.lit(0)),
            "avg_rows_processed": F.coalesce("avg_rows_processed", F.lit(0.0)),
            "success_rate": F.coalesce("success_rate", F.lit(0.0)),
            "total_executions": F.coalesce("total_executions", F.lit(0)).cast("bigint"),
        }
    )
    return filled.withColumns(
        {
            "duration_deviation": rules.deviation_percent(F.col("duration_seconds"), F.col("avg_duration_seconds")),
            "rows_deviation": rules.deviation_percent(F.col("rows_processed"), F.col("avg_rows_processed")),
        }
    )


def run_health(deviations: DataFrame) -> DataFrame:
    """All verdicts on each run of :func:`run_deviation`."""
    seconds, rows = F.col("duration_seconds"), F.col("rows_processed")
    usual_seconds, usual_rows = F.col("avg_duration_seconds"), F.col("avg_rows_processed")
    slow, more = F.col("duration_deviation"), F.col("rows_deviation")
    return deviations.withColumns(
        {
            "performance_class": rules.performance_class(slow),
            "run_pattern": rules.run_pattern(slow, more),
            "throughput_class": rules.throughput_class(
                rules.throughput(rows, seconds), rules.throughput(usual_rows, usual_seconds)
            ),
            "alert_level": rules.alerts(slow, F.col("success_rate")),
            "run_tip": rules.run_tip(rows, usual_rows, seconds),
            "volume_trend": rules.volume_trend(rows, usual_rows),
            "stability": rules.stability(F.col("success_rate")),
            "duration_remark": rules.duration_remark(slow),
            "growth_alert": rules.growth_alert(more),
        }
    )

"""Run history: one row per execution of a job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerelay.operators.keys import latest_of_group, top_n_per_group
from tablerelay.session import before, ntz


def count_where(condition: Column) -> Column:
    """Rows for which a condition holds; 0 over an empty input."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def total(column: str) -> Column:
    """Sum with NULL as 0; 0 over an empty input."""
    return F.coalesce(F.sum(F.coalesce(F.col(column), F.lit(0))), F.lit(0)).cast("bigint")


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole * 100).otherwise(F.lit(0.0))


def _stats() -> list[Column]:
    everything = F.count(F.lit(1))
    succeeded = count_where(F.col("status") == "Success")
    return [
        everything.alias("total_executions"),
        succeeded.alias("success_count"),
        count_where(F.col("status") == "Failed").alias("failed_count"),
        count_where(F.col("status") == "Running").alias("running_count"),
        F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_duration_ms"),
        total("rows_read").alias("total_rows_read"),
        total("rows_inserted").alias("total_rows_inserted"),
        total("rows_updated").alias("total_rows_updated"),
        total("rows_deleted").alias("total_rows_deleted"),
        _percent(succeeded, everything).alias("success_rate"),
    ]


def history_stats(
    history: DataFrame, as_of: str | dt.datetime, days: int = 30, config_id: object = None
) -> DataFrame:
    """One row of counts, average duration, row totals and success rate (percent)."""
    recent = history.where(F.col("start_time") >= before(as_of, days=days))
    if config_id is not None:
        recent = recent.where(F.col("config_id") == F.lit(config_id))
    return recent.agg(*_stats())


def history_stats_by_config(history: DataFrame, as_of: str | dt.datetime, days: int = 30) -> DataFrame:
    """The same figures for each job."""
    recent = history.where(F.col("start_time") >= before(as_of, days=days))
    return recent.groupBy("config_id").agg(*_stats())


def history_filter(
    history: DataFrame,
    *,
    status: str | None = None,
    start: str | dt.datetime | None = None,
    end: str | dt.datetime | None = None,
    config_id: object = None,
    limit: int | None = None,
) -> DataFrame:
    """Runs by status, period and job, newest first, cut to ``limit`` after filtering.

    The status must match exactly, except with ``config_id``, where case is ignored.
    """
    rows = history
    if config_id is not None:
        rows = rows.where(F.col("config_id") == F.lit(config_id))
    if status is not None:
        exact = F.col("status") == status
        rows = rows.where(exact if config_id is None else F.lower("status") == status.lower())
    if start is not None:
        rows = rows.where(F.col("start_time") >= ntz(start))
    if end is not None:
        rows = rows.where(F.col("start_time") <= ntz(end))
    rows = rows.orderBy(F.col("start_time").desc(), F.col("execution_id").desc())
    return rows if limit is None else rows.limit(limit)


def history_by_id(history: DataFrame, value: object, column: str = "execution_id") -> DataFrame:
    """One run (or task) by its id."""
    return history.where(F.col(column) == F.lit(value))


def history_totals(history: DataFrame) -> DataFrame:
    """The history with rows_processed: inserted, updated and deleted together."""
    parts = [F.coalesce(F.col(c), F.lit(0)) for c in ("rows_inserted", "rows_updated", "rows_deleted")]
    return history.withColumn("rows_processed", parts[0] + parts[1] + parts[2])


def history_grand_total(history: DataFrame) -> DataFrame:
    """One row: the number of runs and all rows they processed."""
    return history_totals(history).agg(
        F.count(F.lit(1)).alias("total_executions"), total("rows_processed").alias("total_rows_processed")
    )


def last_execution(history: DataFrame) -> DataFrame:
    """The latest run of each job."""
    return latest_of_group(history, ["config_id"], ["start_time", "execution_id"])


def recent_per_config(history: DataFrame, n: int = 100) -> DataFrame:
    """The newest ``n`` runs of each job."""
    order = [F.col("start_time").desc(), F.col("execution_id").desc()]
    return top_n_per_group(history, ["config_id"], order, n)


def configs_with_last_run(
    configs: DataFrame, mappings: DataFrame, history: DataFrame, active: bool | None = None
) -> DataFrame:
    """Each job with its number of mappings and its last run, most recently updated first.

    History and mappings are reduced to one row per job before the joins.
    """
    chosen = configs if active is None else configs.where(F.col("is_active") == active)
    counted = mappings.groupBy("config_id").agg(F.count(F.lit(1)).alias("mappings_count"))
    newest = history.groupBy("config_id").agg(
        F.max("start_time").alias("last_execution"),
        F.max_by("status", F.struct("start_time", "execution_id")).alias("last_execution_status"),
    )
    return (
        chosen.join(counted, "config_id", "left")
        .join(newest, "config_id", "left")
        .withColumn("mappings_count", F.coalesce("mappings_count", F.lit(0)).cast("bigint"))
        .orderBy(F.col("updated_at").desc(), F.col("config_id"))
    )


def retention_history(history: DataFrame, as_of: str | dt.datetime, days: int) -> DataFrame:
    """Runs that started within the last ``days``; older ones are dropped."""
    return history.where(F.col("start_time") >= before(as_of, days=days))


def expired_history_count(history: DataFrame, as_of: str | dt.datetime, days: int) -> DataFrame:
    """How many runs :func:`retention_history` drops."""
    return history.agg(count_where(F.col("start_time") < before(as_of, days=days)).alias("deleted_count"))


def record_run(records: DataFrame, key: str = "execution_id", recorded_at: str = "recorded_at") -> DataFrame:
    """Fold appended start and end records into one row per run.

    Each column takes the latest value that was recorded, so an end record may leave
    out what the start record already said.
    """
    columns = [c for c in records.columns if c not in (key, recorded_at)]

    def newest(column: str) -> Column:
        # Ties in time are settled by the value, so the result does not depend on order.
        return F.max(
            F.when(F.col(column).isNotNull(), F.struct(recorded_at, column))
        )[column].alias(column)

    return records.groupBy(key).agg(*[newest(c) for c in columns])


def sync_batch_result(outcomes: DataFrame, groups: Iterable[str], failed: Column) -> DataFrame:
    """Per batch: rows processed and failed, and whether it succeeded, partly or not at all."""
    counted = outcomes.groupBy(*groups).agg(
        count_where(~F.coalesce(failed, F.lit(False))).alias("records_processed"),
        count_where(failed).alias("records_failed"),
    )
    status = (
        F.when(F.col("records_failed") == 0, "Success")
        .when(F.col("records_failed") < F.col("records_processed"), "PartialSuccess")
        .otherwise("Failed")
    )
    return counted.withColumn("status", status)

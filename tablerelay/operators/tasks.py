"""The task queue: waiting lists, statistics and state changes.

Projects are joined without a broadcast hint. Spark compares their size with its
broadcast threshold, at planning or at run time, and beyond it sort-merges and splits
hot projects. Statistics are reduced per project before that join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerelay.functions.labels import status_display
from tablerelay.functions.timing import duration_seconds, minutes_between, seconds_between
from tablerelay.operators.history import count_where, total
from tablerelay.operators.keys import key_set, split_null_keys
from tablerelay.session import before, ntz

# What the queue accepts.
STATUSES = ("Pending", "Running", "Completed", "Failed", "Cancelled")
TASK_TYPES = ("DataSync", "FullRefresh", "IncrementalOnly")
LOWEST_PRIORITY, HIGHEST_PRIORITY = 1, 10

# Messages written by the queue's own clean-up.
STUCK_MESSAGE = "Task stuck in Running state - marked as failed"
CANCELLED_MESSAGE = "Task cancelled automatically due to age (>{hours} hours)"

Instant = str | dt.datetime


def optional_equals(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows matching every argument that is given; an argument of None filters nothing."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def _by_urgency(*more: str) -> list[Column]:
    return [F.col("priority").desc(), F.col("requested_at").asc(), *[F.col(c) for c in more]]


def pending_tasks_view(tasks: DataFrame, projects: DataFrame, as_of: Instant) -> DataFrame:
    """Pending tasks with their project and how long they have waited."""
    named = projects.select("project_id", "project_name", "client_name")
    waited = {"minutes_waiting": minutes_between, "seconds_waiting": seconds_between}
    return (
        tasks.where(F.col("status") == "Pending")
        .join(named, "project_id")
        .withColumns({name: f(F.col("requested_at"), ntz(as_of)) for name, f in waited.items()})
    )


def tasks_projects_ci(tasks: DataFrame, projects: DataFrame) -> DataFrame:
    """Tasks with their project, where project ids are compared without case."""
    named = projects.select(F.lower("project_id").alias("_project"), "project_name", "client_name")
    return tasks.withColumn("_project", F.lower("project_id")).join(named, "_project").drop("_project")


def recent_tasks(tasks: DataFrame, projects: DataFrame, as_of: Instant, hours: int = 24) -> DataFrame:
    """Tasks requested within the last ``hours``, with seconds and label."""
    return (
        tasks.where(F.col("requested_at") >= before(as_of, hours=hours))
        .join(projects.select("project_id", "project_name"), "project_id")
        .withColumn("duration_seconds", duration_seconds(F.col("duration_ms")))
        .withColumn("status_display", status_display(F.col("status")))
    )


def pending_queue(
    tasks: DataFrame, max_tasks: int = 10, project_id: object = None, server_id: object = None
) -> DataFrame:
    """The next tasks to run: highest priority first, then the longest waiting."""
    waiting = optional_equals(
        tasks.where(F.col("status") == "Pending"), project_id=project_id, server_id=server_id
    )
    return waiting.orderBy(*_by_urgency("task_id")).limit(max_tasks)


def active_tasks(tasks: DataFrame, as_of: Instant) -> DataFrame:
    """Pending and running tasks in the order of their urgency."""
    return (
        tasks.where(F.col("status").isin("Pending", "Running"))
        .select(
            "task_id", "project_id", "status", "priority", "requested_by", "requested_at",
            minutes_between(F.col("requested_at"), ntz(as_of)).alias("minutes_waiting"),
        )
        .orderBy(*_by_urgency("task_id"))
    )


def _minutes_running(as_of: Instant) -> Column:
    return minutes_between(F.col("started_at"), ntz(as_of))


def _running_longer(as_of: Instant, minutes: int) -> Column:
    """More than ``minutes`` clock minutes ago: a bound on the bare column, which the scan takes."""
    latest = F.date_trunc("minute", ntz(as_of)).cast("timestamp_ntz") - F.expr(f"INTERVAL '{minutes}' MINUTE")
    return (F.col("status") == "Running") & (F.col("started_at") < latest)


def stuck_running(tasks: DataFrame, as_of: Instant, minutes: int = 30) -> DataFrame:
    """Tasks that have been running for more than ``minutes``."""
    return tasks.where(_running_longer(as_of, minutes)).select(
        "task_id", "project_id", "started_at", _minutes_running(as_of).alias("minutes_running")
    )


def task_validity(tasks: DataFrame) -> DataFrame:
    """Tasks that break a rule of the queue, one row per broken rule. NULL breaks none."""
    broken = F.array_compact(
        F.array(
            F.when(~F.col("status").isin(*STATUSES), "status"),
            F.when(~F.col("task_type").isin(*TASK_TYPES), "task_type"),
            F.when(~F.col("priority").between(LOWEST_PRIORITY, HIGHEST_PRIORITY), "priority"),
        )
    )
    return tasks.select("task_id", F.explode(broken).alias("rule"))


def task_stats_by_project(tasks: DataFrame, projects: DataFrame) -> DataFrame:
    """Figures per project that has tasks."""
    reduced = tasks.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_tasks"),
        *[count_where(F.col("status") == s).alias(f"{s.lower()}_tasks") for s in STATUSES],
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.max("requested_at").alias("last_requested_at"),
        total("rows_processed").alias("total_rows_processed"),
    )
    return reduced.join(projects.select("project_id", "project_name", "client_name"), "project_id")


def task_statistics(
    tasks: DataFrame, as_of: Instant, days: int = 30, project_id: object = None
) -> DataFrame:
    """One row of figures over the tasks requested within the last ``days``."""
    recent = optional_equals(
        tasks.where(F.col("requested_at") >= before(as_of, days=days)), project_id=project_id
    )
    everything, completed = F.count(F.lit(1)), count_where(F.col("status") == "Completed")
    return recent.agg(
        everything.alias("total_tasks"),
        *[count_where(F.col("status") == s).alias(f"{s.lower()}_tasks") for s in STATUSES],
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.min("duration_ms").alias("min_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"),
        *[total(c).alias(f"total_{c}") for c in ("rows_processed", "rows_inserted", "rows_updated", "rows_failed")],
        F.when(everything > 0, completed.cast("double") / everything * 100).otherwise(F.lit(0.0)).alias("success_rate"),
        count_where(F.col("notification_sent")).alias("notifications_sent"),
    )


def tasks_by_status(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count(F.lit(1)).alias("task_count")).orderBy("status")


def queue_depth(tasks: DataFrame) -> DataFrame:
    """Pending tasks and the oldest request per priority, most urgent first."""
    return (
        tasks.where(F.col("status") == "Pending")
        .groupBy("priority")
        .agg(F.count(F.lit(1)).alias("pending_count"), F.min("requested_at").alias("oldest_request"))
        .orderBy(F.col("priority").desc())
    )


def _day_figures() -> list[Column]:
    everything, completed = F.count(F.lit(1)), count_where(F.col("status") == "Completed")
    return [
        everything.alias("total_tasks"),
        completed.alias("completed"),
        count_where(F.col("status") == "Failed").alias("failed"),
        F.when(everything > 0, completed.cast("double") / everything * 100).alias("success_rate"),
    ]


def daily_success_rate(tasks: DataFrame, day: str | dt.date | None = None) -> DataFrame:
    """Share of completed tasks on one day, or on every day."""
    if day is None:
        return tasks.groupBy(F.to_date("requested_at").alias("request_day")).agg(*_day_figures())
    start = ntz(f"{day} 00:00:00")
    within = (F.col("requested_at") >= start) & (F.col("requested_at") < start + F.expr("INTERVAL '1' DAY"))
    return tasks.where(within).agg(*_day_figures())


def _change(tasks: DataFrame, condition: Column, as_of: Instant, **changes: Column) -> DataFrame:
    """Set columns, and updated_at, where a condition holds."""
    hit = F.coalesce(condition, F.lit(False))
    stamped = {**changes, "updated_at": ntz(as_of)}
    return tasks.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in stamped.items()})


def patch_status(tasks: DataFrame, patches: DataFrame, as_of: Instant) -> DataFrame:
    """Tasks after patches by task_id.

    The status is replaced; every other patched column only where the patch has a value.
    Several patches of a task act in the order of their ``patched_at``; without that column,
    or at one time, the greater value of a column wins.
    """
    patched = [c for c in patches.columns if c not in ("task_id", "patched_at")]
    order = [F.col("patched_at")] if "patched_at" in patches.columns else []

    def newest(column: str) -> Column:
        entry = F.struct(*order, F.col(column).alias("value"))
        given = entry if column == "status" else F.when(F.col(column).isNotNull(), entry)
        return F.max(given)["value"].alias(f"_new_{column}")

    renamed = patches.where(F.col("task_id").isNotNull()).groupBy("task_id").agg(
        *[newest(c) for c in patched], F.lit(True).alias("_patched")
    )
    keyed, unkeyed = split_null_keys(tasks, ["task_id"])
    joined = keyed.join(renamed, "task_id", "left")

    def value(column: str) -> Column:
        current, new = F.col(column), F.col(f"_new_{column}")
        if column == "status" and column in patched:
            return F.when(F.col("_patched"), new).otherwise(current)
        if column == "updated_at":
            return F.when(F.col("_patched"), ntz(as_of)).otherwise(current)
        return F.coalesce(new, current) if column in patched else current

    result = joined.select(*[value(c).alias(c) for c in tasks.columns])
    return result if unkeyed is None else result.unionByName(unkeyed)


def _is_stale(as_of: Instant, hours: int) -> Column:
    return (F.col("status") == "Pending") & (F.col("requested_at") < before(as_of, hours=hours))


def cancel_stale(tasks: DataFrame, as_of: Instant, hours: int = 24) -> DataFrame:
    """Cancel tasks that have been pending for more than ``hours``."""
    message = F.lit(CANCELLED_MESSAGE.format(hours=hours))
    return _change(tasks, _is_stale(as_of, hours), as_of, status=F.lit("Cancelled"), error_message=message)


def stale_count(tasks: DataFrame, as_of: Instant, hours: int = 24) -> DataFrame:
    """How many tasks :func:`cancel_stale` cancels."""
    return tasks.agg(count_where(_is_stale(as_of, hours)).alias("tasks_cancelled"))


def fail_stuck(tasks: DataFrame, as_of: Instant, minutes: int = 60) -> DataFrame:
    """Fail tasks that have been running for more than ``minutes``."""
    return _change(
        tasks, _running_longer(as_of, minutes), as_of, status=F.lit("Failed"), error_message=F.lit(STUCK_MESSAGE)
    )


def age_priority(tasks: DataFrame, as_of: Instant, hours: int = 2, step: int = 2) -> DataFrame:
    """Raise the priority of tasks pending for long, up to the highest allowed."""
    current, kind = F.col("priority"), tasks.schema["priority"].dataType
    raised = F.least(current + F.lit(step), F.lit(HIGHEST_PRIORITY))
    changed = F.when(current < HIGHEST_PRIORITY, raised).otherwise(current).cast(kind)
    return _change(tasks, _is_stale(as_of, hours), as_of, priority=changed)


def mark_notified(tasks: DataFrame, notified: DataFrame, as_of: Instant) -> DataFrame:
    """Mark the tasks in ``notified`` (task_id) as notified."""
    marks = key_set(notified, ["task_id"]).distinct().withColumn("_marked", F.lit(True))
    keyed, unkeyed = split_null_keys(tasks, ["task_id"])
    marked = _change(
        keyed.join(marks, "task_id", "left"),
        F.col("_marked"), as_of,
        notification_sent=F.lit(True), notification_sent_at=ntz(as_of),
    ).select(*tasks.columns)
    return marked if unkeyed is None else marked.unionByName(unkeyed)


def tasks_to_notify(tasks: DataFrame, projects: DataFrame, max_tasks: int = 10) -> DataFrame:
    """Finished tasks whose notification is due, the longest finished first."""
    due = tasks.where(
        F.col("notify_on_complete")
        & ~F.col("notification_sent")
        & F.col("status").isin("Completed", "Failed")
        & F.col("notification_email").isNotNull()
    )
    named = due.join(projects.select("project_id", "project_name"), "project_id")
    return named.orderBy(F.col("completed_at").asc_nulls_first(), F.col("task_id")).limit(max_tasks)


def retention_tasks(tasks: DataFrame, as_of: Instant, days: int = 90) -> DataFrame:
    """Tasks without those completed or cancelled more than ``days`` ago."""
    old = F.col("status").isin("Completed", "Cancelled") & (F.col("completed_at") < before(as_of, days=days))
    return tasks.where(~F.coalesce(old, F.lit(False)))


def active_config(configs: DataFrame, enabled: str = "is_enabled", key: str = "config_id") -> DataFrame:
    """The enabled configuration with the highest id."""
    return configs.where(F.col(enabled)).orderBy(F.col(key).desc()).limit(1)



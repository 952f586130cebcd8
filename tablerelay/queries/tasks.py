"""The task queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablerelay.operators import daily, tasks
from tablerelay.queries.book import Book
from tablerelay.queries.fixtures import AS_OF, STATUS_LABEL
from tablerelay.session import shared_folder

book = Book()
QUERIES, SQL = book.queries, book.sql

_NOW = f"TIMESTAMP '{AS_OF}'"
_WAITED = f"CAST(date_diff('minute', requested_at, {_NOW}) AS BIGINT)"
_COUNTS = ", ".join(f"CAST(count_if(status = '{s}') AS BIGINT) AS {s.lower()}_tasks" for s in tasks.STATUSES)


@book.query("SELECT * FROM {tasks} WHERE project_id = 3")
def optional_equals(t):
    return tasks.optional_equals(t.tasks, project_id=3, server_id=None)


@book.query(f"""
    SELECT t.*, p.project_name, p.client_name, {_WAITED} AS minutes_waiting,
           CAST(date_diff('second', requested_at, {_NOW}) AS BIGINT) AS seconds_waiting
    FROM {{tasks}} t JOIN {{projects}} p ON p.project_id = t.project_id WHERE status = 'Pending'""")
def pending_tasks_view(t):
    return tasks.pending_tasks_view(t.tasks, t.projects, AS_OF)


@book.query("""
    SELECT c_custkey AS task_id, n_name AS project_id, n_name AS project_name, r_name AS client_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def tasks_projects_ci(t):
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    queue = named.select(F.col("c_custkey").alias("task_id"), F.col("n_name").alias("project_id"))
    lower = t.projects.select(F.lower("project_name").alias("project_id"), "project_name", "client_name")
    return tasks.tasks_projects_ci(queue, lower)


@book.query(f"""
    SELECT t.*, p.project_name, CAST((duration_ms + 5) // 10 * CAST(0.01 AS DECIMAL(3, 2)) AS DECIMAL(10, 2)) AS duration_seconds, {STATUS_LABEL} AS status_display
    FROM {{tasks}} t JOIN {{projects}} p ON p.project_id = t.project_id WHERE requested_at >= TIMESTAMP '2024-01-30 00:00:00'""")
def recent_tasks(t):
    return tasks.recent_tasks(t.tasks, t.projects, AS_OF)


@book.query(f"""
    SELECT task_id, project_id, started_at, CAST(date_diff('minute', started_at, {_NOW}) AS BIGINT) AS minutes_running
    FROM {{tasks}} WHERE status = 'Running' AND date_diff('minute', started_at, {_NOW}) > 30""")
def stuck_running(t):
    return tasks.stuck_running(t.tasks, AS_OF)


@book.query("""
    SELECT task_id, 'status' AS rule FROM {unchecked_tasks} WHERE status NOT IN ('Pending', 'Running', 'Completed', 'Failed', 'Cancelled')
    UNION ALL SELECT task_id, 'task_type' FROM {unchecked_tasks} WHERE task_type NOT IN ('DataSync', 'FullRefresh', 'IncrementalOnly')
    UNION ALL SELECT task_id, 'priority' FROM {unchecked_tasks} WHERE priority NOT BETWEEN 1 AND 10""")
def task_validity(t):
    return tasks.task_validity(t.unchecked_tasks)


@book.query(f"""
    SELECT t.project_id, p.project_name, p.client_name, t.* EXCLUDE (project_id) FROM (
        SELECT project_id, CAST(count(*) AS BIGINT) AS total_tasks, {_COUNTS}, round(avg(duration_ms), 4) AS avg_duration_ms,
               max(requested_at) AS last_requested_at, CAST(coalesce(sum(rows_processed), 0) AS BIGINT) AS total_rows_processed
        FROM {{tasks}} GROUP BY project_id) t JOIN {{projects}} p ON p.project_id = t.project_id""")
def task_stats_by_project(t):
    return tasks.task_stats_by_project(t.tasks, t.projects).withColumn("avg_duration_ms", F.round("avg_duration_ms", 4))


@book.query(f"""
    SELECT CAST(count(*) AS BIGINT) AS total_tasks, {_COUNTS}, round(avg(duration_ms), 4) AS avg_duration_ms,
           min(duration_ms) AS min_duration_ms, max(duration_ms) AS max_duration_ms,
           CAST(coalesce(sum(rows_processed), 0) AS BIGINT) AS total_rows_processed, CAST(coalesce(sum(rows_inserted), 0) AS BIGINT) AS total_rows_inserted,
           CAST(coalesce(sum(rows_updated), 0) AS BIGINT) AS total_rows_updated, CAST(coalesce(sum(rows_failed), 0) AS BIGINT) AS total_rows_failed,
           round(CAST(count_if(status = 'Completed') AS DOUBLE) / count(*) * 100, 6) AS success_rate,
           CAST(count_if(notification_sent) AS BIGINT) AS notifications_sent
    FROM {{tasks}} WHERE requested_at >= TIMESTAMP '2024-01-16 00:00:00'""")
def task_statistics(t):
    figures = tasks.task_statistics(t.tasks, AS_OF, days=15)
    return figures.withColumns(
        {"avg_duration_ms": F.round("avg_duration_ms", 4), "success_rate": F.round("success_rate", 6)}
    )


@book.query("SELECT status, CAST(count(*) AS BIGINT) AS task_count FROM {tasks} GROUP BY status")
def tasks_by_status(t):
    return tasks.tasks_by_status(t.tasks)


@book.query("""
    SELECT priority, CAST(count(*) AS BIGINT) AS pending_count, min(requested_at) AS oldest_request
    FROM {tasks} WHERE status = 'Pending' GROUP BY priority""")
def queue_depth(t):
    return tasks.queue_depth(t.tasks)


_DAY = """CAST(count(*) AS BIGINT) AS total_tasks, CAST(count_if(status = 'Completed') AS BIGINT) AS completed,
    CAST(count_if(status = 'Failed') AS BIGINT) AS failed,
    round(CAST(count_if(status = 'Completed') AS DOUBLE) / count(*) * 100, 6) AS success_rate"""


@book.query(f"SELECT {_DAY} FROM {{tasks}} WHERE CAST(requested_at AS DATE) = DATE '2024-01-30'")
def daily_success_rate(t):
    return tasks.daily_success_rate(t.tasks, "2024-01-30").withColumn("success_rate", F.round("success_rate", 6))


@book.query(f"SELECT CAST(requested_at AS DATE) AS request_day, {_DAY} FROM {{tasks}} GROUP BY 1")
def daily_success_rates(t):
    return tasks.daily_success_rate(t.tasks).withColumn("success_rate", F.round("success_rate", 6))


@book.query(f"SELECT CAST(requested_at AS DATE) AS request_day, {_DAY} FROM {{tasks}} GROUP BY 1")
def daily_success_rates_from_days(t):
    """The same from stored days of request."""
    path = shared_folder(t.spark, "request-days")
    daily.save_days(daily.task_days(t.tasks, "requested_at"), path)
    return daily.success_from_days(daily.read_days(t.spark, path)).withColumn("success_rate", F.round("success_rate", 6))


@book.query("SELECT * FROM {tasks} WHERE status = 'Pending' ORDER BY priority DESC, requested_at, task_id LIMIT 10")
def pending_queue(t):
    return tasks.pending_queue(t.tasks)


@book.query(f"""
    SELECT task_id, project_id, status, priority, requested_by, requested_at, {_WAITED} AS minutes_waiting
    FROM {{tasks}} WHERE status IN ('Pending', 'Running')""")
def active_tasks(t):
    return tasks.active_tasks(t.tasks, AS_OF)


@book.query("""
    SELECT t.*, p.project_name FROM {tasks} t JOIN {projects} p ON p.project_id = t.project_id
    WHERE notify_on_complete AND NOT notification_sent AND status IN ('Completed', 'Failed') AND notification_email IS NOT NULL
    ORDER BY completed_at NULLS FIRST, task_id LIMIT 10""")
def tasks_to_notify(t):
    return tasks.tasks_to_notify(t.tasks, t.projects)


@book.query("SELECT * FROM {configs} WHERE is_active ORDER BY config_id DESC LIMIT 1")
def active_config(t):
    return tasks.active_config(t.configs, enabled="is_active")


@book.query(f"""
    SELECT task_id, project_id, CASE WHEN status = 'Running' THEN 'Completed' ELSE status END AS status, priority, started_at,
           CASE WHEN status = 'Running' THEN priority * 1000 ELSE duration_ms END AS duration_ms,
           error_message, CASE WHEN status = 'Running' THEN {_NOW} ELSE updated_at END AS updated_at
    FROM {{tasks}}""")
def patch_status(t):
    columns = ["task_id", "project_id", "status", "priority", "started_at", "duration_ms", "error_message", "updated_at"]
    patches = t.tasks.where("status = 'Running'").select(
        "task_id", F.lit("Completed").alias("status"), (F.col("priority") * 1000).alias("duration_ms"),
        F.lit(None).cast("timestamp_ntz").alias("started_at"), F.lit(None).cast("string").alias("error_message"),
    )
    return tasks.patch_status(t.tasks.select(*columns), patches, AS_OF)


@book.query(SQL["patch_status"])
def patch_status_repeated(t):
    """Two patches of each task: the later one's values count, the earlier one's where it has none."""
    columns = ["task_id", "project_id", "status", "priority", "started_at", "duration_ms", "error_message", "updated_at"]
    running = t.tasks.where("status = 'Running'")

    def patch(day: int, status: str, duration):
        return running.select(
            "task_id", F.lit(status).alias("status"), duration.cast("bigint").alias("duration_ms"), F.lit(f"2024-01-0{day}").alias("patched_at"),
        )

    patches = patch(1, "Failed", F.col("priority") * 1000).unionByName(patch(2, "Completed", F.lit(None)))
    return tasks.patch_status(t.tasks.select(*columns), patches, AS_OF)


def _changed(condition: str, **values: str) -> str:
    columns = {**values, "updated_at": _NOW}
    parts = ", ".join(f"CASE WHEN {condition} THEN {v} ELSE {c} END AS {c}" for c, v in columns.items())
    return f"SELECT * REPLACE ({parts}) FROM {{tasks}}"


_STALE = "status = 'Pending' AND requested_at < TIMESTAMP '2024-01-30 00:00:00'"


@book.query(_changed(
    _STALE, status="'Cancelled'", error_message="'Task cancelled automatically due to age (>24 hours)'"))
def cancel_stale(t):
    return tasks.cancel_stale(t.tasks, AS_OF, 24)


@book.query(f"SELECT CAST(count_if({_STALE}) AS BIGINT) AS tasks_cancelled FROM {{tasks}}")
def cancel_stale_count(t):
    return tasks.stale_count(t.tasks, AS_OF, 24)


@book.query(_changed(
    f"status = 'Running' AND date_diff('minute', started_at, {_NOW}) > 60",
    status="'Failed'", error_message="'Task stuck in Running state - marked as failed'"))
def fail_stuck(t):
    return tasks.fail_stuck(t.tasks, AS_OF)


@book.query(_changed(
    "status = 'Pending' AND requested_at < TIMESTAMP '2024-01-30 22:00:00'",
    priority="CASE WHEN priority < 10 THEN least(priority + 2, 10) ELSE priority END"))
def age_priority(t):
    return tasks.age_priority(t.tasks, AS_OF)


@book.query(_changed("status = 'Completed'", notification_sent="TRUE", notification_sent_at=_NOW))
def mark_notified(t):
    return tasks.mark_notified(t.tasks, t.tasks.where("status = 'Completed'").select("task_id"), AS_OF)


@book.query("""
    SELECT * FROM {tasks} WHERE NOT coalesce(status IN ('Completed', 'Cancelled') AND completed_at < TIMESTAMP '2024-01-21 00:00:00', FALSE)""")
def retention_tasks(t):
    return tasks.retention_tasks(t.tasks, AS_OF, 10)

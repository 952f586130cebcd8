"""Job data derived from the given tables.

Each fixture is one SELECT that reads the same in Spark and in other engines. Every one
is derived from all rows of its tables. ``{name}`` stands for a table or another fixture
and ``{ts}`` for the engine's zone-free timestamp type.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"

# How the status of a task is shown, as SQL.
STATUS_LABEL = """CASE status WHEN 'Completed' THEN '✓ Completado' WHEN 'Failed' THEN '✗ Fallido' WHEN 'Running' THEN '▶ En Ejecución'
    WHEN 'Pending' THEN '⏳ Pendiente' WHEN 'Cancelled' THEN '⊗ Cancelado' ELSE status END"""

FIXTURES = {
    # An outdated copy of orders: the newest orders have not arrived yet (rows that only
    # the copy knows stand in their place), and pending orders have another price. The
    # coalesce states that a primary key is never NULL.
    "stale_orders": """
        SELECT coalesce(CASE WHEN o_orderdate >= {ts} '2001-01-01 00:00:00' THEN -1 - o_orderkey ELSE o_orderkey END, 0) AS o_orderkey,
               o_custkey, o_orderstatus,
               CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice,
               o_orderdate, o_orderpriority
        FROM {orders}""",
    # Orders with a binary row version.
    "versioned_orders": """
        SELECT o_orderkey, o_custkey, o_totalprice,
               unhex(lpad(hex(o_orderkey), 16, '0')) AS row_version
        FROM {orders}""",
    # Orders where some have no modification time.
    "partly_tracked_orders": """
        SELECT o_orderkey, o_custkey,
               CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS changed_at
        FROM {orders}""",
    # Orders as text columns that may not fit the target's types.
    "raw_orders": """
        SELECT CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN NULL ELSE o_orderkey END AS order_key,
               CASE WHEN o_orderstatus = 'F' THEN concat('C-', CAST(o_custkey AS VARCHAR(20)))
                    ELSE CAST(o_custkey AS VARCHAR(20)) END AS customer_text,
               CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS changed_at
        FROM {orders}""",
    "history": """
        SELECT event_id AS execution_id, user_id AS config_id, ts AS start_time,
               CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END AS duration_ms,
               CASE event_type WHEN 'error' THEN 'Failed' WHEN 'signup' THEN 'Running'
                               WHEN 'view' THEN 'Cancelled' ELSE 'Success' END AS status,
               (event_id * 37) % 5000 AS rows_read, (event_id * 31) % 4000 AS rows_inserted,
               (event_id * 7) % 500 AS rows_updated, event_id % 50 AS rows_deleted
        FROM {events}""",
    "tasks": """
        SELECT event_id AS task_id, user_id % 25 AS project_id,
               CASE WHEN user_id % 7 = 0 THEN NULL ELSE concat('srv', CAST(user_id % 7 AS VARCHAR(20))) END AS server_id,
               user_id AS config_id, event_id % 10 + 1 AS priority,
               CASE event_type WHEN 'click' THEN 'Completed' WHEN 'error' THEN 'Failed' WHEN 'purchase' THEN 'Running'
                               WHEN 'signup' THEN 'Pending' ELSE 'Cancelled' END AS status,
               CASE event_id % 3 WHEN 0 THEN 'DataSync' WHEN 1 THEN 'FullRefresh' ELSE 'IncrementalOnly' END AS task_type,
               concat('user', CAST(user_id AS VARCHAR(20))) AS requested_by,
               ts AS requested_at,
               CASE WHEN event_type IN ('click', 'error', 'purchase') THEN ts END AS started_at,
               CASE WHEN event_type IN ('click', 'error')
                    THEN ts + CAST(round(value) AS BIGINT) * INTERVAL '1' SECOND END AS completed_at,
               CASE WHEN event_type IN ('click', 'error') THEN CAST(round(value) AS BIGINT) * 1000 END AS duration_ms,
               CASE WHEN event_type = 'click' THEN (event_id * 37) % 5000 END AS rows_processed,
               CASE WHEN event_type = 'click' THEN (event_id * 31) % 4000 END AS rows_inserted,
               CASE WHEN event_type = 'click' THEN (event_id * 7) % 500 END AS rows_updated,
               CASE WHEN event_type = 'error' THEN event_id % 50 END AS rows_failed,
               CASE WHEN event_type = 'error' THEN concat('failed on ', props) END AS error_message,
               event_id % 2 = 0 AS notify_on_complete,
               CASE WHEN event_id % 11 = 0 THEN NULL
                    ELSE concat('a', CAST(user_id AS VARCHAR(20)), '@x; b', CAST(event_id AS VARCHAR(20)), '@y,') END AS notification_email,
               event_id % 5 = 0 AS notification_sent,
               CASE WHEN event_id % 5 = 0 THEN ts END AS notification_sent_at,
               ts AS updated_at
        FROM {events}""",
    "projects": """
        SELECT CAST(n_nationkey AS BIGINT) AS project_id, n_name AS project_name, r_name AS client_name
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    # A task queue where some values break the queue's rules.
    "unchecked_tasks": """
        SELECT event_id AS task_id, CASE event_type WHEN 'view' THEN 'Paused' ELSE 'Pending' END AS status,
               CASE event_type WHEN 'click' THEN 'Import' ELSE 'DataSync' END AS task_type,
               event_id % 12 AS priority
        FROM {events}""",
    # Configurations, from customers; orders give them column mappings.
    "configs": """
        SELECT c_custkey AS config_id, c_name AS config_display_name, c_acctbal >= 0 AS is_active,
               {ts} '2024-01-01 00:00:00' + c_custkey * INTERVAL '1' MINUTE AS updated_at
        FROM {customer}""",
    "mappings": """
        SELECT o_custkey AS config_id, o_orderpriority AS source_column, o_orderstatus AS dest_column
        FROM {orders}""",
    # Tracking states: each task leaves one for its job.
    "states": """
        SELECT concat('job', CAST(user_id AS VARCHAR(20))) AS job_identifier, ts AS last_sync_time,
               event_id AS rows_processed, event_id % 7 AS rows_inserted, event_id % 5 AS rows_updated,
               event_id % 3 AS rows_deleted, event_type <> 'error' AS success,
               CASE WHEN event_type = 'error' THEN props END AS error_message,
               ts AS created_at, ts AS updated_at
        FROM {events}""",
    "email_log": """
        SELECT task_id AS email_log_id, task_id, project_id, server_id,
               concat('["', requested_by, '@x"]') AS recipients,
               CASE WHEN task_id % 9 = 0 THEN 'Failed' WHEN task_id % 9 = 1 THEN 'Retrying'
                    WHEN task_id % 9 = 2 THEN 'Queued' ELSE 'Success' END AS status,
               requested_at AS created_at,
               CASE WHEN task_id % 9 >= 3 THEN requested_at END AS sent_at
        FROM {tasks}""",
    "feed": """
        SELECT user_id AS pk, event_id AS version,
               CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'I' ELSE 'U' END AS op, value
        FROM {events}""",
    # The table a feed is applied to: one row per customer.
    "feed_target": """
        SELECT c_custkey AS pk, c_acctbal AS value FROM {customer}""",
    # Runs a central history already holds, and what machines send: everything, and what
    # failed a second time.
    "central_history": """
        SELECT execution_id, CAST(config_id % 5 AS BIGINT) AS project_id,
               CAST(config_id % 3 AS BIGINT) AS server_id, config_id,
               CAST(NULL AS VARCHAR(50)) AS config_display_name, start_time, duration_ms, status,
               {ts} '2024-01-20 00:00:00' AS synced_at, 'agent' AS triggered_by
        FROM {history} WHERE start_time < {ts} '2024-01-20 00:00:00'""",
    "history_feed": """
        SELECT execution_id, CAST(config_id % 5 AS BIGINT) AS project_id,
               CAST(config_id % 3 AS BIGINT) AS server_id, config_id, start_time, duration_ms, status
        FROM {history}
        UNION ALL
        SELECT execution_id, CAST(config_id % 5 AS BIGINT) AS project_id,
               CAST(config_id % 3 AS BIGINT) AS server_id, config_id, start_time, duration_ms, status
        FROM {history} WHERE status = 'Failed'""",
    # Servers known so far, from suppliers; events are their heartbeats.
    "servers": """
        SELECT concat('srv', CAST(s_suppkey AS VARCHAR(20))) AS server_id, CAST(s_suppkey % 25 AS BIGINT) AS project_id,
               s_name AS server_name, {ts} '2023-12-01 00:00:00' AS last_heartbeat, FALSE AS is_online
        FROM {supplier}""",
    "beats": """
        SELECT concat('srv', CAST(user_id AS VARCHAR(20))) AS server_id, user_id % 25 AS project_id, ts AS beat_at
        FROM {events}""",
    # Job definitions as text: one query per document, some without an object.
    "job_queries": """
        SELECT doc_id, concat('SELECT a, b From [dbo].[', source, '_', lang, '] WHERE n > ', CAST(n_chars AS VARCHAR(20))) AS query_text,
               source AS source_server, lang AS source_database
        FROM {documents}""",
    # Run log lines.
    "log_lines": """
        SELECT ts, CASE event_type WHEN 'error' THEN 'Error' WHEN 'view' THEN 'Debug' WHEN 'click' THEN 'Info'
                                   WHEN 'signup' THEN 'Trace' ELSE 'Warn' END AS level,
               'relay' AS app, concat('run.', event_type) AS evt, props AS msg,
               CASE WHEN event_type = 'error' THEN 'Timeout' END AS ex
        FROM {events}""",
    # Snapshots of orders: as stored from the outdated copy, and as it is now.
    "priced_orders": """
        SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18, 2)) AS o_totalprice, o_orderdate
        FROM {orders}""",
    "priced_stale_orders": """
        SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18, 2)) AS o_totalprice, o_orderdate
        FROM {stale_orders}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a fixture as a DataFrame."""
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = FIXTURES[name].replace("{ts}", "TIMESTAMP_NTZ")
    return spark.sql(text, **{n: fixture(spark, sf_dir, n) for n in sorted(set(_NAME.findall(text)))})


def sql(text: str) -> str:
    """SQL for another engine: fixtures become subqueries."""
    def expand(match: re.Match) -> str:
        name = match.group(1)
        if name == "ts":
            return "TIMESTAMP"
        return f"({sql(FIXTURES[name])})" if name in FIXTURES else name

    return _NAME.sub(expand, text)

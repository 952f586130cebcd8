"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablerelay.functions import identity, labels, recipients, timing
from tablerelay.queries.book import Book
from tablerelay.queries.fixtures import AS_OF, STATUS_LABEL
from tablerelay.session import ntz

book = Book()
QUERIES, SQL = book.queries, book.sql


@book.query("SELECT execution_id, CAST((duration_ms + 5) // 10 * CAST(0.01 AS DECIMAL(3, 2)) AS DECIMAL(10, 2)) AS duration_seconds FROM {history}")
def duration_seconds(t):
    return t.history.select("execution_id", timing.duration_seconds(F.col("duration_ms")).alias("duration_seconds"))


@book.query(f"SELECT task_id, {STATUS_LABEL} AS status_display FROM {{unchecked_tasks}}")
def status_display(t):
    return t.unchecked_tasks.select("task_id", labels.status_display(F.col("status")).alias("status_display"))


@book.query(f"""
    SELECT event_id, CAST(date_diff('minute', ts, TIMESTAMP '{AS_OF}') AS BIGINT) AS minutes_waiting,
           CAST(date_diff('second', ts, TIMESTAMP '{AS_OF}') AS BIGINT) AS seconds_waiting FROM events""")
def waiting_time(t):
    now = ntz(AS_OF)
    return t.events.select(
        "event_id",
        timing.minutes_between(F.col("ts"), now).alias("minutes_waiting"),
        timing.seconds_between(F.col("ts"), now).alias("seconds_waiting"),
    )


# Milliseconds from under a second to more than a day.
_MS = "CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(round(value * value * value * 20) AS BIGINT) END"
_H, _M, _S = "ms // 3600000", "ms // 60000 % 60", "ms // 1000 % 60"


@book.query(f"""
    SELECT event_id,
           CASE WHEN ms >= 3600000 THEN concat({_H}, 'h ', {_M}, 'm') WHEN ms >= 60000 THEN concat({_M}, 'm ', {_S}, 's')
                WHEN ms >= 1000 THEN concat({_S}, 's') WHEN ms IS NOT NULL THEN concat(ms, 'ms') END AS short_text,
           CASE WHEN ms IS NULL THEN '-' WHEN ms >= 3600000 THEN concat({_H}, 'h ', {_M}, 'm ', {_S}, 's')
                WHEN ms >= 60000 THEN concat({_M}, 'm ', {_S}, 's') ELSE concat({_S}, 's') END AS long_text,
           CASE WHEN ms IS NULL THEN '-' WHEN ms >= 3600000 THEN concat({_H} % 24, 'h ', {_M}, 'm ', {_S}, 's')
                WHEN ms >= 60000 THEN concat({_M}, 'm ', {_S}, 's') ELSE concat({_S}, 's') END AS wrapped_text
    FROM (SELECT event_id, {_MS} AS ms FROM events) e""")
def format_duration(t):
    value = F.col("value")
    ms = F.when(F.col("event_type") != "signup", F.round(value * value * value * 20).cast("bigint"))
    return t.events.select("event_id", ms.alias("ms")).select(
        "event_id",
        timing.format_duration(F.col("ms")).alias("short_text"),
        timing.format_duration_long(F.col("ms")).alias("long_text"),
        timing.format_duration_long(F.col("ms"), wrap_days=True).alias("wrapped_text"),
    )


@book.query("""
    SELECT doc_id, concat(source, '_', lang, '_dbo_', source, '_', lang, '_TO_target_db_dbo_copy_', source) AS job_identifier
    FROM documents""")
def job_identifier(t):
    return t.job_queries.select(
        "doc_id",
        identity.job_identifier(
            F.col("source_server"), F.col("source_database"),
            identity.source_object_name(F.col("query_text")),
            F.lit("target"), F.lit("db"), F.concat(F.lit("[dbo].[copy_"), "source_server", F.lit("]")),
        ).alias("job_identifier"),
    )


@book.query("""
    SELECT task_id, unnest(list_filter(list_transform(string_split_regex(notification_email, '[,;]'), lambda x: trim(x)), lambda x: x <> '')) AS recipient
    FROM {tasks}""")
def recipients_rows(t):
    return t.tasks.select(
        "task_id", F.explode(recipients.parse_recipients(F.col("notification_email"))).alias("recipient")
    )


QUERIES["recipients"] = QUERIES.pop("recipients_rows")
SQL["recipients"] = SQL.pop("recipients_rows")


@book.query("""
    SELECT email_log_id, concat('user', t.config_id, '@x') AS recipient
    FROM {email_log} e JOIN {tasks} t ON t.task_id = e.task_id WHERE e.status <> 'Queued'""")
def recipients_json(t):
    stored = F.when(F.col("status") == "Queued", "not a list").otherwise(F.col("recipients"))
    return t.email_log.select("email_log_id", F.explode(recipients.parse_recipients_json(stored)).alias("recipient"))


@book.query("SELECT o_orderkey, concat('0x', hex(row_version)) AS version_hex FROM {versioned_orders}")
def rowversion_hex(t):
    return t.versioned_orders.select("o_orderkey", identity.rowversion_hex(F.col("row_version")).alias("version_hex"))

"""The notification log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablerelay.operators import notifications
from tablerelay.queries.book import Book
from tablerelay.queries.fixtures import AS_OF
from tablerelay.session import ntz

book = Book()
QUERIES, SQL = book.queries, book.sql

_LABEL = """CASE status WHEN 'Success' THEN 'Enviado' WHEN 'Failed' THEN 'Fallido' WHEN 'Retrying' THEN 'Reintentando'
    ELSE status END"""


@book.query(f"""
    SELECT *, {_LABEL} AS status_display, CAST(date_diff('minute', created_at, TIMESTAMP '{AS_OF}') AS BIGINT) AS minutes_ago
    FROM {{email_log}} WHERE created_at >= TIMESTAMP '2024-01-21 00:00:00'""")
def recent_emails(t):
    return notifications.recent_emails(t.email_log, AS_OF, days=10)


@book.query("SELECT * FROM {email_log} ORDER BY created_at DESC, email_log_id DESC LIMIT 10")
def notification_log(t):
    return notifications.notification_log(t.email_log)


@book.query("SELECT * FROM {email_log} WHERE status = 'Failed' ORDER BY created_at DESC, email_log_id DESC LIMIT 20")
def notification_log_failed(t):
    return notifications.notification_log(t.email_log, 20, failed_only=True)


@book.query("""
    SELECT status, CAST(count(*) AS BIGINT) AS total, min(created_at) AS first_at, max(created_at) AS last_at
    FROM {email_log} GROUP BY status""")
def notifications_by_status(t):
    return notifications.notifications_by_status(t.email_log)


@book.query("""
    SELECT project_id, CAST(count(*) AS BIGINT) AS total_emails, CAST(count_if(status = 'Success') AS BIGINT) AS succeeded,
           CAST(count_if(status = 'Failed') AS BIGINT) AS failed, max(sent_at) AS last_sent
    FROM {email_log} GROUP BY project_id""")
def notifications_by_project(t):
    return notifications.notifications_by_project(t.email_log)



@book.query(f"""
    SELECT task_id, project_id, server_id, recipients, 'imported' AS subject, status, CAST(1 AS BIGINT) AS recipient_count, sent_at, created_at
    FROM {{email_log}}
    UNION ALL
    SELECT task_id, project_id, server_id,
           concat('["a', config_id, '@x","b', task_id, '@y"]'),
           concat(CASE WHEN status = 'Completed' THEN '✅ Sincronización completada: ' ELSE '❌ Error en sincronización: ' END, project_id),
           CASE WHEN NOT notification_sent THEN 'Success' ELSE 'Failed' END, CAST(2 AS BIGINT),
           CASE WHEN NOT notification_sent THEN TIMESTAMP '{AS_OF}' END, TIMESTAMP '{AS_OF}'
    FROM {{tasks}} WHERE status IN ('Completed', 'Failed') AND notify_on_complete AND notification_email IS NOT NULL""")
def append_notifications(t):
    log = t.email_log.select(
        "task_id", "project_id", "server_id", "recipients", F.lit("imported").alias("subject"), "status",
        F.lit(1).cast("bigint").alias("recipient_count"), "sent_at", "created_at",
    )
    outcomes = notifications.notification_outcomes(t.tasks, ~F.col("notification_sent"), ntz(AS_OF))
    return notifications.append_notifications(log, outcomes)

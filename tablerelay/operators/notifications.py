"""The notification log: what was sent about finished tasks, and to whom."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerelay.functions.labels import notification_display
from tablerelay.functions.recipients import parse_recipients, recipients_json
from tablerelay.functions.timing import minutes_between
from tablerelay.operators.history import count_where
from tablerelay.operators.mapping import insert_by_name
from tablerelay.session import before, ntz

# Subjects of the two kinds of notification.
COMPLETED_SUBJECT = "✅ Sincronización completada: "
FAILED_SUBJECT = "❌ Error en sincronización: "


def recent_emails(log: DataFrame, as_of: str | dt.datetime, days: int = 30) -> DataFrame:
    """Notifications of the last ``days`` with label and age."""
    return log.where(F.col("created_at") >= before(as_of, days=days)).withColumns(
        {
            "status_display": notification_display(F.col("status")),
            "minutes_ago": minutes_between(F.col("created_at"), ntz(as_of)),
        }
    )


def notification_log(log: DataFrame, limit: int = 10, failed_only: bool = False) -> DataFrame:
    """The newest notifications, or the newest failed ones."""
    rows = log.where(F.col("status") == "Failed") if failed_only else log
    return rows.orderBy(F.col("created_at").desc(), F.col("email_log_id").desc()).limit(limit)


def notifications_by_status(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(
        F.count(F.lit(1)).alias("total"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
    )


def notifications_by_project(log: DataFrame) -> DataFrame:
    """Per project: how many were sent and failed, and the last sent; most first."""
    return (
        log.groupBy("project_id")
        .agg(
            F.count(F.lit(1)).alias("total_emails"),
            count_where(F.col("status") == "Success").alias("succeeded"),
            count_where(F.col("status") == "Failed").alias("failed"),
            F.max("sent_at").alias("last_sent"),
        )
        .orderBy(F.col("total_emails").desc(), F.col("project_id"))
    )


def notification_outcomes(tasks: DataFrame, delivered: Column, as_of: Column) -> DataFrame:
    """One log row per finished task that asks for a notification and names a recipient."""
    addressed = tasks.where(
        F.col("status").isin("Completed", "Failed") & F.col("notify_on_complete")
    ).withColumn("_to", parse_recipients(F.col("notification_email"))).where(F.size("_to") > 0)
    subject = F.when(F.col("status") == "Completed", COMPLETED_SUBJECT).otherwise(FAILED_SUBJECT)
    sent = F.coalesce(delivered, F.lit(False))
    return addressed.select(
        "task_id",
        "project_id",
        "server_id",
        recipients_json(F.col("_to")).alias("recipients"),
        F.concat(subject, F.col("project_id").cast("string")).alias("subject"),
        F.when(sent, "Success").otherwise("Failed").alias("status"),
        F.size("_to").cast("bigint").alias("recipient_count"),
        F.when(sent, as_of).alias("sent_at"),
        as_of.alias("created_at"),
    )


def append_notifications(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The log with the outcomes appended."""
    return insert_by_name(log, outcomes)

"""Change feeds from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablerelay.operators import changes
from tablerelay.queries.book import Book

book = Book()
QUERIES, SQL = book.queries, book.sql

LATEST = """
    SELECT * EXCLUDE (position) FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY version DESC) AS position FROM {feed}) r
    WHERE position = 1"""
APPLIED = f"""
    SELECT t.pk, t.value FROM {{feed_target}} t ANTI JOIN {{feed}} f ON f.pk = t.pk
    UNION ALL SELECT pk, value FROM ({LATEST}) n WHERE op <> 'D'"""
_HISTORY = """
    SELECT pk, version, op, lag(op) OVER (PARTITION BY pk ORDER BY version) AS before_op,
           lag(value) OVER (PARTITION BY pk ORDER BY version) AS before_value, value AS after_value FROM {feed}"""


@book.query(APPLIED)
def apply_changes(t):
    return changes.apply_changes(t.feed_target, t.feed, ["pk"], "version", "op")


@book.query(_HISTORY.replace("op, lag(op)", "lag(op)").replace("value AS", "op AS after_op, value AS"))
def change_history(t):
    return changes.change_history(t.feed, ["pk"], "version", ["op", "value"])


@book.query("""
    SELECT pk, version, op, lag(value) OVER (PARTITION BY op ORDER BY version) AS before_value, value AS after_value FROM {feed}""")
def change_history_hot(t):
    """Keys that hold a large part of all rows each."""
    return changes.change_history(t.feed, ["op"], "version", ["value"])


@book.query(_HISTORY.replace("op, lag(op)", "lag(op)").replace("value AS", "op AS after_op, value AS"))
def change_history_two_feeds(t):
    """Two feeds one after another, the second starting from the last rows of the first."""
    early = F.col("version") <= t.feed.agg(F.percentile_approx("version", 0.5)).first()[0]
    first, second, values = t.feed.where(early), t.feed.where(~early), ["op", "value"]
    last = changes.last_rows(first, ["pk"], "version", values)
    return changes.change_history(first, ["pk"], "version", values).unionByName(
        changes.change_history(second, ["pk"], "version", values, before=last)
    )


@book.query("SELECT event_type AS table_name, CAST(count(*) AS BIGINT) AS changes_count FROM events GROUP BY event_type")
def changes_by_table(t):
    return changes.changes_by_table(t.events.withColumnRenamed("event_type", "table_name"), "table_name")

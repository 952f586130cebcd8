"""High-water marks and tracking state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablerelay.operators import incremental, state
from tablerelay.plans.job import compact_states, read_states
from tablerelay.plans.publish import load_clustered, read_load
from tablerelay.queries.book import Book
from tablerelay.queries.fixtures import AS_OF
from tablerelay.session import shared_folder

book = Book()
QUERIES, SQL = book.queries, book.sql

SINCE = "2000-01-01 00:00:00"
# Fixed value: the version after which rows count as new, as the eight bytes of 1000.
VERSION = (1000).to_bytes(8, "big")


@book.query(f"SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '{SINCE}'")
def incremental_timestamp(t):
    return incremental.incremental_timestamp(t.orders, "O_ORDERDATE", SINCE)


@book.query(f"SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '{SINCE}'")
def incremental_timestamp_inclusive(t):
    return incremental.incremental_timestamp(t.orders, "o_orderdate", SINCE, inclusive=True)


@book.query(f"SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '{SINCE}'")
def incremental_clustered(t):
    """The same from a source in the order of its tracking column, of which few row groups are read."""
    load = load_clustered(t.orders, shared_folder(t.spark, "clustered"), "o_orderdate")
    return incremental.incremental_timestamp(read_load(t.spark, load), "o_orderdate", SINCE)


@book.query("""
    SELECT o_orderkey, o_custkey, hex(row_version) AS version_hex FROM {versioned_orders} WHERE o_orderkey > 1000""")
def incremental_rowversion(t):
    new = incremental.incremental_rowversion(t.versioned_orders, "row_version", VERSION)
    return new.select("o_orderkey", "o_custkey", F.hex("row_version").alias("version_hex"))


@book.query("SELECT max(changed_at) AS watermark FROM {partly_tracked_orders}")
def max_watermark_ts(t):
    return incremental.max_watermark_ts(t.partly_tracked_orders, "CHANGED_AT", "1990-01-01 00:00:00")


@book.query("SELECT hex(max(row_version)) AS watermark_hex FROM {versioned_orders}")
def max_watermark_rowversion(t):
    return incremental.max_watermark_rowversion(t.versioned_orders, "row_version")


@book.query(f"""
    SELECT o_orderkey, o_custkey, coalesce(changed_at, TIMESTAMP '{AS_OF}') AS changed_at FROM {{partly_tracked_orders}}""")
def backfill_tracking(t):
    return incremental.backfill_tracking(t.partly_tracked_orders, "changed_at", AS_OF)


@book.query("""
    SELECT * EXCLUDE (position) FROM (
        SELECT *, row_number() OVER (PARTITION BY job_identifier ORDER BY last_sync_time DESC, rows_processed DESC) AS position
        FROM {states} WHERE success) ranked WHERE position = 1""")
def last_success_state(t):
    return state.last_success_state(t.states)


_CURRENT = """
    SELECT job_identifier, max(last_sync_time) AS last_sync_time, max(rows_processed) AS rows_processed,
           min(created_at) AS created_at, max(updated_at) AS updated_at FROM {states}
    WHERE updated_at < {ts} '2024-01-15 00:00:00' GROUP BY job_identifier"""
_UPDATES = """
    SELECT job_identifier, last_sync_time, rows_processed, created_at, updated_at FROM {states}
    WHERE updated_at >= {ts} '2024-01-10 00:00:00' AND success"""


@book.query(f"""
    SELECT coalesce(u.job_identifier, c.job_identifier) AS job_identifier,
           coalesce(u.last_sync_time, c.last_sync_time) AS last_sync_time,
           coalesce(u.rows_processed, c.rows_processed) AS rows_processed,
           coalesce(c.created_at, u.created_at) AS created_at,
           coalesce(u.updated_at, c.updated_at) AS updated_at
    FROM ({_CURRENT}) c FULL JOIN (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_identifier ORDER BY updated_at DESC, rows_processed DESC) AS position
                       FROM ({_UPDATES}) u0) u1 WHERE position = 1) u
      ON c.job_identifier = u.job_identifier""")
def save_state(t):
    early, late = "2024-01-15 00:00:00", "2024-01-10 00:00:00"
    current = t.states.where(F.col("updated_at") < F.lit(early).cast("timestamp_ntz")).groupBy("job_identifier").agg(
        F.max("last_sync_time").alias("last_sync_time"), F.max("rows_processed").alias("rows_processed"),
        F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"),
    )
    updates = t.states.where((F.col("updated_at") >= F.lit(late).cast("timestamp_ntz")) & F.col("success"))
    return state.save_state(
        current, updates.select("job_identifier", "last_sync_time", "rows_processed", "created_at", "updated_at")
    )


@book.query("""
    SELECT job_identifier, last_sync_time, rows_processed, min(created_at) OVER (PARTITION BY job_identifier) AS created_at, updated_at
    FROM {states} QUALIFY row_number() OVER (PARTITION BY job_identifier ORDER BY updated_at DESC, rows_processed DESC) = 1""")
def save_state_log(t):
    """The states are a log that holds a job many times, as runs write it."""
    log = t.states.select("job_identifier", "last_sync_time", "rows_processed", "created_at", "updated_at")
    return state.save_state(log, log)


@book.query("""
    SELECT coalesce(u.key, c.key) AS key, CASE WHEN u.key IS NULL THEN c.value ELSE u.value END AS value
    FROM (SELECT c_name AS key, c_mktsegment AS value FROM customer) c
    FULL JOIN (SELECT c_name AS key, CASE WHEN c_acctbal < 0 THEN NULL ELSE 'set' END AS value FROM customer
               WHERE c_mktsegment = 'BUILDING') u ON c.key = u.key
    WHERE CASE WHEN u.key IS NULL THEN c.value ELSE u.value END IS NOT NULL""")
def save_settings(t):
    stored = t.customer.select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    updates = t.customer.where("c_mktsegment = 'BUILDING'").select(
        F.col("c_name").alias("key"), F.when(F.col("c_acctbal") >= 0, "set").alias("value")
    )
    return state.save_settings(stored, updates)


@book.query("SELECT * FROM {states} WHERE job_identifier <> 'job7'")
def reset_state(t):
    return state.reset_state(t.states, "job7")


@book.query("""
    SELECT job_identifier, last_sync_time AS last_sync, rows_processed AS total_rows, rows_inserted AS inserted,
           rows_updated AS updated, rows_deleted AS deleted, CASE WHEN success THEN 'OK' ELSE 'ERROR' END AS status,
           error_message
    FROM {states} WHERE job_identifier LIKE '%job1%'""")
def tracking_monitor(t):
    return state.tracking_monitor(t.states, containing="job1")


@book.query("""
    SELECT job_identifier, last_sync_time AS last_sync, rows_processed AS total_rows, rows_inserted AS inserted,
           rows_updated AS updated, rows_deleted AS deleted, CASE WHEN success THEN 'OK' ELSE 'ERROR' END AS status,
           error_message
    FROM {states} ORDER BY last_sync_time DESC, job_identifier LIMIT 1""")
def tracking_monitor_newest(t):
    return state.tracking_monitor(t.states, newest=1)


@book.query("""
    SELECT job_identifier, rows_processed, CAST(success AS BOOLEAN) AS success FROM (
        SELECT *, row_number() OVER (PARTITION BY job_identifier ORDER BY run_number DESC) AS position FROM (
            SELECT 'job' || o_custkey % 50 AS job_identifier, o_orderkey AS rows_processed, TRUE AS success,
                   row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS run_number FROM orders) s) r
    WHERE position = 1""")
def save_state_compacted(t):
    """States of many runs at one time, in more files than a log keeps: their number settles which is last."""
    path, job = shared_folder(t.spark, "states"), F.concat(F.lit("job"), (F.col("o_custkey") % 50).cast("string"))
    number = F.row_number().over(Window.partitionBy(F.col("o_custkey") % 50).orderBy("o_orderkey"))
    states = t.orders.select(
        job.alias("job_identifier"), F.col("o_orderkey").cast("bigint").alias("rows_processed"), F.lit(True).alias("success"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("updated_at"), number.cast("bigint").alias("run_number"),
    )
    states.repartition(40, "job_identifier", "run_number").write.parquet(path)
    compact_states(t.spark, path)
    return state.last_success_state(read_states(t.spark, path)).select("job_identifier", "rows_processed", "success")

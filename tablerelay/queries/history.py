"""Run history and its consolidation over many machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablerelay.operators import central, daily, history, known
from tablerelay.queries.book import Book
from tablerelay.queries.fixtures import AS_OF
from tablerelay.session import shared_folder

book = Book()
QUERIES, SQL = book.queries, book.sql

_STATS = """
    CAST(count(*) AS BIGINT) AS total_executions, CAST(count_if(status = 'Success') AS BIGINT) AS success_count,
    CAST(count_if(status = 'Failed') AS BIGINT) AS failed_count, CAST(count_if(status = 'Running') AS BIGINT) AS running_count,
    round(coalesce(avg(duration_ms), 0), 4) AS avg_duration_ms,
    CAST(coalesce(sum(rows_read), 0) AS BIGINT) AS total_rows_read, CAST(coalesce(sum(rows_inserted), 0) AS BIGINT) AS total_rows_inserted,
    CAST(coalesce(sum(rows_updated), 0) AS BIGINT) AS total_rows_updated, CAST(coalesce(sum(rows_deleted), 0) AS BIGINT) AS total_rows_deleted,
    round(CASE WHEN count(*) > 0 THEN CAST(count_if(status = 'Success') AS DOUBLE) / count(*) * 100 ELSE 0 END, 6) AS success_rate"""
_RECENT = "FROM {history} WHERE start_time >= TIMESTAMP '2024-01-11 00:00:00'"


def _rounded(df):
    return df.withColumns({"avg_duration_ms": F.round("avg_duration_ms", 4), "success_rate": F.round("success_rate", 6)})


@book.query(f"SELECT {_STATS} {_RECENT}")
def history_stats(t):
    return _rounded(history.history_stats(t.history, AS_OF, days=20))


@book.query(f"SELECT config_id, {_STATS} {_RECENT} GROUP BY config_id")
def history_stats_by_config(t):
    return _rounded(history.history_stats_by_config(t.history, AS_OF, days=20))


def _run_days(t):
    """Days as two loads leave them: the second brings late rows, which make their days anew."""
    path, late = shared_folder(t.spark, "run-days"), F.col("execution_id") % 5 == 0
    daily.save_days(daily.run_days(t.history.where(~late)), path)
    daily.refresh_days(t.history, t.history.where(late), path, "start_time", daily.run_days)
    return daily.read_days(t.spark, path)


@book.query(f"SELECT {_STATS} {_RECENT}")
def history_stats_from_days(t):
    return _rounded(daily.stats_from_days(_run_days(t), AS_OF, 20))


@book.query(f"SELECT config_id, {_STATS} {_RECENT} GROUP BY config_id")
def history_stats_by_config_from_days(t):
    return _rounded(daily.stats_from_days(_run_days(t), AS_OF, 20, by_config=True))


@book.query("""
    SELECT * FROM {history} WHERE status = 'Failed' AND start_time >= TIMESTAMP '2024-01-05 00:00:00'
      AND start_time <= TIMESTAMP '2024-01-25 00:00:00' ORDER BY start_time DESC, execution_id DESC LIMIT 50""")
def history_filter(t):
    return history.history_filter(
        t.history, status="Failed", start="2024-01-05 00:00:00", end="2024-01-25 00:00:00", limit=50
    )


@book.query("SELECT * FROM {history} WHERE config_id = 7 AND lower(status) = 'success'")
def history_filter_by_config(t):
    return history.history_filter(t.history, status="SUCCESS", config_id=7)


@book.query("SELECT * FROM {history} WHERE execution_id = 321")
def history_by_id(t):
    return history.history_by_id(t.history, 321)


@book.query("SELECT *, rows_inserted + rows_updated + rows_deleted AS rows_processed FROM {history}")
def history_totals(t):
    return history.history_totals(t.history)


@book.query("""
    SELECT CAST(count(*) AS BIGINT) AS total_executions,
           CAST(sum(rows_inserted + rows_updated + rows_deleted) AS BIGINT) AS total_rows_processed FROM {history}""")
def history_grand_total(t):
    return history.history_grand_total(t.history)


@book.query("""
    SELECT * EXCLUDE (position) FROM (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY start_time DESC, execution_id DESC) AS position
    FROM {history}) ranked WHERE position = 1""")
def last_execution(t):
    return history.last_execution(t.history)


@book.query("""
    SELECT * EXCLUDE (position) FROM (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY start_time DESC, execution_id DESC) AS position
    FROM {history}) ranked WHERE position <= 20""")
def recent_per_config(t):
    return history.recent_per_config(t.history, 20)


@book.query("""
    SELECT c.config_id, c.config_display_name, c.is_active, c.updated_at, coalesce(m.n, 0) AS mappings_count,
           h.start_time AS last_execution, h.status AS last_execution_status
    FROM {configs} c
    LEFT JOIN (SELECT config_id, CAST(count(*) AS BIGINT) AS n FROM {mappings} GROUP BY config_id) m ON m.config_id = c.config_id
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY start_time DESC, execution_id DESC) AS position
               FROM {history}) r WHERE position = 1) h ON h.config_id = c.config_id
    WHERE c.is_active""")
def configs_with_last_run(t):
    return history.configs_with_last_run(t.configs, t.mappings, t.history, active=True)


@book.query("SELECT * FROM {history} WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00'")
def retention_history(t):
    return history.retention_history(t.history, AS_OF, 7)


@book.query("SELECT CAST(count(*) AS BIGINT) AS deleted_count FROM {history} WHERE start_time < TIMESTAMP '2024-01-24 00:00:00'")
def retention_history_count(t):
    return history.expired_history_count(t.history, AS_OF, 7)


@book.query("""
    SELECT execution_id, config_id, start_time, duration_ms, status,
           CASE WHEN status = 'Running' THEN NULL ELSE rows_read END AS rows_read FROM {history}""")
def record_run(t):
    started = t.history.select(
        "execution_id", "config_id", "start_time", F.lit(None).cast("bigint").alias("duration_ms"),
        F.lit("Running").alias("status"), F.lit(None).cast("bigint").alias("rows_read"),
        F.lit(0).alias("recorded_at"),
    )
    ended = t.history.where("status <> 'Running'").select(
        "execution_id", F.lit(None).cast("bigint").alias("config_id"), F.lit(None).cast("timestamp_ntz").alias("start_time"),
        "duration_ms", "status", "rows_read", F.lit(1).alias("recorded_at"),
    )
    return history.record_run(started.unionByName(ended))


@book.query("""
    SELECT server_id, records_processed, records_failed,
           CASE WHEN records_failed = 0 THEN 'Success' WHEN records_failed < records_processed THEN 'PartialSuccess' ELSE 'Failed' END AS status
    FROM (SELECT concat('srv', CAST(config_id AS VARCHAR), status) AS server_id,
                 CAST(count_if(NOT (duration_ms IS NULL OR rows_read < 2000)) AS BIGINT) AS records_processed,
                 CAST(count_if(duration_ms IS NULL OR rows_read < 2000) AS BIGINT) AS records_failed
          FROM {history} GROUP BY 1) g""")
def sync_batch_result(t):
    outcomes = t.history.withColumn("server_id", F.concat(F.lit("srv"), "config_id", "status"))
    failed = F.col("duration_ms").isNull() | (F.col("rows_read") < 2000)
    return history.sync_batch_result(outcomes, ["server_id"], failed)


@book.query(f"""
    SELECT * FROM {{central_history}}
    UNION ALL
    SELECT f.execution_id, f.project_id, f.server_id, f.config_id, c.config_display_name, f.start_time, f.duration_ms, f.status,
           TIMESTAMP '{AS_OF}', CAST(NULL AS VARCHAR)
    FROM (SELECT DISTINCT * FROM {{history_feed}} d WHERE start_time >= TIMESTAMP '2024-01-17 00:00:00') f
    LEFT JOIN {{configs}} c ON c.config_id = f.config_id
    WHERE f.execution_id NOT IN (SELECT execution_id FROM {{central_history}})""")
def consolidate_history(t):
    return central.consolidate_history(t.central_history, t.history_feed, t.configs, AS_OF, days=14)


@book.query(SQL["consolidate_history"])
def consolidate_history_filtered(t):
    """Only runs that a stored filter of the central ids may hold are looked up there."""
    path = shared_folder(t.spark, "known")
    for day, part in (("2024-01-15", "crc32(CAST(execution_id AS STRING)) % 2 = 0"), ("2024-01-16", "crc32(CAST(execution_id AS STRING)) % 2 = 1")):
        known.add_known(t.central_history.where(part), "execution_id", path, day)
    return central.consolidate_history(
        t.central_history, t.history_feed, t.configs, AS_OF, days=14, known=known.read_known(t.spark, path)
    )


@book.query(SQL["consolidate_history"])
def consolidate_history_repeated_configs(t):
    """Each configuration is listed twice, once under a lesser name."""
    twice = t.configs.unionByName(t.configs.withColumn("config_display_name", F.lit("")))
    return central.consolidate_history(t.central_history, t.history_feed, twice, AS_OF, days=14)


@book.query("""
    SELECT coalesce(b.server_id, s.server_id) AS server_id, coalesce(b.project_id, s.project_id) AS project_id, s.server_name,
           coalesce(b.beat, s.last_heartbeat) AS last_heartbeat, coalesce(b.beat IS NOT NULL, FALSE) AS is_online
    FROM {servers} s FULL JOIN (SELECT server_id, project_id, max(beat_at) AS beat FROM {beats} GROUP BY server_id, project_id) b
      ON b.server_id = s.server_id AND b.project_id = s.project_id""")
def heartbeat_upsert(t):
    return central.heartbeat_upsert(t.servers, t.beats)

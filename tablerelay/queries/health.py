"""Run health: deviations from the baseline and the verdicts on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablerelay.operators import daily, health
from tablerelay.queries.book import Book
from tablerelay.queries.fixtures import AS_OF
from tablerelay.session import shared_folder

book = Book()
QUERIES, SQL = book.queries, book.sql

_BASE = """
    SELECT project_id, task_type, CAST(count(*) AS BIGINT) AS total_executions, coalesce(avg(duration_ms), 0) AS avg_duration_ms,
           coalesce(avg(rows_processed), 0) AS avg_rows_processed,
           CAST(count_if(status = 'Completed') AS DOUBLE) / count(*) AS success_rate,
           coalesce(min(duration_ms), 0) AS min_duration_ms, coalesce(max(duration_ms), 0) AS max_duration_ms
    FROM {tasks} WHERE completed_at >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY project_id, task_type"""
_RUN = f"""
    SELECT task_id, duration_ms / 1000.0::DOUBLE AS sec, coalesce(rows_processed, 0) AS n, coalesce(b.avg_duration_ms, 0) / 1000.0::DOUBLE AS avg_sec,
           coalesce(b.avg_rows_processed, 0) AS avg_n, coalesce(b.success_rate, 0) AS success_rate,
           coalesce(CASE WHEN avg_sec > 0 THEN (sec - avg_sec) / avg_sec * 100 END, 0) AS slow,
           coalesce(CASE WHEN avg_n > 0 THEN (n - avg_n) / avg_n * 100 END, 0) AS more
    FROM {{tasks}} t LEFT JOIN ({_BASE}) b ON b.project_id = t.project_id AND b.task_type = t.task_type
    WHERE duration_ms IS NOT NULL"""


def _deviations(t):
    return health.run_deviation(t.tasks, health.run_baseline(t.tasks, AS_OF))


@book.query(f"""
    SELECT * REPLACE (round(avg_duration_ms, 4) AS avg_duration_ms, round(avg_rows_processed, 4) AS avg_rows_processed,
                      round(success_rate, 6) AS success_rate) FROM ({_BASE}) b""")
def run_baseline(t):
    places = {"avg_duration_ms": 4, "avg_rows_processed": 4, "success_rate": 6}
    return health.run_baseline(t.tasks, AS_OF).withColumns({c: F.round(c, n) for c, n in places.items()})


@book.query(f"""
    SELECT * REPLACE (round(avg_duration_ms, 4) AS avg_duration_ms, round(avg_rows_processed, 4) AS avg_rows_processed,
                      round(success_rate, 6) AS success_rate) FROM ({_BASE}) b""")
def run_baseline_from_days(t):
    """The same from stored days of completion; the tasks are not read again."""
    path = shared_folder(t.spark, "task-days")
    daily.save_days(daily.task_days(t.tasks), path)
    places = {"avg_duration_ms": 4, "avg_rows_processed": 4, "success_rate": 6}
    return daily.baseline_from_days(daily.read_days(t.spark, path), AS_OF).withColumns({c: F.round(c, n) for c, n in places.items()})


@book.query(f"""
    SELECT task_id, round(slow, 4) AS duration_deviation, round(more, 4) AS rows_deviation FROM ({_RUN}) r""")
def run_deviation(t):
    return _deviations(t).select(
        "task_id", F.round("duration_deviation", 4).alias("duration_deviation"),
        F.round("rows_deviation", 4).alias("rows_deviation"),
    )


def _verdict(t, column: str):
    return health.run_health(_deviations(t)).select("task_id", column)


@book.query(f"""
    SELECT task_id, CASE WHEN slow < -20 THEN 'Excelente' WHEN slow < 10 THEN 'Bueno' WHEN slow < 50 THEN 'Normal' ELSE 'Lento' END AS performance_class
    FROM ({_RUN}) r""")
def performance_class(t):
    return _verdict(t, "performance_class")


@book.query(f"""
    SELECT task_id, CASE WHEN abs(slow) < 10 AND abs(more) < 15 THEN 'STABLE' WHEN slow > 30 OR more > 50 THEN 'ANOMALY'
           ELSE 'NORMAL VARIANCE' END AS run_pattern FROM ({_RUN}) r""")
def run_pattern(t):
    return _verdict(t, "run_pattern")


@book.query(f"""
    SELECT task_id, CASE WHEN n / greatest(sec, 1) > avg_n / greatest(avg_sec, 1) * 1.2 THEN 'OPTIMAL'
                         WHEN n / greatest(sec, 1) < avg_n / greatest(avg_sec, 1) * 0.7 THEN 'DEGRADED' ELSE 'ACCEPTABLE' END AS throughput_class
    FROM ({_RUN}) r""")
def throughput_class(t):
    return _verdict(t, "throughput_class")


@book.query(f"""
    SELECT task_id, CASE WHEN slow <= 50 AND success_rate >= 0.80 THEN 'ALL CLEAR'
                         ELSE concat_ws('+', CASE WHEN slow > 100 THEN 'ALERT' WHEN slow > 50 THEN 'WARNING' END,
                                             CASE WHEN success_rate < 0.80 THEN 'CONCERN' END) END AS alert_level
    FROM ({_RUN}) r""")
def alert_level(t):
    return _verdict(t, "alert_level").withColumn("alert_level", F.array_join("alert_level", "+"))


@book.query(f"""
    SELECT task_id, CASE WHEN n > avg_n * 2 THEN 'Data volume is growing. Consider batch processing or incremental sync.'
                         WHEN sec > 300 AND n < 10000 THEN 'Low throughput detected. Check network latency and query optimization.' END AS run_tip
    FROM ({_RUN}) r""")
def run_tip(t):
    return _verdict(t, "run_tip")


@book.query(f"""
    SELECT task_id, CASE WHEN abs(n - avg_n) < avg_n * 0.1 THEN 'stable' WHEN n > avg_n THEN 'up' ELSE 'down' END AS volume_trend
    FROM ({_RUN}) r""")
def volume_trend(t):
    return _verdict(t, "volume_trend")


@book.query(f"""
    SELECT task_id, CASE WHEN success_rate >= 0.95 THEN 'excelente estabilidad' WHEN success_rate >= 0.80 THEN 'estabilidad aceptable'
                         ELSE 'necesita atención' END AS stability,
           CASE WHEN slow > 50 THEN 'slower' WHEN slow < -30 THEN 'faster' ELSE 'expected' END AS duration_remark,
           more > 100 AS growth_alert
    FROM ({_RUN}) r""")
def stability(t):
    return health.run_health(_deviations(t)).select("task_id", "stability", "duration_remark", "growth_alert")

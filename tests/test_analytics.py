from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablerelay.functions import health, labels, recipients, timing
from tablerelay.operators import central, history, notifications, state, tasks
from tablerelay.operators.health import run_baseline, run_deviation, run_health

NOW = "2024-01-31 12:00:00"


def one(spark, column):
    return spark.range(1).select(column).head()[0]


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def frame(spark, schema, *rows):
    """Rows with timestamps written as text."""
    parts = [p.strip().split(" ") for p in schema.split(",")]
    text = ", ".join(f"{n} {'string' if t == 'timestamp_ntz' else t}" for n, t in parts)
    df = spark.createDataFrame(list(rows), text)
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in parts])


def test_minutes_count_boundaries(spark):
    assert one(spark, timing.minutes_between(ts("2024-01-01 00:00:59"), ts("2024-01-01 00:01:01"))) == 1
    assert one(spark, timing.minutes_between(ts("2024-01-01 00:00:00"), ts("2024-01-01 00:00:59"))) == 0
    assert one(spark, timing.minutes_between(ts("1969-12-31 23:59:59.5"), ts("1970-01-01 00:00:00"))) == 1
    assert one(spark, timing.seconds_between(ts("2024-01-01 00:00:00.9"), ts("2024-01-01 00:00:01.1"))) == 1


@pytest.mark.parametrize("ms, short, long, wrapped", [
    (90_000_000, "25h 0m", "25h 0m 0s", "1h 0m 0s"), (3_725_000, "1h 2m", "1h 2m 5s", "1h 2m 5s"),
    (65_000, "1m 5s", "1m 5s", "1m 5s"), (1500, "1s", "1s", "1s"), (80, "80ms", "0s", "0s"), (None, None, "-", "-"),
])
def test_durations(spark, ms, short, long, wrapped):
    value = F.lit(ms).cast("bigint")
    assert one(spark, timing.format_duration(value)) == short
    assert one(spark, timing.format_duration_long(value)) == long
    assert one(spark, timing.format_duration_long(value, wrap_days=True)) == wrapped


def test_seconds_round_half_up(spark):
    assert str(one(spark, timing.duration_seconds(F.lit(2155)))) == "2.16"
    assert one(spark, timing.duration_seconds(F.lit(None).cast("bigint"))) is None


def test_labels_fall_back_to_the_status(spark):
    assert one(spark, labels.status_display(F.lit("Running"))) == "▶ En Ejecución"
    assert one(spark, labels.status_display(F.lit("Other"))) == "Other"
    assert one(spark, labels.notification_display(F.lit("Retrying"))) == "Reintentando"


def test_recipients(spark):
    assert one(spark, recipients.parse_recipients(F.lit(" a@x; b@y,, ;c "))) == ["a@x", "b@y", "c"]
    assert one(spark, recipients.parse_recipients(F.lit(None).cast("string"))) == []
    assert one(spark, recipients.parse_recipients_json(F.lit('["a","b"]'))) == ["a", "b"]
    assert one(spark, recipients.parse_recipients_json(F.lit("{bad"))) == []


@pytest.mark.parametrize("seconds, rows, expected", [
    (45.2, 125430, ("Bueno", "STABLE", "ACCEPTABLE", ["ALL CLEAR"])),
    (185.4, 128900, ("Lento", "ANOMALY", "DEGRADED", ["ALERT"])),
    (92.3, 312500, ("Lento", "ANOMALY", "OPTIMAL", ["ALERT"])),
])
def test_health_scenarios(spark, seconds, rows, expected):
    """Three runs against a usual 44.8 seconds and 122,100 rows."""
    s, n, usual_s, usual_n = (F.lit(float(v)) for v in (seconds, rows, 44.8, 122100))
    slow, more = health.deviation_percent(s, usual_s), health.deviation_percent(n, usual_n)
    rate = health.throughput_class(health.throughput(n, s), health.throughput(usual_n, usual_s))
    found = spark.range(1).select(
        health.performance_class(slow), health.run_pattern(slow, more), rate, health.alerts(slow, F.lit(0.97))
    ).head()
    assert tuple(found) == expected


def test_health_edges(spark):
    assert one(spark, health.deviation_percent(F.lit(5.0), F.lit(0.0))) == 0.0
    assert one(spark, health.alerts(F.lit(51.0), F.lit(0.79))) == ["WARNING", "CONCERN"]
    assert one(spark, health.run_tip(F.lit(9000.0), F.lit(9000.0), F.lit(301.0))).startswith("Low")
    assert one(spark, health.throughput(F.lit(10.0), F.lit(0.2))) == 10.0


TASKS = ("task_id int, project_id string, task_type string, status string, priority int, requested_at timestamp_ntz, "
         "started_at timestamp_ntz, completed_at timestamp_ntz, duration_ms bigint, rows_processed bigint, "
         "error_message string, updated_at timestamp_ntz")


def queue(spark):
    day = "2024-01-31"
    return frame(
        spark, TASKS,
        (1, "p", "DataSync", "Pending", 10, f"{day} 09:00:00", None, None, None, None, None, None),
        (2, "p", "DataSync", "Completed", 5, f"{day} 08:00:00", f"{day} 08:00:00", f"{day} 08:05:00", 300000, 15000, None, None),
        (3, "p", "DataSync", "Failed", 5, f"{day} 08:00:00", f"{day} 08:00:00", f"{day} 08:00:12", 12000, None, "boom", None),
        (4, "q", "FullRefresh", "Pending", 9, "2024-01-29 10:00:00", None, None, None, None, None, None),
        (5, "q", "FullRefresh", "Running", 7, f"{day} 10:00:00", f"{day} 10:59:30", None, None, None, None, None),
        (6, "q", "FullRefresh", "Cancelled", 7, "2023-01-01 00:00:00", None, "2023-01-01 00:00:00", None, None, None, None),
    )


def by_id(df, *columns):
    return {r["task_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_queue_order_and_aging(spark):
    assert [r.task_id for r in tasks.pending_queue(queue(spark)).collect()] == [1, 4]
    assert [r.task_id for r in tasks.pending_queue(queue(spark), project_id="q").collect()] == [4]
    aged = tasks.age_priority(queue(spark), NOW)
    assert by_id(aged, "priority")[4] == (10,) and by_id(aged, "priority")[1] == (10,)
    assert aged.schema["priority"].dataType.simpleString() == "int"


def test_stuck_and_stale_tasks(spark):
    assert by_id(tasks.stuck_running(queue(spark), NOW), "minutes_running") == {5: (61,)}
    failed = by_id(tasks.fail_stuck(queue(spark), NOW), "status", "error_message")
    assert failed[5] == ("Failed", "Task stuck in Running state - marked as failed") and failed[1][0] == "Pending"
    cancelled = by_id(tasks.cancel_stale(queue(spark), NOW, 48), "status", "error_message")
    assert cancelled[4] == ("Cancelled", "Task cancelled automatically due to age (>48 hours)")
    assert tasks.stale_count(queue(spark), NOW, 48).head()[0] == 1
    assert 6 not in by_id(tasks.retention_tasks(queue(spark), NOW), "status")
    assert tasks.retention_tasks(queue(spark), NOW).count() == 5


def test_patches_keep_what_they_do_not_name(spark):
    patches = spark.createDataFrame([(3, "Pending", None, 7), (99, "x", "y", 1)],
                                    "task_id int, status string, error_message string, rows_processed int")
    rows = by_id(tasks.patch_status(queue(spark), patches, NOW), "status", "error_message", "rows_processed")
    assert rows[3] == ("Pending", "boom", 7) and rows[2] == ("Completed", None, 15000) and 99 not in rows


def test_figures_over_an_empty_queue(spark):
    empty = queue(spark).limit(0).withColumns({c: F.lit(0) for c in ("rows_inserted", "rows_updated", "rows_failed")})
    found = tasks.task_statistics(empty.withColumn("notification_sent", F.lit(True)), NOW).head()
    assert (found.total_tasks, found.success_rate, found.avg_duration_ms, found.total_rows_processed) == (0, 0.0, None, 0)
    runs = spark.createDataFrame([], "config_id int, start_time timestamp_ntz, duration_ms bigint, status string, "
                                     "rows_read bigint, rows_inserted bigint, rows_updated bigint, rows_deleted bigint")
    assert set(history.history_stats(runs, NOW).head()) == {0}


def test_validity_ignores_nulls(spark):
    df = spark.createDataFrame([(1, "Nope", "DataSync", 11), (2, None, None, None)], "task_id int, status string, task_type string, priority int")
    assert sorted(map(tuple, tasks.task_validity(df).collect())) == [(1, "priority"), (1, "status")]


def test_case_insensitive_projects(spark):
    projects = spark.createDataFrame([("iberia", "Iberia", "C")], "project_id string, project_name string, client_name string")
    queue_ = spark.createDataFrame([(1, "IBERIA"), (2, "other")], "task_id int, project_id string")
    assert by_id(tasks.tasks_projects_ci(queue_, projects), "project_name") == {1: ("Iberia",)}


def test_baseline_and_health_of_runs(spark):
    base = run_baseline(queue(spark), NOW)
    found = {(r.project_id, r.task_type): r for r in base.collect()}
    assert set(found) == {("p", "DataSync")}
    row = found[("p", "DataSync")]
    assert (row.total_executions, row.avg_duration_ms, row.avg_rows_processed, row.success_rate) == (2, 156000.0, 15000.0, 0.5)
    judged = by_id(run_health(run_deviation(queue(spark), base)), "performance_class", "alert_level", "stability")
    assert judged[2] == ("Lento", ["WARNING", "CONCERN"], "necesita atención")


HISTORY = "execution_id int, config_id int, start_time timestamp_ntz, status string"


def test_history_is_filtered_before_it_is_cut(spark):
    runs = frame(spark, HISTORY, *[(i, i % 2, f"2024-01-{i + 1:02d} 00:00:00", "Failed" if i < 3 else "Success") for i in range(9)])
    assert [r.execution_id for r in history.history_filter(runs, status="Failed", limit=2).collect()] == [2, 1]
    assert history.history_filter(runs, status="failed").count() == 0
    assert [r.execution_id for r in history.history_filter(runs, status="failed", config_id=0).collect()] == [2, 0]
    assert {r.config_id: r.execution_id for r in history.last_execution(runs).collect()} == {0: 8, 1: 7}


def test_records_fold_to_the_latest_value(spark):
    records = spark.createDataFrame([(1, 0, "Running", None), (1, 5, "Success", 10), (1, 9, None, None), (2, 0, "Running", None)],
                                    "execution_id int, recorded_at int, status string, rows_read int")
    rows = {r.execution_id: (r.status, r.rows_read) for r in history.record_run(records).collect()}
    assert rows == {1: ("Success", 10), 2: ("Running", None)}


def test_consolidation_is_idempotent(spark):
    store = frame(spark, "execution_id int, project_id int, server_id int, config_id int, config_display_name string, "
                         "start_time timestamp_ntz, synced_at timestamp_ntz, host_machine string").limit(0)
    feed = frame(spark, "execution_id int, project_id int, server_id int, config_id int, start_time timestamp_ntz",
                 (1, 1, 1, 5, "2024-01-30 00:00:00"), (1, 1, 1, 5, "2024-01-30 00:00:00"), (2, 1, 2, 6, "2024-01-29 00:00:00"),
                 (3, 1, 2, 6, "2023-01-01 00:00:00"))
    configs = spark.createDataFrame([(5, "five")], "config_id int, config_display_name string")
    once = central.consolidate_history(store, feed, configs, NOW)
    assert sorted((r.execution_id, r.config_display_name) for r in once.collect()) == [(1, "five"), (2, None)]
    twice = central.consolidate_history(once, feed, configs, NOW)
    assert sorted(twice.collect(), key=str) == sorted(once.collect(), key=str)
    assert central.consolidate_history(store, feed, configs, NOW, days=None).count() == 3
    assert central.consolidate_history(store, feed, configs, NOW, max_rows=1).head().execution_id == 1


def test_heartbeats_keep_what_is_known(spark):
    servers = frame(spark, "server_id string, project_id int, server_name string, last_heartbeat timestamp_ntz, is_online boolean",
                    ("a", 1, "Alpha", "2020-01-01 00:00:00", False), ("b", 1, "Beta", "2020-01-01 00:00:00", True))
    beats = frame(spark, "server_id string, project_id int, beat_at timestamp_ntz",
                  ("a", 1, "2024-01-01 00:00:00"), ("a", 1, "2024-01-02 00:00:00"), ("c", 1, "2024-01-01 00:00:00"))
    rows = {r.server_id: (r.server_name, r.last_heartbeat.year, r.is_online) for r in central.heartbeat_upsert(servers, beats).collect()}
    assert rows == {"a": ("Alpha", 2024, True), "b": ("Beta", 2020, True), "c": (None, 2024, True)}


def test_batch_results(spark):
    df = spark.createDataFrame([("a", False), ("b", True), ("b", False), ("b", False), ("c", True), ("d", None)], "s string, bad boolean")
    rows = {r.s: r.status for r in history.sync_batch_result(df, ["s"], F.col("bad")).collect()}
    assert rows == {"a": "Success", "b": "PartialSuccess", "c": "Failed", "d": "Success"}


def test_settings_and_states(spark):
    settings = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    updates = spark.createDataFrame([("a", None), ("c", "3")], "key string, value string")
    assert sorted(map(tuple, state.save_settings(settings, updates).collect())) == [("b", "2"), ("c", "3")]
    states = frame(spark, "job_identifier string, last_sync_time timestamp_ntz, success boolean, updated_at timestamp_ntz",
                   ("j", "2024-01-01 00:00:00", True, "2024-01-01 00:00:00"), ("j", "2024-01-03 00:00:00", False, "2024-01-03 00:00:00"),
                   ("k", "2024-01-02 00:00:00", True, "2024-01-02 00:00:00"))
    assert {r.job_identifier: r.last_sync_time.day for r in state.last_success_state(states).collect()} == {"j": 1, "k": 2}
    assert {r.job_identifier for r in state.reset_state(states, "j").collect()} == {"k"}


def test_notifications_need_a_recipient(spark):
    df = spark.createDataFrame([(1, "p", None, "Completed", True, "a; b"), (2, "p", None, "Failed", True, " , "),
                                (3, "p", None, "Failed", True, "c"), (4, "p", None, "Pending", True, "d")],
                               "task_id int, project_id string, server_id string, status string, notify_on_complete boolean, notification_email string")
    rows = notifications.notification_outcomes(df, F.col("task_id") == 1, ts(NOW)).orderBy("task_id").collect()
    assert [(r.task_id, r.recipients, r.status, r.recipient_count) for r in rows] == [
        (1, '["a","b"]', "Success", 2), (3, '["c"]', "Failed", 1)]
    assert rows[0].sent_at is not None and rows[1].sent_at is None
    assert rows[1].subject == "❌ Error en sincronización: p"


def test_days_add_up_to_the_statistics_of_their_rows(spark, tmp_path):
    from tablerelay.operators import daily, health, history

    rows = [(k, k % 3, "ab"[k % 2], f"2024-01-{1 + k % 28:02d} 0{k % 10}:00:00", None if k % 7 == 0 else k * 10, ["Completed", "Failed", "Running"][k % 3], None if k % 5 == 0 else k) for k in range(300)]
    rows += [(999, 1, "a", None, 5, "Completed", 5)]
    tasks = spark.createDataFrame(rows, "task_id int, project_id int, task_type string, at string, duration_ms int, status string, rows_processed bigint").withColumn("completed_at", F.col("at").cast("timestamp_ntz"))
    path = f"{tmp_path}/days"
    daily.save_days(daily.task_days(tasks.where("task_id % 4 <> 1")), path)
    daily.refresh_days(tasks, tasks.where("task_id % 4 = 1"), path, "completed_at", daily.task_days)
    daily.refresh_days(tasks, tasks.where("task_id = 3"), path, "completed_at", daily.task_days)
    for as_of, span in (("2024-01-31 00:00:00", 30), ("2024-01-20 00:00:00", 10), ("2025-01-01 00:00:00", 5)):
        found, want = daily.baseline_from_days(daily.read_days(spark, path), as_of, span), health.run_baseline(tasks, as_of, span)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select(*found.columns).collect()))
    runs = tasks.select(F.col("project_id").alias("config_id"), F.col("completed_at").alias("start_time"), "duration_ms", F.when(F.col("status") == "Completed", "Success").otherwise(F.col("status")).alias("status"),
                        F.col("rows_processed").alias("rows_read"), F.lit(1).alias("rows_inserted"), F.lit(None).cast("int").alias("rows_updated"), F.col("rows_processed").alias("rows_deleted"))
    days = daily.run_days(runs)
    assert daily.stats_from_days(days, "2024-01-31 00:00:00", 20).collect() == history.history_stats(runs, "2024-01-31 00:00:00", 20).collect()
    assert daily.stats_from_days(days.limit(0), "2024-01-31 00:00:00").collect() == history.history_stats(runs.limit(0), "2024-01-31 00:00:00").collect()
    by = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    assert by(daily.stats_from_days(days, "2024-01-31 00:00:00", 20, True)) == by(history.history_stats_by_config(runs, "2024-01-31 00:00:00", 20))


def test_filters_of_known_ids_deny_no_known_id_and_most_others(spark, tmp_path):
    from tablerelay.operators import known

    ids = spark.range(20_000).select(F.concat(F.lit("run-"), F.col("id").cast("string")).alias("execution_id"))
    path = f"{tmp_path}/known"
    for day, part in (("2024-01-01", "crc32(execution_id) % 2 = 0"), ("2024-01-02", "crc32(execution_id) % 2 = 1"), ("2024-01-02", "crc32(execution_id) % 2 = 1")):
        known.add_known(ids.where(part), "execution_id", path, day, 18)
    stored = known.read_known(spark, path)
    rows = spark.range(15_000, 40_000).select(F.concat(F.lit("run-"), F.col("id").cast("string")).alias("execution_id")).unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS execution_id"))
    maybe = {r.execution_id for r in known.maybe_known(rows, "execution_id", stored, 18).collect()}
    assert {f"run-{k}" for k in range(15_000, 20_000)} <= maybe and len(maybe) < 5_000 + 0.02 * 20_000
    assert known.maybe_known(rows, "execution_id", stored.limit(0), 18).count() == 0

"""What the plans must look like for large tables, with and without room to broadcast."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tablerelay.operators import changes, history, keys, merge, snapshot, tasks
from tablerelay.operators.incremental import incremental_timestamp
from tablerelay.operators.mapping import map_columns
from tablerelay.queries import all_queries
from tablerelay.queries.book import Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def t(spark):
    return Tables(spark, FOLDER)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, node: str) -> int:
    return len(re.findall(rf"[-:+\s)]{node}\b", plan(df)))


def test_the_incremental_filter_and_the_mapping_reach_the_scan(t):
    df = map_columns(incremental_timestamp(t.orders, "o_orderdate", "2000-01-01"), [("o_orderkey", "k")])
    text = plan(df)
    assert "GreaterThan(o_orderdate" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text


def test_an_upsert_moves_the_target_once(t, no_broadcast):
    df = merge.merge_upsert(t.stale_orders, t.orders, ["o_orderkey"], "unique")
    assert (count(df, "Exchange"), count(df, "SortMergeJoin")) == (2, 1)


def test_an_upsert_of_a_small_batch_does_not_move_the_target(t):
    df = merge.merge_upsert(t.stale_orders, t.orders, ["o_orderkey"], "unique")
    assert "hashpartitioning" not in plan(df) and count(df, "BroadcastHashJoin") == 1


def test_a_comparison_delete_moves_keys_only(t, no_broadcast):
    df = merge.keys_missing_in_source(t.orders, t.orders, ["o_orderkey"])
    assert "o_totalprice" not in plan(df)


def test_the_latest_rows_are_cut_before_the_shuffle(t):
    for df in (
        keys.latest_per_key(t.lineitem, ["l_orderkey"], ["l_shipdate"]),
        history.last_execution(t.history),
        history.recent_per_config(t.history, 5),
        changes.apply_changes(t.feed_target, t.feed, ["pk"], "version", "op"),
    ):
        text = plan(df)
        assert "Partial" in text[text.index("WindowGroupLimit"):]
        assert count(df, "WindowGroupLimit") >= 2


def test_repeated_keys_are_reduced_before_the_shuffle(t, no_broadcast):
    text = plan(keys.key_set(t.feed, ["pk"], repeated=True))
    assert text.count("HashAggregate") == 2


def test_a_snapshot_and_its_comparison_share_one_shuffle_per_side(t, no_broadcast):
    old, new = (snapshot.build_snapshot(d, "j", ["o_orderkey"], "2024-01-01") for d in (t.stale_orders, t.orders))
    assert count(snapshot.snapshot_diff(old, new), "Exchange") == 2


def test_top_lists_are_not_sorted_whole(t):
    assert "TakeOrderedAndProject" in plan(tasks.pending_queue(t.tasks))
    assert "TakeOrderedAndProject" in plan(history.history_filter(t.history, limit=5))


def test_statistics_are_reduced_before_the_projects_join(t, no_broadcast):
    text = plan(tasks.task_stats_by_project(t.tasks, t.projects))
    assert text.index("SortMergeJoin") < text.index("HashAggregate")


LAZY = [n for n in sorted(all_queries()) if not re.match(
    r"run_job|full_refresh|append_load|load_|merge_touched|export|save_snapshot|get_snapshot|stream|read_run_log|count_parity", n)]


@pytest.mark.parametrize("name", LAZY)
def test_no_plan_pairs_all_rows_or_leaves_the_jvm(spark, no_broadcast, name):
    text = plan(all_queries()[name](spark, FOLDER))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "ExistingRDD"):
        assert node not in text


def test_hot_groups_give_the_same_rows(spark):
    """A third of all rows share one key."""
    df = spark.range(0, 3000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"), (F.col("id") * 7).alias("v")
    )
    latest = {r.k: r.t for r in keys.latest_per_key(df, ["k"], ["t"]).collect()}
    assert latest == {0: 2997, **{i: i for i in range(3000) if i % 3}}
    before = {r.t: r.b and r.b.v for r in keys.previous_row(df, ["k"], ["t"], ["v"], "b").collect()}
    assert before == {i: (i - 3) * 7 if i % 3 == 0 and i else None for i in range(3000)}


def test_the_time_a_task_started_is_pushed_to_the_scan(t, tmp_path):
    t.tasks.select("task_id", "project_id", "status", "started_at", "error_message", "updated_at").write.parquet(f"{tmp_path}/tasks")
    stored = t.spark.read.parquet(f"{tmp_path}/tasks")
    for line in plan(tasks.stuck_running(stored, "2024-01-31 00:00:00")).splitlines():
        if "PushedFilters" in line:
            assert "LessThan(started_at" in line
            break
    else:
        raise AssertionError("no filter is pushed")


def test_touched_buckets_are_found_without_the_driver(t):
    import inspect

    from tablerelay.plans import publish

    text = inspect.getsource(publish.merge_touched)
    assert ".collect(" not in text and "isin(" not in text

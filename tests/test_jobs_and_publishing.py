from __future__ import annotations

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tablerelay.operators import incremental, state
from tablerelay.plans import guards, publish
from tablerelay.plans.job import read_states, run_job
from tablerelay.session import shared_folder
from tablerelay.spec import DeleteDetection, Incremental, JobSpec, Options

CLIENTS = "id int, name string, balance decimal(18,2), changed timestamp_ntz"


def clients(spark, *entries):
    df = spark.createDataFrame([(i, n, str(b), c) for i, n, b, c in entries], "id int, name string, balance string, changed string")
    return df.select(
        "id", "name", F.col("balance").cast("decimal(18,2)").alias("balance"),
        F.col("changed").cast("timestamp_ntz").alias("changed"),
    )


FIRST = [
    (1, "Juan Pérez", 1500.00, "2025-01-01 10:00:00"),
    (2, "María García", 2300.50, "2025-01-02 10:00:00"),
    (3, "Carlos López", 890.25, "2025-01-02 10:00:00"),
]


@pytest.fixture
def place(spark):
    table = f"t_{uuid.uuid4().hex}"
    yield table, shared_folder(spark, "test")
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def run(spark, place, source, how, as_of="2025-02-01 00:00:00", **more):
    table, folder = place
    job = JobSpec("clients", source, table, folder, more.pop("keys", ["id"]), more.pop("mappings", None), how, **more)
    return run_job(spark, job, f"{folder}/states", as_of)


def names(spark, place):
    return {r[0]: r[1] for r in spark.table(place[0]).select("id", "name").collect()}


def test_incremental_runs_equal_one_full_refresh(spark, place):
    how = Incremental("timestamp", "CHANGED")
    assert run(spark, place, clients(spark, *FIRST), how).rows_read == 3
    later = [FIRST[0], (2, "María G.", 1, "2025-01-05 00:00:00"), FIRST[2], (4, "Ana", 2, "2025-01-06 00:00:00")]
    result = run(spark, place, clients(spark, *later), how)
    assert (result.rows_read, result.changes) == (2, {"INSERT": 1, "UPDATE": 1, "DELETE": 0})
    assert sorted(spark.table(place[0]).collect()) == sorted(clients(spark, *later).collect())


def test_an_empty_batch_keeps_the_mark_and_the_table(spark, place):
    how = Incremental("timestamp", "changed")
    run(spark, place, clients(spark, *FIRST), how)
    before = publish.table_location(spark, place[0])
    assert not run(spark, place, clients(spark, *FIRST), how).published
    assert publish.table_location(spark, place[0]) == before
    states = read_states(spark, f"{place[1]}/states")
    assert [str(r.last_sync_time) for r in state.last_success_state(states).collect()] == ["2025-01-02 10:00:00"]
    new = clients(spark, *FIRST, (9, "late", 1, "2025-01-02 10:00:01"))
    assert run(spark, place, new, how).rows_read == 1


def test_ties_with_the_mark_are_read_where_asked(spark, place):
    run(spark, place, clients(spark, *FIRST), Incremental("timestamp", "changed"))
    tied = clients(spark, *FIRST, (4, "tied", 1, "2025-01-02 10:00:00"))
    assert not run(spark, place, tied, Incremental("timestamp", "changed")).published
    assert run(spark, place, tied, Incremental("timestamp", "changed", inclusive=True)).rows_read == 3
    assert names(spark, place)[4] == "tied"


def test_a_forced_full_run_replaces_the_table(spark, place):
    run(spark, place, clients(spark, *FIRST), Incremental("timestamp", "changed"))
    run(spark, place, clients(spark, FIRST[1]), Incremental("timestamp", "changed", force_full=True))
    assert set(names(spark, place)) == {2}


def test_row_versions(spark, place):
    def source(*pairs):
        return spark.createDataFrame([(i, n, v.to_bytes(8, "big")) for i, n, v in pairs], "id int, name string, ver binary")

    how = Incremental("rowversion", "ver")
    run(spark, place, source((1, "a", 255), (2, "b", 256)), how)
    result = run(spark, place, source((1, "a", 255), (2, "B", 65536), (3, "c", 300)), how)
    assert result.rows_read == 2 and names(spark, place) == {1: "a", 2: "B", 3: "c"}
    assert not run(spark, place, source((1, "a", 255)), how).published
    assert run(spark, place, source((4, "d", 65537)), how).rows_read == 1
    with pytest.raises(ValueError, match="no row version"):
        incremental.incremental_rowversion(source((1, "a", 1)), "ver", None)


def test_mapping_may_drop_the_tracking_and_flag_columns(spark, place):
    how = Incremental("timestamp", "changed", merge="full", deletes=DeleteDetection("soft", "name", "gone"))
    pairs = [("id", "key"), ("balance", "amount")]
    run(spark, place, clients(spark, *FIRST), how, keys=["key"], mappings=pairs)
    later = [(1, "gone", 0, "2025-01-03 00:00:00"), FIRST[1], (5, "new", 5, "2025-01-04 00:00:00")]
    result = run(spark, place, clients(spark, *later), how, keys=["key"], mappings=pairs)
    found = {r["key"]: float(r["amount"]) for r in spark.table(place[0]).collect()}
    assert found == {2: 2300.5, 3: 890.25, 5: 5.0}
    assert result.changes == {"INSERT": 1, "UPDATE": 0, "DELETE": 1}


def test_full_merge_by_comparison_deletes_what_left(spark, place):
    how = Incremental("timestamp", "changed", merge="full", deletes=DeleteDetection.of("comparison"))
    run(spark, place, clients(spark, *FIRST), how)
    result = run(spark, place, clients(spark, FIRST[0], (7, "x", 1, "2025-01-09 00:00:00")), how)
    assert set(names(spark, place)) == {1, 7} and result.changes == {"INSERT": 1, "UPDATE": 0, "DELETE": 2}
    with pytest.raises(ValueError, match="empty"):
        run(spark, place, clients(spark, *FIRST).limit(0), how)


def test_snapshot_mode_reports_changes(spark, place):
    how = Incremental("snapshot")
    run(spark, place, clients(spark, *FIRST), how)
    later = clients(spark, FIRST[0], (2, "other", 1, "2025-01-02 10:00:00"), (8, "h", 1, "2020-01-01 00:00:00"))
    assert run(spark, place, later, how).changes == {"INSERT": 1, "UPDATE": 1, "DELETE": 1}
    assert set(names(spark, place)) == {1, 2, 8}
    with pytest.raises(guards.GuardError, match="empty"):
        run(spark, place, later.limit(0), how)


def test_insert_only_and_latest_copies(spark, place):
    copies = [*FIRST, (1, "newer", 1, "2025-01-01 11:00:00")]
    how = Incremental("timestamp", "changed", merge="insert_only", on_duplicate="latest")
    run(spark, place, clients(spark, *copies), how)
    assert names(spark, place)[1] == "newer"
    result = run(spark, place, clients(spark, (1, "ignored", 1, "2025-03-01 00:00:00"), (6, "six", 1, "2025-03-01 00:00:00")), how)
    assert names(spark, place)[1] == "newer" and result.changes == {"INSERT": 1, "UPDATE": 0, "DELETE": 0}
    with pytest.raises(ValueError, match="more than once"):
        run(spark, place, clients(spark, *[(9, "n", 1, "2025-04-01 00:00:00")] * 2), Incremental("timestamp", "changed"))


def test_bucketed_jobs_rewrite_only_touched_buckets(spark, place):
    bucket = "pmod(id, 4)"
    how = Incremental("timestamp", "changed")
    run(spark, place, clients(spark, *FIRST), how, bucket=bucket)
    folder = publish.table_location(spark, place[0]).removeprefix("file:")
    untouched = sorted(os.listdir(f"{folder}/_bucket=1"))
    result = run(spark, place, clients(spark, *FIRST, (2, "two", 1, "2025-05-01 00:00:00")).where("name <> 'María García'"), how, bucket=bucket)
    assert result.rows_read == 1 and names(spark, place) == {1: "Juan Pérez", 2: "two", 3: "Carlos López"}
    assert sorted(os.listdir(f"{folder}/_bucket=1")) == untouched
    with pytest.raises(Exception, match="name"):
        publish.merge_touched(spark, folder, clients(spark, *FIRST), ["id"], "length(name)")


def test_buckets_keep_their_type_and_null_bucket(spark):
    path = shared_folder(spark, "text-buckets")
    make = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    bucket = "substring(k, 1, 2)"
    publish.write_bucketed(make(("01a", 1), ("01b", 2), ("1a", 3), (None, 4)), path, bucket)
    assert publish.merge_touched(spark, path, make(("01a", 9), (None, 5)), ["k"], bucket) == 4
    rows = spark.read.parquet(path).select("k", "v").collect()
    assert sorted(map(tuple, rows), key=str) == [("01a", 9), ("01b", 2), ("1a", 3), (None, 4), (None, 5)]
    assert publish.merge_touched(spark, path, make(), ["k"], bucket) == 0


def test_jobs_name_columns_that_do_not_exist(spark, place):
    for how, more in (
        (Incremental("timestamp", "nope"), {}),
        (Incremental("timestamp", "changed", merge="full", deletes=DeleteDetection("soft", "nope")), {}),
        (Incremental("timestamp", "changed"), {"keys": ["nope"]}),
        (Incremental("timestamp", "changed"), {"mappings": [("nope", "id")]}),
    ):
        with pytest.raises(ValueError, match="nope"):
            run(spark, place, clients(spark, *FIRST), how, **more)


def test_guards_leave_the_table_as_it_was(spark, place):
    full = Incremental("full")
    run(spark, place, clients(spark, *FIRST), full)
    before = publish.table_location(spark, place[0])
    few = clients(spark, FIRST[0])
    with pytest.raises(guards.GuardError, match="minimum of 2"):
        run(spark, place, few, full, options=Options(min_rows=2))
    assert not run(spark, place, few, full, options=Options(min_rows=2, skip=True)).published
    assert publish.table_location(spark, place[0]) == before and len(names(spark, place)) == 3
    assert run(spark, place, few, full, options=Options(min_rows=2, force=True, skip=True)).published
    assert names(spark, place) == {1: "Juan Pérez"}


def test_full_jobs_append_and_limit(spark, place):
    run(spark, place, clients(spark, *FIRST), Incremental("full"))
    run(spark, place, clients(spark, *FIRST), Incremental("full"), options=Options(append=True, top=2))
    assert spark.table(place[0]).count() == 5


def test_a_load_that_died_before_the_flip_changes_nothing(spark, place):
    table, folder = place
    publish.full_refresh_swap(clients(spark, *FIRST), table, folder)
    broken = clients(spark, *FIRST).withColumn("name", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        publish.full_refresh_swap(broken, table, folder)
    assert spark.table(table).count() == 3


def test_swap_equals_rewrite_and_old_readers_keep_their_files(spark, place):
    table, folder = place
    publish.full_refresh_swap(clients(spark, *FIRST), table, folder)
    reader = spark.table(table)
    publish.full_refresh_swap(clients(spark, FIRST[0]), table, folder)
    assert (reader.count(), spark.table(table).count()) == (3, 1)
    publish.full_refresh_rewrite(clients(spark, *FIRST), table)
    assert sorted(spark.table(table).collect()) == sorted(clients(spark, *FIRST).collect())


def test_old_versions_are_dropped_but_never_the_published_one(spark, place):
    table, folder = place
    for version in ("a", "b", "c", "d"):
        publish.full_refresh_swap(clients(spark, *FIRST), table, folder, version=version)
    publish.flip(spark, table, publish.version_path(folder, "a"))
    assert sorted(publish.drop_old_versions(spark, table, folder, keep=2)) == ["v=b"]
    assert spark.table(table).count() == 3


def test_loads_are_split_into_batches(spark):
    path = shared_folder(spark, "batches")
    load = publish.load_partitioned(spark.range(0, 1000, 1, 8), path, batch_rows=100, writers=2)
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert load.rows == 1000 and len(files) in (10, 11)  # the two writers share the rows out nearly evenly
    with pytest.raises(guards.GuardError, match="999"):
        publish.read_load(spark, publish.Load(path, 999, {}))


def test_watermarks_ignore_null_and_keep_the_previous(spark):
    df = clients(spark, *FIRST).withColumn("changed", F.lit(None).cast("timestamp_ntz"))
    kept = incremental.max_watermark_ts(df, "changed", "2025-01-01 00:00:00").head()[0]
    assert str(kept) == "2025-01-01 00:00:00"
    with pytest.raises(ValueError, match="does not exist"):
        incremental.max_watermark_ts(df, "nope")
    assert incremental.incremental_timestamp(df, "changed", "2000-01-01").count() == 0


def test_validation_counts(spark):
    df = spark.createDataFrame(
        [(1, "5", 1), (1, " +7 ", None), (None, "x", 2), (2, "9" * 30, 3), (3, None, 4), (4, "1.5", 5)],
        "id int, number string, t int",
    )
    found = guards.validate_source(df, ["ID"], "t", {"number": "bigint"}).head().asDict()
    assert found == {"row_count": 6, "null_key_rows": 1, "duplicate_keys": 1, "null_tracking_rows": 1, "failed_cast_rows": 3}
    empty = guards.validate_source(df.limit(0), ["id"], "t").head()
    assert tuple(empty) == (0, 0, 0, 0, 0)


def test_specs_are_checked(spark):
    source = spark.range(1)
    for build in (
        lambda: Options(batch_rows=0), lambda: Options(writers=0), lambda: Options(min_rows=-1),
        lambda: Options(empty="x"), lambda: Options(keep_versions=1), lambda: Incremental("nope"),
        lambda: Incremental("timestamp"), lambda: Incremental(merge="nope"),
        lambda: Incremental("timestamp", "t", merge="full"),
        lambda: Incremental("timestamp", "t", deletes=DeleteDetection("comparison")), lambda: DeleteDetection("soft"),
        lambda: DeleteDetection("autodetect"), lambda: JobSpec(" ", source, "t", "f"),
        lambda: JobSpec("j", source, "t", "f", incremental=Incremental("snapshot")),
        lambda: JobSpec("j", source, "t", "f", ["id"], bucket="id"),
    ):
        with pytest.raises(ValueError):
            build()
    assert DeleteDetection.of({"mode": "soft", "column": "c", "value": 1}).column == "c"


class Unset:
    """A session on a cluster that names no shared folder."""

    conf = sparkContext = None

    def __init__(self, master):
        self.conf = self.sparkContext = self
        self.master = master

    def get(self, key, default):
        return default


def test_a_cluster_must_name_its_shared_folder(spark):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert "tablerelay" in shared_folder(Unset("local[2]"), "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Unset("yarn"), "x")


def test_rows_without_a_tracking_value_are_counted_and_not_read_again(spark, place):
    how = Incremental("timestamp", "changed")
    source = clients(spark, *FIRST, (9, "unstamped", 1, None))
    assert run(spark, place, source, how).untracked == 1
    assert not run(spark, place, source, how).published
    filled = incremental.backfill_tracking(source, "changed", "2025-06-01 00:00:00")
    assert run(spark, place, filled, how).rows_read == 1


def test_a_limited_run_reads_the_oldest_first(spark, place):
    newest_first = clients(spark, *[(i, f"c{i}", i, f"2025-01-{28 - i:02d} 00:00:00") for i in range(20)])
    how = Incremental("timestamp", "changed")
    reads = [run(spark, place, newest_first, how, options=Options(top=8)).rows_read for _ in range(3)]
    assert reads == [8, 8, 4] and len(names(spark, place)) == 20
    with pytest.raises(ValueError, match="top"):
        run(spark, place, newest_first, Incremental("full"), options=Options(top=3))
    with pytest.raises(ValueError, match="snapshot"):
        run(spark, place, newest_first, Incremental("snapshot"), options=Options(append=True))


def _folders(place):
    base = place[1].removeprefix("file:")
    return sorted(d for root in (base, f"{base}/stage") if os.path.isdir(root) for d in os.listdir(root) if d.startswith("v="))


def test_stages_and_refused_loads_are_removed(spark, place):
    how = Incremental("timestamp", "changed")
    run(spark, place, clients(spark, *FIRST), how)
    shown = _folders(place)
    assert len(shown) == 1
    assert not run(spark, place, clients(spark, *FIRST), how).published
    for source, options in ((clients(spark, *FIRST), Options(min_rows=9, empty="guard")), (clients(spark, *FIRST, *FIRST), Options())):
        forced = Incremental("timestamp", "changed", force_full=True)
        with pytest.raises((guards.GuardError, ValueError)):
            run(spark, place, source, forced, options=options)
    assert _folders(place) == shown


def test_new_rows_are_added_without_touching_the_others(spark, place):
    how = Incremental("timestamp", "changed", merge="insert_only")
    run(spark, place, clients(spark, *FIRST), how)
    folder = publish.table_location(spark, place[0]).removeprefix("file:")
    before = {f: os.stat(f"{folder}/{f}").st_mtime_ns for f in os.listdir(folder) if f.endswith(".parquet")}
    result = run(spark, place, clients(spark, *FIRST, (1, "again", 1, "2025-06-01 00:00:00"), (8, "new", 1, "2025-06-01 00:00:00")), how)
    assert result.changes == {"INSERT": 1, "UPDATE": 0, "DELETE": 0}
    assert publish.table_location(spark, place[0]).removeprefix("file:") == folder
    after = {f: os.stat(f"{folder}/{f}").st_mtime_ns for f in os.listdir(folder) if f.endswith(".parquet")}
    assert before.items() <= after.items() and names(spark, place)[1] == "Juan Pérez" and 8 in names(spark, place)


def test_inserts_into_buckets(spark, place):
    how = Incremental("timestamp", "changed", merge="insert_only")
    run(spark, place, clients(spark, *FIRST), how, bucket="pmod(id, 4)")
    result = run(spark, place, clients(spark, *FIRST, (1, "again", 1, "2025-06-01 00:00:00"), (8, "new", 1, "2025-06-01 00:00:00")), how, bucket="pmod(id, 4)")
    assert result.changes == {"INSERT": 1, "UPDATE": 0, "DELETE": 0} and names(spark, place)[1] == "Juan Pérez" and names(spark, place)[8] == "new"


def test_writers_do_not_squeeze_what_comes_before(spark):
    path = shared_folder(spark, "writers")
    publish.load_partitioned(spark.range(0, 1000, 1, 8).withColumn("p", F.spark_partition_id()), path, writers=2)
    assert spark.read.parquet(path).select("p").distinct().count() == 8
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 2


def bucket_files(spark, table):
    return {p.split("_bucket=")[1].split("/")[0]: p.rsplit("/", 2)[0] for p in spark.table(table).inputFiles()}


BY_TIME = Incremental("timestamp", "changed")
FULL = Incremental("timestamp", "changed", merge="full", deletes=DeleteDetection.of("comparison"))


def test_a_reader_in_between_sees_old_buckets(spark, place):
    table, _ = place
    run(spark, place, clients(spark, *FIRST), BY_TIME, bucket="pmod(id, 4)")
    before, reader = bucket_files(spark, table), spark.table(table)
    reader.inputFiles()
    later = clients(spark, FIRST[0], (2, "two", 1, "2025-05-01 00:00:00"), FIRST[2], (5, "five", 1, "2025-05-01 00:00:00"), (4, "four", 1, "2025-05-02 00:00:00"))
    result = run(spark, place, later, BY_TIME, bucket="pmod(id, 4)")
    assert result.changes == {"INSERT": 2, "UPDATE": 1, "DELETE": 0}
    after = bucket_files(spark, table)
    assert after["3"] == before["3"] and after["2"] != before["2"] and after["1"] != before["1"] and set(after) == {"0", "1", "2", "3"}
    old = spark.read.parquet(*[f"{p}/_bucket={b}" for b, p in before.items()])
    assert {r["id"]: r["name"] for r in old.collect()} == {1: "Juan Pérez", 2: "María García", 3: "Carlos López"}
    assert names(spark, place) == {1: "Juan Pérez", 2: "two", 3: "Carlos López", 4: "four", 5: "five"}


def test_full_merges_by_bucket_digests_leave_equal_buckets_alone(spark, place):
    table, folder = place
    rows = [(i, f"n{i}", 1, "2025-01-01 00:00:00") for i in range(40)]
    run(spark, place, clients(spark, *rows), FULL, bucket="pmod(id, 8)")
    before = bucket_files(spark, table)
    gone = [r for r in rows if r[0] not in (3, 11)] + [(48, "new", 1, "2025-02-01 00:00:00"), (4, "changed", 1, "2025-02-01 00:00:00")]
    result = run(spark, place, clients(spark, *[r for r in gone if r[:2] != (4, "n4")]), FULL, bucket="pmod(id, 8)")
    assert result.changes == {"INSERT": 1, "UPDATE": 1, "DELETE": 2}
    after = bucket_files(spark, table)
    assert {b for b in before if before[b] != after.get(b)} == {"0", "3", "4"}
    assert set(names(spark, place)) == set(range(40)) - {3, 11} | {48}
    # A bucket that loses all its rows leaves the catalog.
    left = clients(spark, *[r for r in rows if r[0] % 8 != 5])
    run(spark, place, left, FULL, bucket="pmod(id, 8)")
    assert "5" not in bucket_files(spark, table) and spark.table(table).count() == 33
    with pytest.raises(ValueError, match="empty"):
        run(spark, place, left.limit(0), FULL, bucket="pmod(id, 8)")
    with pytest.raises(ValueError, match="bucketed by"):
        run(spark, place, left, FULL, bucket="pmod(id, 9)")


def test_full_merges_by_flag_in_buckets(spark, place):
    how = Incremental("timestamp", "changed", merge="full", deletes=DeleteDetection("soft", "name", "gone"))
    rows = [(i, f"n{i}", 1, "2025-01-01 00:00:00") for i in range(16)]
    run(spark, place, clients(spark, *rows), how, bucket="pmod(id, 4)")
    before = bucket_files(spark, place[0])
    later = [(5, "gone", 1, "2025-01-01 00:00:00"), (6, "gone", 1, "2025-02-01 00:00:00"), (99, "gone", 1, "2025-02-01 00:00:00")]
    result = run(spark, place, clients(spark, *later), how, bucket="pmod(id, 4)")
    assert set(names(spark, place)) == set(range(16)) - {5, 6} and result.changes["DELETE"] == 2
    after = bucket_files(spark, place[0])
    assert {b for b in before if before[b] != after[b]} == {"1", "2"}


def test_a_run_that_dies_while_it_shows_buckets_is_carried_on(spark, place, monkeypatch):
    from tablerelay.plans import buckets

    table, folder = place
    rows = [(i, f"n{i}", 1, "2025-01-01 00:00:00") for i in range(16)]
    run(spark, place, clients(spark, *rows), FULL, bucket="pmod(id, 4)")
    later = clients(spark, *[(i, "later", 1, "2025-02-01 00:00:00") for i in range(14) if i % 4 != 3])

    def half(spark, table, layout, before):
        name = next(n for n, b in layout.buckets.items() if before.buckets[n].location != b.location)
        spark.sql(f"ALTER TABLE {table} {buckets._partition(name)} SET LOCATION '{layout.buckets[name].location}'")
        raise OSError("the driver is lost")

    with monkeypatch.context() as patch:
        patch.setattr(buckets, "_show", half)
        with pytest.raises(OSError):
            run(spark, place, later, FULL, bucket="pmod(id, 4)")
    run(spark, place, later, FULL, bucket="pmod(id, 4)")
    assert names(spark, place) == {i: "later" for i in range(14) if i % 4 != 3}

    def unwritten(spark, folder, layout):
        raise OSError("no layout")

    before = sorted(os.listdir(folder.removeprefix("file:")))
    with monkeypatch.context() as patch:
        patch.setattr(buckets, "_write_layout", unwritten)
        with pytest.raises(OSError):
            run(spark, place, clients(spark, *rows), Incremental("timestamp", "changed", force_full=True), bucket="pmod(id, 4)")
    assert sorted(os.listdir(folder.removeprefix("file:"))) == before and spark.table(table).count() == 11


def test_buckets_with_odd_names_and_the_null_bucket_in_jobs(spark, place):
    make = lambda *rows: spark.createDataFrame(list(rows), "k string, v int, changed string").withColumn("changed", F.col("changed").cast("timestamp_ntz"))
    at = lambda day: f"2025-01-{day:02d} 00:00:00"
    for day, rows in ((1, [("01a", 1, at(1)), ("01b", 2, at(1)), ("1a", 3, at(1)), (None, 4, at(1)), ("a'/b", 5, at(1)), ("a'%c", 6, at(1))]),
                      (2, [("01a", 9, at(2)), (None, 7, at(2)), ("a'/b", 8, at(2)), ("", 10, at(2))])):
        run(spark, place, make(*rows), BY_TIME, keys=["k"], bucket="substring(k, 1, 3)", as_of=f"2025-03-0{day} 00:00:00")
    found = sorted(map(tuple, spark.table(place[0]).select("k", "v").collect()), key=str)
    assert found == sorted([("01a", 9), ("01b", 2), ("1a", 3), (None, 4), (None, 7), ("a'/b", 8), ("a'%c", 6), ("", 10)], key=str)


def test_old_layouts_go_with_the_buckets_that_only_they_name(spark, place):
    table, folder = place
    for day in range(1, 7):
        run(spark, place, clients(spark, (1, f"one {day}", 1, f"2025-03-{day:02d} 00:00:00"), (2, "two", 1, "2025-03-01 00:00:00")), BY_TIME,
            as_of=f"2025-04-{day:02d} 00:00:00", bucket="pmod(id, 2)")
    root = folder.removeprefix("file:")
    assert len(os.listdir(f"{root}/layouts")) == 2 and names(spark, place) == {1: "one 6", 2: "two"}
    kept = [p for p in os.listdir(root) if p.startswith("v=")]
    assert len(kept) == 3  # the untouched bucket's, the last and the one before


def failing(*_, **__):
    raise OSError("no more")


@pytest.mark.parametrize("step", ["save_snapshot", "flip", "_take_snapshot", "_record_state", "drop_old_versions"])
def test_a_failed_snapshot_run_never_loses_the_published_table(spark, place, monkeypatch, step):
    from tablerelay.plans import job as jobs

    run(spark, place, clients(spark, *FIRST), Incremental("snapshot"))
    later = clients(spark, *FIRST, (4, "Ana", 2, "2025-01-06 00:00:00"))
    with monkeypatch.context() as patch:
        patch.setattr(jobs, step, failing)
        with pytest.raises(OSError):
            run(spark, place, later, Incremental("snapshot"), as_of="2025-02-02 00:00:00")
    spark.catalog.refreshTable(place[0])
    shown = {1, 2, 3} if step in ("flip", "_take_snapshot") else {1, 2, 3, 4}
    assert set(names(spark, place)) == shown
    run(spark, place, later, Incremental("snapshot"), as_of="2025-02-03 00:00:00")
    assert set(names(spark, place)) == {1, 2, 3, 4}


@pytest.mark.parametrize("step", ["_merge_counts", "flip", "_record_state"])
def test_a_failed_merge_keeps_the_readers_version(spark, place, monkeypatch, step):
    from tablerelay.plans import job as jobs

    run(spark, place, clients(spark, *FIRST), BY_TIME)
    later = clients(spark, *FIRST, (4, "Ana", 2, "2025-01-06 00:00:00"))
    reader = spark.table(place[0])
    for _ in range(3):
        with monkeypatch.context() as patch:
            patch.setattr(jobs, step, failing)
            with pytest.raises(OSError):
                run(spark, place, later, BY_TIME, as_of="2025-02-02 00:00:00")
    assert step == "_record_state" or reader.count() == 3
    folders = [p for p in os.listdir(place[1].removeprefix("file:")) if p.startswith("v=")]
    assert step == "_record_state" or len(folders) == 1
    run(spark, place, later, BY_TIME, as_of="2025-02-03 00:00:00")
    assert set(names(spark, place)) == {1, 2, 3, 4}


@pytest.mark.parametrize("how", [Incremental("full"), Incremental("timestamp", "changed", merge="insert_only")])
@pytest.mark.parametrize("step", ["_record_state", "append_once"])
def test_a_repeated_append_adds_its_rows_once(spark, place, monkeypatch, how, step):
    from tablerelay.plans import job as jobs

    more = {"options": Options(append=True)} if how.mode == "full" else {}
    run(spark, place, clients(spark, *FIRST), how, **more)
    new = clients(spark, (7, "x", 1, "2025-03-01 00:00:00"), (None, "no key", 1, "2025-03-01 00:00:00"))
    real = publish.append_once

    def dies(*given):
        real(*given)
        raise OSError("after the append")

    for _ in range(2):
        with monkeypatch.context() as patch:
            patch.setattr(jobs, step, failing if step == "_record_state" else dies)
            with pytest.raises(OSError):
                run(spark, place, new, how, as_of="2025-03-02 00:00:00", **more)
    run(spark, place, new, how, as_of="2025-03-02 00:00:00", **more)
    assert sorted(r["name"] for r in spark.table(place[0]).collect()) == sorted([*(n[1] for n in FIRST), "x", "no key"])
    root = publish.table_location(spark, place[0]).removeprefix("file:")
    assert len(os.listdir(f"{root}/_runs")) >= 1 and not [p for p in os.listdir(root) if p.startswith("_stage")]
    if how.mode == "full":  # the next run of the job is another one, and adds again
        run(spark, place, new, how, as_of="2025-03-03 00:00:00", **more)
        assert spark.table(place[0]).count() == 7


def test_unshown_versions_do_not_push_out_those_that_readers_use(spark, place):
    table, folder = place
    for version in ("a", "b"):
        publish.full_refresh_swap(clients(spark, *FIRST), table, folder, version=version)
    for version in ("aa", "ab", "c"):
        clients(spark, FIRST[0]).write.parquet(publish.version_path(folder, version))
    assert sorted(publish.drop_old_versions(spark, table, folder, keep=2)) == ["v=aa", "v=ab"]


def test_the_state_log_stays_small_and_readers_keep_their_files(spark, place, monkeypatch):
    from tablerelay.plans import job as jobs

    monkeypatch.setattr(jobs, "STATE_FILES", 3)
    monkeypatch.setattr(jobs.compact_states, "__defaults__", (3, 0))
    path = f"{place[1]}/states"
    for day in range(1, 10):
        early = read_states(spark, path)
        run(spark, place, clients(spark, (1, f"one {day}", 1, f"2025-03-{day:02d} 00:00:00")), BY_TIME)
        assert early.count() == day - 1  # listed before the run, read after it
    assert read_states(spark, path).count() == 9
    assert len(jobs._state_files(spark, path)[0]) <= 4
    last = state.last_success_state(read_states(spark, path)).collect()  # all runs are of one time
    assert [(str(r.last_sync_time), r.run_number) for r in last] == [("2025-03-09 00:00:00", 9)]


def test_a_large_state_log_becomes_one_table_of_many_tasks(spark, tmp_path, monkeypatch):
    from tablerelay.plans import job as jobs

    monkeypatch.setattr(jobs, "STATE_BYTES", 60_000, raising=False)
    path, tables = str(tmp_path / "day=1" / "states"), []
    runs = spark.range(20_000).select(
        F.concat(F.lit("job"), F.col("id") % 7).alias("job_identifier"), F.lit(True).alias("success"),
        F.lit("2025-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"), F.col("id").alias("run_number"))
    unnamed = runs.limit(1).withColumn("job_identifier", F.lit(None).cast("string")).withColumn("run_number", F.lit(None).cast("bigint"))
    runs.unionByName(unnamed).repartition(5).write.parquet(path)
    for seen in (1, 2):  # the second time a table is among the files, and a state stands twice
        for file in range(4 * (seen - 1)):
            runs.where(F.col("run_number") == file).coalesce(1).write.mode("append").parquet(path)
        assert jobs.compact_states(spark, path, 4, 0)
        assert not jobs.compact_states(spark, path, 4, 0)  # takes away what was replaced, and is not made again
        [table], notes = jobs._state_files(spark, path)
        tables.append(table.getName())
        held = read_states(spark, path).groupBy(F.input_file_name()).count().collect()
        assert len(held) > 1 and max(r["count"] for r in held) < 15_000 and not notes
        assert sorted(p.name for p in (tmp_path / "day=1" / "states").glob("[!_.]*")) == [table.getName()]
        states = read_states(spark, path)
        assert states.count() == 20_001 == states.distinct().count()
        last = {r.job_identifier: r.run_number for r in state.last_success_state(states).collect()}
        assert last == {None: None} | {f"job{(20_000 - n) % 7}": 20_000 - n for n in range(1, 8)}
    assert tables[0] != tables[1]


def test_a_table_of_states_that_was_not_finished_loses_nothing(spark, tmp_path):
    from tablerelay.plans import job as jobs

    path, runs = str(tmp_path / "states"), spark.range(10).select(F.lit("j").alias("job_identifier"), F.col("id").alias("run_number"))
    runs.repartition(3).write.parquet(path)
    runs.limit(4).write.parquet(f"{path}/compact-part.parquet")
    (tmp_path / "states" / "compact-begun.parquet" / "_temporary").mkdir(parents=True)
    assert read_states(spark, path).distinct().count() == 10
    assert jobs.compact_states(spark, path, 4, 0)
    assert [r.run_number for r in read_states(spark, path).orderBy("run_number").collect()] == list(range(10))


def test_a_forced_full_run_at_the_same_time_sets_the_mark_back(spark, place):
    run(spark, place, clients(spark, *FIRST), BY_TIME)
    run(spark, place, clients(spark, FIRST[0]), Incremental("timestamp", "changed", force_full=True))
    run(spark, place, clients(spark, *FIRST), BY_TIME)
    assert set(names(spark, place)) == {1, 2, 3}


def test_few_row_groups_of_a_clustered_source_are_read(spark):
    path = shared_folder(spark, "clustered")
    rows = spark.range(0, 400_000, 1, 8).select(
        (F.col("id") * 7919 % 400_000).alias("k"), F.when(F.col("id") % 11 > 0, F.col("id") * 7919 % 400_000 % 100_000).alias("t"), F.xxhash64("id").alias("x")
    )
    load = publish.load_clustered(rows, path, "T", row_group_bytes=1 << 16, figures={"most": F.max("t")})
    assert (load.rows, load.figures) == (400_000, {"most": 99_999})
    stored = publish.read_load(spark, load)
    new = stored.where(F.col("t") > 99_000)
    want = rows.where("t > 99000").count()
    assert len(new.collect()) == want
    scan = new._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() < 0.1 * load.rows
    assert rows.where("t is null").count() == stored.where("t is null").count()
    # Rows of one value are spread over files.
    same = publish.load_clustered(rows.withColumn("t", F.lit(1)), shared_folder(spark, "same"), "t")
    sizes = spark.read.parquet(same.path).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1


@pytest.mark.parametrize("n", [1, 1000, 3999, 5000])
def test_the_oldest_rows_are_those_up_to_a_rank(spark, n):
    rows = spark.range(0, 4000, 1, 6).select((F.col("id") * 7 % 1300).alias("t"), "id").unionByName(spark.range(3).select(F.lit(None).cast("bigint").alias("t"), "id"))
    values = sorted(k * 7 % 1300 for k in range(4000))
    last = values[min(n, 4000) - 1]
    assert incremental.oldest_rows(rows, "T", n, untracked=False).count() == sum(v <= last for v in values)
    assert incremental.oldest_rows(rows, "t", n, untracked=True).count() == sum(v <= last for v in values) + 3
    assert incremental.oldest_rows(rows.where("t IS NULL"), "t", n, untracked=False).count() == 0


def test_buckets_that_lose_all_their_rows_and_no_other(spark, place):
    rows = [(i, f"n{i}", 1, "2025-01-01 00:00:00") for i in range(12)]
    run(spark, place, clients(spark, *rows), FULL, bucket="pmod(id, 4)")
    result = run(spark, place, clients(spark, *[r for r in rows if r[0] % 4 != 1]), FULL, bucket="pmod(id, 4)")
    assert result.changes == {"INSERT": 0, "UPDATE": 0, "DELETE": 3} and set(bucket_files(spark, place[0])) == {"0", "2", "3"}
    how = Incremental("timestamp", "changed", merge="full", deletes=DeleteDetection("comparison", allow_empty=True))
    result = run(spark, place, clients(spark, *rows).limit(0), how, bucket="pmod(id, 4)")
    assert result.changes == {"INSERT": 0, "UPDATE": 0, "DELETE": 9} and spark.table(place[0]).count() == 0
    result = run(spark, place, clients(spark, *[(i, n, b, "2025-02-01 00:00:00") for i, n, b, _ in rows]), FULL, bucket="pmod(id, 4)")
    assert result.changes == {"INSERT": 12, "UPDATE": 0, "DELETE": 0} and spark.table(place[0]).count() == 12

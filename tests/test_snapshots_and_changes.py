from __future__ import annotations

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tablerelay.functions.identity import job_identifier, row_hash, row_key, source_object_name
from tablerelay.operators import changes, snapshot
from tablerelay.session import shared_folder


def one(spark, column):
    return spark.range(1).select(column).head()[0]


def sha(text):
    return base64.b64encode(hashlib.sha256(text.encode()).digest()).decode()


def test_row_hash_encodings(spark):
    one_null = [F.lit(1), F.lit(None).cast("string")]
    assert one(spark, row_hash(one_null, "compat")) == sha("1|NULL|")
    assert one(spark, row_hash([F.lit(1), F.lit("NULL")], "compat")) == sha("1|NULL|")
    assert one(spark, row_hash(one_null)) != one(spark, row_hash([F.lit(1), F.lit("NULL")]))
    assert one(spark, row_hash([F.lit("a|"), F.lit("b")])) != one(spark, row_hash([F.lit("a"), F.lit("|b")]))
    with pytest.raises(ValueError, match="encoding"):
        row_hash(one_null, "other")


def test_row_key_keeps_nulls(spark):
    assert one(spark, row_key([F.lit(1), F.lit(None), F.lit("x")], "compat")) == "1||NULL||x"
    assert one(spark, row_key([F.lit(1), F.lit(None), F.lit("x")])) == "1||\\N||x"


def test_different_keys_stay_apart(spark):
    pairs = [("a||b", "c"), ("a", "b||c"), ("a|", "|b"), ("a", "||b"), ("\\N", "x"), (None, "x"), ("a\\", "b"), ("a", "\\b"), ("a\\|", "b")]
    df = spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)], "k string, l string, v int")
    assert df.select(row_key([F.col("k"), F.col("l")])).distinct().count() == len(pairs)
    assert snapshot.build_snapshot(df, "j", ["k", "l"], "2024-01-01").count() == len(pairs)
    changed = snapshot.snapshot_changes(df, df.withColumn("v", F.col("v") + 1), ["k", "l"])
    assert changed.count() == len(pairs) and {r.change_type for r in changed.collect()} == {"UPDATE"}


def test_hashes_tell_microseconds_apart_in_any_zone(spark):
    at = lambda text: F.struct(F.array(F.lit(text).cast("timestamp_ntz")))
    assert one(spark, row_hash([at("2024-01-01 00:00:00.000001")])) != one(spark, row_hash([at("2024-01-01 00:00:00.000002")]))
    zoned, own = [F.timestamp_micros(F.lit(1_700_000_000_000_001))], spark.conf.get("spark.sql.session.timeZone")
    found = []
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        found.append(one(spark, row_hash(zoned)))
    spark.conf.set("spark.sql.session.timeZone", own)
    assert found[0] == found[1]


def test_job_ids_are_text_whatever_they_look_like(spark):
    path = shared_folder(spark, "ids")
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    for job in ("007", "2024-01-01", "1e3"):
        snapshot.save_snapshot(snapshot.build_snapshot(df, job, ["k"], "2024-01-01"), path)
    for job in ("007", "2024-01-01", "1e3"):
        assert [r.job_id for r in snapshot.get_snapshot(spark, path, job).collect()] == [job]


def test_a_delete_is_reported_once(spark):
    a, b = (snapshot.build_snapshot(spark.createDataFrame(rows, "k int, v int"), "j", ["k"], "2024-01-01") for rows in ([(1, 1), (2, 2)], [(1, 1)]))
    kept = snapshot.snapshot_merge_seen(a, b, "2024-01-02")
    assert [r.change_type for r in snapshot.snapshot_diff(a, b).collect()] == ["DELETE"]
    assert snapshot.snapshot_diff(kept, b).collect() == []
    assert [tuple(r) for r in snapshot.snapshot_diff(kept, a).collect()] == [("2", "INSERT")]


def test_identifiers(spark):
    query = F.lit("select * from [srv].[dbo].[Clientes] c where x = 1")
    assert one(spark, source_object_name(query)) == "srv.dbo.Clientes"
    assert one(spark, source_object_name(F.lit("select 1\nfrom [my db] . [a-b].\"t 1\" where x"))) == "my db.a-b.t 1"
    assert one(spark, source_object_name(F.lit("select 1 from `cat`.`t x`"))) == "cat.t x"
    assert one(spark, source_object_name(F.lit("EXEC something"))) == "UnknownSource"
    assert one(spark, source_object_name(F.lit(None).cast("string"))) == "UnknownSource"
    parts = [F.lit(v) for v in ("SQL.2008", "DB", "dbo.Vista", "SQL2022", "Propia", "[dbo].[Cliente]")]
    assert one(spark, job_identifier(*parts)) == "SQL_2008_DB_dbo_Vista_TO_SQL2022_Propia_dbo_Cliente"


def test_diff_applied_to_the_old_gives_the_new(spark):
    rng = random.Random(11)
    old = {k: rng.randint(0, 3) for k in rng.sample(range(40), 25)}
    new = {k: rng.randint(0, 3) for k in rng.sample(range(40), 25)}
    a, b = (spark.createDataFrame(list(d.items()), "k int, v int") for d in (old, new))
    found = {r["k"]: (r["v"], r["change_type"]) for r in snapshot.snapshot_changes(a, b, ["k"]).collect()}
    applied = dict(old)
    for key, (value, kind) in found.items():
        if kind == "DELETE":
            del applied[key]
        else:
            assert (key in old) == (kind == "UPDATE")
            applied[key] = value
    assert applied == new
    sa, sb = (snapshot.build_snapshot(d, "j", ["K"], "2024-01-01 00:00:00") for d in (a, b))
    kinds = {r["pk_value"]: r["change_type"] for r in snapshot.snapshot_diff(sa, sb).collect()}
    assert kinds == {str(k): kind for k, (_, kind) in found.items()}


def test_seen_times_follow_a_key_through_runs(spark):
    def taken(day, *pairs):
        df = spark.createDataFrame(list(pairs), "k int, v string")
        return snapshot.build_snapshot(df, "j", ["k"], day)

    first, second = "2024-01-01 00:00:00", "2024-01-02 00:00:00"
    merged = snapshot.snapshot_merge_seen(
        taken(first, (1, "a"), (2, "b"), (3, "c")), taken(second, (1, "a"), (2, "B"), (4, "d")), second
    )
    rows = {r.pk_value: (r.change_type, r.first_seen.day, r.last_seen.day) for r in merged.collect()}
    assert rows == {"1": ("UNCHANGED", 1, 2), "2": ("UPDATE", 1, 2), "3": ("DELETE", 1, 1), "4": ("INSERT", 2, 2)}
    assert snapshot.retention_snapshots(merged, "2024-01-03 00:00:00", 1).count() == 3


def test_saving_one_job_leaves_others(spark):
    path = shared_folder(spark, "snap")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    snapshot.save_snapshot(snapshot.build_snapshot(df, "7", ["k"], "2024-01-01"), path)
    snapshot.save_snapshot(snapshot.build_snapshot(df, "x", ["k"], "2024-01-01"), path)
    snapshot.save_snapshot(snapshot.build_snapshot(df.where("k = 1"), "7", ["k"], "2024-01-02"), path)
    assert snapshot.get_snapshot(spark, path, "7").count() == 1
    assert snapshot.get_snapshot(spark, path, "x").count() == 2


def test_snapshot_hash_ignores_order_but_not_content(spark):
    df = spark.createDataFrame([(i, i * 2) for i in range(50)], "k int, v int")
    build = lambda d: snapshot.snapshot_metadata(snapshot.build_snapshot(d, "j", ["k"], "2024-01-01")).head().snapshot_hash
    assert build(df) == build(df.orderBy(F.col("k").desc()).repartition(5))
    assert build(df) != build(df.withColumn("v", F.when(F.col("k") == 7, 0).otherwise(F.col("v"))))


def test_changes_in_any_order(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "pk int, v string")
    feed = [(2, 1, "U", "b1"), (2, 2, "D", None), (4, 1, "I", "d"), (5, 1, "I", "e"), (5, 2, "D", None),
            (5, 3, "I", "E"), (None, 1, "I", "lost"), (3, 9, None, "c9")]
    random.Random(1).shuffle(feed)
    df = spark.createDataFrame(feed, "pk int, version int, op string, v string")
    result = changes.apply_changes(target, df, ["PK"], "Version", "OP")
    assert sorted(map(tuple, result.collect())) == [(1, "a"), (3, "c9"), (4, "d"), (5, "E")]


def test_feeds_that_do_not_say_what_happened_fail(spark):
    target = spark.createDataFrame([(1, "a")], "pk int, v string")
    schema = "pk int, version int, seq int, op string, v string"
    unknown = spark.createDataFrame([(1, 1, 1, "DEL", None)], schema)
    with pytest.raises(Exception, match="unknown operation"):
        changes.apply_changes(target, unknown, ["pk"], "version", "op").collect()
    twice = spark.createDataFrame([(1, 1, 1, "I", "b"), (1, 1, 2, "D", None), (1, 0, 9, "U", "z")], schema)
    with pytest.raises(Exception, match="one age"):
        changes.apply_changes(target, twice, ["pk"], "version", "op").collect()
    assert changes.apply_changes(target, twice, ["pk"], "version", "op", then=["seq"]).collect() == []
    same = twice.where("seq <> 2").unionByName(twice.where("seq = 1"))
    assert [tuple(r) for r in changes.apply_changes(target, same, ["pk"], "version", "op").collect()] == [(1, "b")]


def test_change_history_names_both_values(spark):
    feed = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "x")], "pk int, version int, v string")
    rows = sorted(map(tuple, changes.change_history(feed, ["pk"], "version", ["v"]).collect()))
    assert rows == [(1, 1, None, "a"), (1, 2, "a", "b"), (2, 1, None, "x")]


def test_a_stored_snapshot_does_not_move_in_the_difference(spark, tmp_path):
    from tests.test_plans import plan

    table = "stored_snapshot_test"
    old = spark.range(1000).select("id", (F.col("id") * 2).alias("v"))
    take = lambda df: snapshot.build_snapshot(df, "j", ["id"], "2024-01-01")
    snapshot.store_snapshot(take(old), table, f"{tmp_path}/s", "v1")
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = old.where("id > 9").withColumn("v", F.when(F.col("id") < 20, 0).otherwise(F.col("v"))).unionByName(spark.range(2000, 2005).select("id", F.lit(1).alias("v")))
        found = snapshot.snapshot_diff(spark.table(table), take(new))
        assert {r.change_type: r["count"] for r in found.groupBy("change_type").count().collect()} == {"DELETE": 10, "UPDATE": 10, "INSERT": 5}
        assert sum("Exchange hashpartitioning" in line for line in plan(found).splitlines()) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    # A snapshot made from the stored one takes its place in one change of the view.
    snapshot.store_snapshot(snapshot.snapshot_merge_seen(spark.table(table), take(new), "2024-02-01"), table, f"{tmp_path}/s", "v2")
    assert spark.table(table).where("change_type = 'DELETE'").count() == 10 and snapshot.stored_versions(spark, table) == [f"{table}__v2"]
    snapshot.drop_stored(spark, table)
    assert snapshot.stored_versions(spark, table) == []


def test_histories_of_feeds_one_after_another_are_that_of_one_feed(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 9) or None, t, f"v{t}", rng.randint(0, 3)) for t in range(200)]
    schema = "k int, t int, v string, w int"
    feed = lambda some: spark.createDataFrame(some, schema)
    whole = changes.change_history(feed(rows), ["k"], "t", ["v", "w"])
    found, last = [], None
    for part in (rows[:50], rows[50:60], [], rows[60:]):
        one_feed = feed(part)
        found += changes.change_history(one_feed, ["k"], "t", ["v", "w"], last).select(whole.columns).collect()
        last = spark.createDataFrame(changes.last_rows(one_feed, ["k"], "t", ["v", "w"], last).collect(), schema)
    named = lambda rows_: sorted((r for r in map(tuple, rows_) if r[0] is not None), key=str)
    assert named(found) == named(whole.collect())


def test_keys_of_instants_do_not_depend_on_the_zone(spark):
    hours = spark.range(1730606400, 1730606400 + 4 * 3600, 1800).select(F.timestamp_seconds("id").alias("at"))
    own, found = spark.conf.get("spark.sql.session.timeZone"), []
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            found.append(sorted(r[0] for r in hours.select(row_key([F.col("at")])).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", own)
    assert found[0] == found[1] and len(set(found[0])) == 8 and found[0][0] == "2024-11-03T04:00:00.000000Z"
    assert one(spark, row_key([F.lit(None).cast("timestamp"), F.lit("2024-01-01").cast("timestamp_ntz")])) == "\\N||2024-01-01 00:00:00"

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerelay.operators import keys, mapping, merge


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id int, v string")


def test_upsert_replaces_inserts_and_keeps(spark, target):
    source = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "id int, v string")
    merged = merge.merge_upsert(target, source, ["ID"])
    assert rows(merged) == sorted([(1, "a"), (2, "B"), (3, "C"), (None, "n"), (None, "N")], key=repr)


def test_upsert_is_idempotent(spark, target):
    source = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    once = merge.merge_upsert(target, source, ["id"])
    assert rows(merge.merge_upsert(once, source, ["id"])) == rows(once)


def test_upsert_where_every_column_is_a_key(spark, target):
    source = spark.createDataFrame([(2, "b"), (2, "c")], "id int, v string")
    merged = merge.merge_upsert(target, source, ["id", "v"])
    assert rows(merged) == sorted([(1, "a"), (2, "b"), (2, "c"), (None, "n")], key=repr)


def test_repeated_keys_raise_or_keep_the_latest(spark, target):
    source = spark.createDataFrame([(2, "B"), (2, "C"), (None, "x"), (None, "x")], "id int, v string")
    with pytest.raises(ValueError, match="more than once"):
        merge.merge_upsert(target, source, ["id"])
    merged = merge.merge_upsert(target, source, ["id"], "latest", ["v"])
    assert rows(merged.where("id = 2")) == [(2, "C")]
    assert merged.where("id IS NULL").count() == 3


def test_keys_are_required_and_must_exist(spark, target):
    with pytest.raises(ValueError, match="at least one key"):
        merge.merge_upsert(target, target, [])
    with pytest.raises(ValueError, match="does not exist"):
        merge.merge_upsert(target, target, ["nope"])


def test_insert_only_leaves_existing_rows(spark, target):
    source = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "id int, v string")
    merged = merge.merge_insert_only(target, source, ["id"])
    assert rows(merged) == sorted([(1, "a"), (2, "b"), (3, "C"), (None, "n"), (None, "N")], key=repr)


def test_action_counts(spark, target):
    source = spark.createDataFrame([(2, "b"), (3, "C"), (None, "N")], "id int, v string")
    assert rows(merge.merge_action_counts(target, source, ["id"])) == [("INSERT", 2), ("UPDATE", 1)]


def test_comparison_delete_refuses_an_empty_source(spark, target):
    empty = target.limit(0)
    with pytest.raises(ValueError, match="empty"):
        merge.delete_comparison(target, empty, ["id"])
    assert merge.delete_comparison(target, empty, ["id"], allow_empty=True).count() == 0


def test_comparison_delete_uses_every_key(spark):
    target = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "x int, y int, v string")
    source = spark.createDataFrame([(1, 2, "b")], "x int, y int, v string")
    assert rows(merge.delete_comparison(target, source, ["x", "y"])) == [(1, 2, "b")]
    assert rows(merge.keys_missing_in_source(target, source, ["x", "y"])) == [(1, 1)]


def test_soft_delete_compares_as_the_columns_type(spark, target):
    source = spark.createDataFrame([(1, "CANCELADO"), (2, None)], "id int, state string")
    assert rows(merge.delete_soft(target, source, ["id"], "STATE", "CANCELADO")) == sorted(
        [(2, "b"), (None, "n")], key=repr
    )
    numbers = spark.createDataFrame([(1, 1), (2, 0)], "id int, gone int")
    assert rows(merge.soft_deleted_keys(numbers, ["id"], "gone", "1")) == [(1,)]


def test_full_merge_by_flag_and_by_comparison(spark, target):
    source = spark.createDataFrame([(1, "gone"), (2, "B"), (3, None)], "id int, v string")
    soft = merge.merge_full(target, source, ["id"], soft=("v", "gone"))
    assert rows(soft) == sorted([(2, "B"), (3, None), (None, "n")], key=repr)
    compared = merge.merge_full(target, source.where("id = 2"), ["id"], full_source=source.where("id > 1"))
    assert rows(compared) == [(2, "B")]
    with pytest.raises(ValueError, match="full source"):
        merge.merge_full(target, source, ["id"])


def test_merges_agree_with_dictionaries(spark):
    rng = random.Random(5)
    for _ in range(3):
        old = {k: rng.randint(0, 9) for k in rng.sample(range(30), 15)}
        new = {k: rng.randint(0, 9) for k in rng.sample(range(30), 15)}
        t = spark.createDataFrame(list(old.items()), "k int, v int")
        s = spark.createDataFrame(list(new.items()), "k int, v int")
        assert dict(rows(merge.merge_upsert(t, s, ["k"]))) == {**old, **new}
        assert dict(rows(merge.merge_insert_only(t, s, ["k"]))) == {**new, **old}
        assert dict(rows(merge.merge_full(t, s, ["k"], full_source=s))) == new


def test_latest_per_key_settles_ties_by_the_other_columns(spark):
    data = [("a", 1, x) for x in "pqr"] + [("b", 2, "z"), ("b", None, "zz")]
    for order in itertools.islice(itertools.permutations(data), 0, 120, 40):
        df = spark.createDataFrame(list(order), "k string, t int, v string")
        assert rows(keys.latest_per_key(df, ["k"], ["t"])) == [("a", 1, "r"), ("b", 2, "z")]


@pytest.mark.parametrize("n", [2, 1500])
def test_top_n_per_group_small_and_large(spark, n):
    df = spark.range(0, 6000, 1, 6).select((F.col("id") % 3).alias("g"), "id")
    top = keys.top_n_per_group(df, ["g"], [F.col("id").desc()], n)
    expected = sorted((i % 3, i) for i in range(6000 - 3 * n, 6000))
    assert rows(top) == sorted(expected, key=repr)


def test_previous_row_of_frequent_and_rare_keys(spark):
    rng = random.Random(3)
    data = [("hot", i, rng.randint(0, 5)) for i in range(300)] + [(f"k{i % 20}", i, i) for i in range(100)]
    data += [(None, i, i) for i in range(30)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, t int, v int").repartition(6)
    plain = rows(keys.previous_row(df, ["k"], ["t"], ["v"], "before"))
    last, expected = {}, []
    for k, t, v in sorted(data, key=lambda r: (str(r[0]), r[1])):
        expected.append((k, t, v, (last[k],) if k in last else None))
        last[k] = v
    assert [(k, t, v, b and tuple(b)) for k, t, v, b in plain] == sorted(expected, key=lambda r: repr(
        (r[0], r[1], r[2], r[3] and Row(v=r[3][0]))))
    assert sum(r[3] is None for r in plain) == 22


def test_mapping_rules(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "Id int, Name string, Amount double")
    mapped = mapping.map_columns(df, [("ID", "key"), ("name", "text"), ("amount", "KEY")])
    assert mapped.columns == ["key", "text"] and mapped.head()["key"] == 2.0
    with pytest.raises(ValueError, match="'missing'"):
        mapping.map_columns(df, [("missing", "x")])
    with pytest.raises(ValueError, match="empty entry"):
        mapping.map_columns(df, [("Id", " ")])


def test_auto_map_rejects_what_cannot_be_named(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert mapping.auto_map(df) == [("a", "a"), ("b", "b")]
    with pytest.raises(ValueError, match="twice"):
        mapping.auto_map(df.select("a", F.col("b").alias("A")))
    with pytest.raises(ValueError, match="no name"):
        mapping.auto_map(df.select("a", F.col("b").alias(" ")))
    with pytest.raises(ValueError, match="no columns"):
        mapping.auto_map(df.select())


def test_align_fails_on_values_that_do_not_fit(spark):
    target = spark.createDataFrame([], "id int, note string").schema
    good = spark.createDataFrame([("7",)], "ID string")
    assert rows(mapping.align_to_target(good, target)) == [(7, None)]
    with pytest.raises(Exception, match="does not fit"):
        mapping.align_to_target(spark.createDataFrame([("x",)], "id string"), target).collect()


def test_insert_by_name_refuses_diverged_tables(spark):
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    assert rows(mapping.insert_by_name(a, a.select("v", "id"))) == [(1, "x"), (1, "x")]
    with pytest.raises(ValueError, match="columns differ"):
        mapping.insert_by_name(a, a.withColumn("extra", F.lit(1)))


def test_columns_may_have_any_name(spark):
    odd = "`k.id` int, `a.b` string, `with ``tick` int"
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 3)], odd)
    source = spark.createDataFrame([(2, "B", 5), (2, "A", 4), (3, "c", 6)], odd)
    merged = merge.merge_upsert(target, source, ["k.id"], "latest", ["with `tick"])
    assert rows(merged) == [(1, "a", 1), (2, "B", 5), (3, "c", 6), (None, "n", 3)]
    assert rows(merge.merge_insert_only(target, source, ["k.id"], "latest", ["a.b"])) == [(1, "a", 1), (2, "b", 2), (3, "c", 6), (None, "n", 3)]
    assert rows(merge.delete_soft(target, source, ["k.id"], "a.b", "B")) == [(1, "a", 1), (None, "n", 3)]
    assert rows(merge.keys_missing_in_source(target, source, ["k.id"])) == [(1,), (None,)]
    assert keys.duplicate_keys(source, ["k.id"]).count() == 1


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_values_that_do_not_fit_fail_whatever_the_setting(spark, ansi):
    own = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([("1", 2**40), (None, 7)], "t string, n long")
        good = mapping.align_to_target(df.where("t IS NULL"), T.StructType.fromDDL("t int, n int"))
        assert [tuple(r) for r in good.collect()] == [(None, 7)]
        for ddl in ("t date, n long", "t int, n int"):
            with pytest.raises(Exception, match="does not fit"):
                mapping.align_to_target(df, T.StructType.fromDDL(ddl)).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", own)

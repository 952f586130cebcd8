from __future__ import annotations

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tablerelay.operators.keys import latest_per_key
from tablerelay.operators.merge import merge_upsert
from tablerelay.plans import buckets, publish
from tablerelay.session import shared_folder
from tablerelay.sources import queries as src
from tablerelay.sources import reports, run_log
from tablerelay.streaming import run_log as stream_log
from tablerelay.streaming import upsert


def test_parameters():
    assert src.parse_parameters(["a=1", " ", "B", "=x", "A = 2=3"]) == {"a": "2=3", "B": "", "=x": ""}


def test_datasets_by_name(spark):
    registry = src.DatasetRegistry()
    registry.add("Recent", lambda s, p: s.range(int(p.get("n", "3"))))
    assert registry.read(spark, "RECENT", {"n": "5"}).count() == 5
    with pytest.raises(ValueError, match="no dataset"):
        registry.read(spark, "other")


def test_bad_json_gives_no_parameters(spark):
    df = spark.createDataFrame([('{"a":"1"}',), ("{bad",), (None,)], "t string")
    assert [r[0] for r in df.select(src.source_params_json(F.col("t"))).collect()] == [{"a": "1"}, {}, {}]


def test_a_limit_below_one_reads_everything(spark):
    assert src.source_top_n(spark.range(5), 0).count() == 5
    assert src.source_top_n(spark.range(5), 2).count() == 2


def test_reports_survive_quotes_and_commas(spark):
    df = spark.createDataFrame([(1, 'a "quoted", text'), (2, None)], "id int, t string")
    for kind in ("csv", "json"):
        path = reports.export_report(df, shared_folder(spark, kind), kind)
        reader = spark.read.schema("id int, t string")
        back = reader.option("header", True).option("escape", '"').csv(path) if kind == "csv" else reader.json(path)
        assert sorted(map(tuple, back.collect())) == [(1, 'a "quoted", text'), (2, None)]
    with pytest.raises(ValueError):
        reports.export_report(df, "x", "xml")


def test_log_levels(spark):
    path = shared_folder(spark, "log")
    lines = ['{"ts":"2024-01-01T00:00:00","level":"Warn","app":"a","evt":"e","msg":"m"}',
             '{"ts":"2024-01-01T00:00:01","level":"debug","app":"a","evt":"e","msg":"m","ex":"x"}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    assert run_log.read_run_log(spark, path).count() == 2
    assert run_log.read_run_log(spark, path, "INFO").count() == 1
    assert spark.range(1).select(run_log.level_rank(F.lit("fatal"))).head()[0] == 5
    with pytest.raises(ValueError, match="unknown level"):
        run_log.read_run_log(spark, path, "loud")


SCHEMA = "id int, t int, v string, op string"


def arrive(spark, folder, number, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part={number}")


def take(spark, folder, target, op=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/part=*")
    return upsert.stream_upsert(target, stream, ["id"], ["t"], f"{folder}/log", f"{folder}/checkpoint", op)


BATCHES = [
    [(1, 1, "a", "I"), (2, 1, "b", "I"), (2, 2, "b2", "U")],
    [(1, 3, "a3", "U"), (3, 1, "c", "I"), (2, 1, "old", "U")],
    [(3, 2, None, "D"), (1, 3, "a3", "U")],
]


def test_streamed_batches_equal_one_batch(spark):
    folder = shared_folder(spark, "stream")
    target = spark.createDataFrame([(2, 0, "x", "I"), (9, 0, "y", "I")], SCHEMA)
    for number, batch in enumerate(BATCHES):
        arrive(spark, folder, number, *batch)
        result = take(spark, folder, target)
    whole = spark.createDataFrame([r for b in BATCHES for r in b], SCHEMA)
    expected = merge_upsert(target, latest_per_key(whole, ["id"], ["t"]), ["id"], "unique")
    assert sorted(map(tuple, result.collect())) == sorted(map(tuple, expected.collect()))
    logged = upsert.read_batches(spark, f"{folder}/log", SCHEMA)
    assert logged.select("batch_id").distinct().count() == 3
    assert upsert.read_batches(spark, f"{folder}/log", SCHEMA, after=1).count() == 2


def test_a_streamed_feed_deletes(spark):
    folder = shared_folder(spark, "feed")
    target = spark.createDataFrame([(2, "x"), (9, "y")], "id int, v string")
    for number, batch in enumerate(BATCHES):
        arrive(spark, folder, number, *batch)
    rows = sorted(map(tuple, take(spark, folder, target, "op").collect()))
    assert rows == [(1, "a3"), (2, "b2"), (9, "y")]


def test_streamed_counts_follow_the_log(spark):
    folder = shared_folder(spark, "tail")
    line = '{"ts":"2024-01-01T00:00:00","level":"%s","app":"a","evt":"%s","msg":"m"}'
    for number, lines in enumerate(([("Info", "x"), ("Error", "x")], [("Info", "x"), ("Trace", "y")])):
        spark.createDataFrame([(line % p,) for p in lines], "value string").coalesce(1).write.mode("append").text(f"{folder}/log")
        stream_log.stream_run_log(spark, f"{folder}/log", f"{folder}/counts", f"{folder}/check", "Info").awaitTermination()
    counts = {(r.evt, r.level): r.line_count for r in spark.read.parquet(f"{folder}/counts").collect()}
    assert counts == {("x", "Info"): 2, ("x", "Error"): 1}


def test_a_stream_publishes_only_its_new_batches(spark, tmp_path):
    folder, table = f"{tmp_path}/published", f"t_{uuid.uuid4().hex}"
    schema = "k int, v string, t int"
    publish.full_refresh_swap(spark.createDataFrame([(1, "a", 0), (2, "b", 0)], schema), table, folder)
    os.makedirs(f"{tmp_path}/in")

    def arrive(*rows):
        if rows:
            spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        return upsert.publish_stream(spark, table, folder, stream, ["k"], ["t"])

    assert arrive() is None and upsert.published_batch(spark, table) == -1
    arrive((2, "B", 1), (3, "c", 1))
    assert upsert.published_batch(spark, table) == 0
    assert sorted(map(tuple, spark.table(table).collect())) == [(1, "a", 0), (2, "B", 1), (3, "c", 1)]
    # What was folded is not read again: without its log the next run still works.
    for name in os.listdir(f"{folder}/log/batch_id=0"):
        with open(f"{folder}/log/batch_id=0/{name}", "wb"):
            pass
    arrive((1, "A", 2))
    assert upsert.published_batch(spark, table) == 1
    assert sorted(map(tuple, spark.table(table).collect())) == [(1, "A", 2), (2, "B", 1), (3, "c", 1)]
    assert arrive() is None
    spark.sql(f"DROP TABLE {table}")


EVENTS = [(k, t, f"{k} at {t}", op) for k in range(6) for t, op in ((1, "I"), (2, "U"), (3, "D" if k % 2 else "U"), (5, "U" if k in (1, 2) else "D"))]


def publish_in(spark, tmp_path, batches, op, bucket, of=SCHEMA, order_by=("t",)):
    """What a table holds after these batches, each of a run of its own."""
    place = f"{tmp_path}/{uuid.uuid4().hex}"
    folder, table = f"{place}/published", f"t_{uuid.uuid4().hex}"
    target = spark.createDataFrame([(2, 0, "x", None), (9, 0, "y", None)], of).select("id", "t", "v")
    if bucket:
        buckets.replace_buckets(spark, table, folder, target, ["id"], bucket)
    else:
        publish.full_refresh_swap(target, table, folder)
    for number, rows in enumerate(batches):
        spark.createDataFrame(list(rows), of).coalesce(1).write.parquet(f"{place}/in/part={number}")
        stream = spark.readStream.schema(of).parquet(f"{place}/in/part=*")
        upsert.publish_stream(spark, table, folder, stream if op else stream.drop("op"), ["id"], list(order_by), op, bucket=bucket)
    rows = sorted(map(tuple, spark.table(table).select("id", "t", "v").collect()))
    kept = sorted(os.listdir(f"{folder}/log"))
    spark.sql(f"DROP TABLE {table}")
    return rows, kept


@pytest.mark.parametrize("bucket", [None, "id % 3"])
@pytest.mark.parametrize("op", [None, "op"])
def test_published_rows_do_not_depend_on_where_batches_begin(spark, tmp_path, op, bucket):
    whole, _ = publish_in(spark, tmp_path, [EVENTS], op, bucket)
    mixed = EVENTS[::-1]
    parts = [mixed[:9], mixed[9:11] + mixed[:2], mixed[11:]]
    cut, log = publish_in(spark, tmp_path, parts, op, bucket)
    assert cut == whole and len(whole) == (3 if op else 7)
    # Batches that an earlier run published are gone.
    assert [n for n in log if n.startswith("batch_id")] == ["batch_id=2"]


def test_ties_are_settled_by_content_in_any_batch(spark, tmp_path):
    rows = [(1, 1, "a", "U"), (1, 1, "b", "U"), (1, 1, "c", "U")]
    found = {str(publish_in(spark, tmp_path, order, None, None)[0]) for order in ([rows], [[r] for r in rows], [[r] for r in rows[::-1]])}
    assert len(found) == 1


def test_a_feed_that_clashes_fails_in_one_batch_and_in_two(spark, tmp_path):
    clash = [(1, 1, "a", "I"), (1, 1, None, "D")]
    for batches in ([clash], [clash[:1], clash[1:]]):
        with pytest.raises(Exception, match="disagree"):
            publish_in(spark, tmp_path, batches, "op", None)
    same = [(1, 1, "a", "I")]
    assert publish_in(spark, tmp_path, [same, same], "op", None)[0] == [(1, 1, "a"), (2, 0, "x"), (9, 0, "y")]


@pytest.mark.parametrize("bucket", [None, "id % 3"])
def test_a_stream_that_dies_before_it_shows_its_rows_is_made_good(spark, tmp_path, monkeypatch, bucket):
    folder, table, schema = f"{tmp_path}/published", f"t_{uuid.uuid4().hex}", "id int, t int, v string"
    first = spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], schema)
    publish.full_refresh_swap(first, table, folder) if bucket is None else buckets.replace_buckets(spark, table, folder, first, ["id"], bucket)
    spark.createDataFrame([(1, 5, "new"), (3, 1, "c")], schema).write.parquet(f"{tmp_path}/in")
    go = lambda: upsert.publish_stream(spark, table, folder, spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["id"], ["t"], bucket=bucket)

    def dies(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(upsert, "full_refresh_swap" if bucket is None else "_publish_buckets", dies)
        with pytest.raises(OSError):
            go()
    assert spark.table(table).count() == 2
    go()
    assert sorted(map(tuple, spark.table(table).select("id", "t", "v").collect())) == [(1, 5, "new"), (2, 0, "y"), (3, 1, "c")]
    assert go() is None
    spark.sql(f"DROP TABLE {table}")


def test_many_clocks_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upsert, "CLOCKS", 2)
    batches = [[(1, 100 - k, f"v{k}", "U")] for k in range(5)]
    rows, _ = publish_in(spark, tmp_path, batches, None, None)
    assert rows == [(1, 100, "v0"), (2, 0, "x"), (9, 0, "y")]

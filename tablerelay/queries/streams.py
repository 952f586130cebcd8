"""Streaming runs over files derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablerelay.plans import buckets
from tablerelay.plans.publish import full_refresh_swap, table_location
from tablerelay.queries.book import Book
from tablerelay.queries.changes import APPLIED
from tablerelay.session import shared_folder
from tablerelay.streaming import run_log, upsert

book = Book()
QUERIES, SQL = book.queries, book.sql


@book.query("""
    SELECT s.* FROM {stale_orders} s ANTI JOIN orders o ON s.o_orderkey = o.o_orderkey UNION ALL SELECT * FROM orders""")
def stream_upsert(t):
    folder = shared_folder(t.spark, "stream")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    target, schema = t.stale_orders, t.orders.schema
    for run, part in enumerate((early, ~early)):
        t.orders.where(part).write.parquet(f"{folder}/arriving/part={run}")
        stream = t.spark.readStream.schema(schema).parquet(f"{folder}/arriving/part=*")
        result = upsert.stream_upsert(
            target, stream, ["o_orderkey"], ["o_orderdate"], f"{folder}/log", f"{folder}/checkpoint"
        )
    return result


@book.query("""
    SELECT s.* FROM {stale_orders} s ANTI JOIN orders o ON s.o_orderkey = o.o_orderkey UNION ALL SELECT * FROM orders""")
def stream_publish(t):
    """Three runs, one of them before anything has arrived; readers see the table throughout."""
    folder, table = shared_folder(t.spark, "stream"), f"relay_{uuid.uuid4().hex}"
    full_refresh_swap(t.stale_orders, table, folder)
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    t.orders.where("false").write.parquet(f"{folder}/arriving/part=none")
    for run, part in enumerate((F.lit(False), early, ~early)):
        t.orders.where(part).write.parquet(f"{folder}/arriving/part={run}")
        stream = t.spark.readStream.schema(t.orders.schema).parquet(f"{folder}/arriving/part=*")
        upsert.publish_stream(t.spark, table, folder, stream, ["o_orderkey"], ["o_orderdate"])
    path = table_location(t.spark, table)
    t.spark.sql(f"DROP TABLE {table}")
    return t.spark.read.parquet(path)


def _late(t):
    """What an earlier state of the orders said: a day older, and dearer."""
    return t.orders.withColumns({
        "o_orderdate": F.col("o_orderdate") - F.expr("INTERVAL '1' DAY"), "o_totalprice": F.col("o_totalprice") + 1000,
    })


def _published_runs(t, runs, bucket=None, op=None, order_by="o_orderdate"):
    """Runs of a published stream, one for each frame that arrives; what readers see at last."""
    folder, table = shared_folder(t.spark, "stream"), f"relay_{uuid.uuid4().hex}"
    if bucket is None:
        full_refresh_swap(t.stale_orders, table, folder)
    else:
        buckets.replace_buckets(t.spark, table, folder, t.stale_orders, ["o_orderkey"], bucket)
    for run, rows in enumerate(runs):
        rows.write.parquet(f"{folder}/arriving/part={run}")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{folder}/arriving/part=*")
        upsert.publish_stream(t.spark, table, folder, stream, ["o_orderkey"], [order_by], op, bucket=bucket)
    files, columns = t.spark.table(table).inputFiles(), t.stale_orders.columns
    t.spark.sql(f"DROP TABLE {table}")
    return t.spark.read.parquet(*files).select(*columns)


_NEWEST = "SELECT s.* FROM {stale_orders} s ANTI JOIN orders o ON s.o_orderkey = o.o_orderkey UNION ALL SELECT * FROM orders"
_EVEN = "o_orderkey % 2 = 0"


@book.query(_NEWEST)
def stream_out_of_order(t):
    """Newest rows first, then older ones of all keys, then the other newest rows."""
    return _published_runs(t, [t.orders.where(_EVEN), _late(t), t.orders.where(f"NOT {_EVEN}")])


@book.query(_NEWEST)
def stream_out_of_order_bucketed(t):
    """The same in buckets, of which each run writes those it touches."""
    return _published_runs(t, [t.orders.where(_EVEN), _late(t), t.orders.where(f"NOT {_EVEN}")], "pmod(o_orderkey, 16)")


@book.query(f"SELECT * FROM ({_NEWEST}) n WHERE o_orderkey % 3 <> 0 OR o_orderkey < 0")
def stream_feed_out_of_order(t):
    """Deletes of version 3 come before the updates of version 2 that they follow."""
    said = lambda rows, version, op: rows.withColumns({"version": F.lit(version), "op": F.lit(op)})
    third = (F.col("o_orderkey") % 3 == 0) & (F.col("o_orderkey") >= 0)
    every = t.orders.unionByName(t.stale_orders.where("o_orderkey >= 0")).dropDuplicates(["o_orderkey"])
    first = said(t.orders.where(_EVEN), 3, "U").where(~third).unionByName(said(every.where(third), 3, "D"))
    return _published_runs(t, [first, said(_late(t), 2, "U"), said(t.orders.where(f"NOT {_EVEN}"), 3, "U").where(~third)], op="op", order_by="version")


@book.query(APPLIED)
def stream_apply_changes(t):
    folder = shared_folder(t.spark, "feed")
    t.feed.write.parquet(f"{folder}/arriving")
    stream = t.spark.readStream.schema(t.feed.schema).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/arriving")
    return upsert.stream_upsert(
        t.feed_target, stream, ["pk"], ["version"], f"{folder}/log", f"{folder}/checkpoint", op="op"
    )


@book.query("""
    SELECT evt, level, CAST(count(*) AS BIGINT) AS line_count FROM {log_lines} WHERE level IN ('Info', 'Warn', 'Error') GROUP BY evt, level""")
def stream_run_log(t):
    folder = shared_folder(t.spark, "tail")
    lines = t.log_lines.select(F.to_json(F.struct("ts", "level", "app", "evt", "msg", "ex")))
    lines.write.text(f"{folder}/log")
    run_log.stream_run_log(t.spark, f"{folder}/log", f"{folder}/counts", f"{folder}/checkpoint", "Info").awaitTermination()
    return t.spark.read.parquet(f"{folder}/counts")

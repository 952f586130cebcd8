"""Merges and deletions against an outdated copy of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablerelay.operators import keys as key_ops
from tablerelay.operators import merge
from tablerelay.operators.mapping import align_to_target
from tablerelay.plans import guards
from tablerelay.queries.book import Book

book = Book()
QUERIES, SQL = book.queries, book.sql

_KEPT = "SELECT s.* FROM {stale_orders} s ANTI JOIN orders o ON s.o_orderkey = o.o_orderkey"


@book.query(f"{_KEPT} UNION ALL SELECT * FROM orders")
def merge_upsert(t):
    return merge.merge_upsert(t.stale_orders, t.orders, ["o_orderkey"])


@book.query("""
    SELECT r.* FROM {raw_orders} r WHERE order_key IS NULL OR customer_text LIKE 'C-%'
    UNION ALL SELECT r.* REPLACE (concat('new ', customer_text) AS customer_text) FROM {raw_orders} r
    WHERE order_key IS NULL OR customer_text NOT LIKE 'C-%'""")
def merge_upsert_null_keys(t):
    """Rows without a key match nothing: the target's stay, the batch's are inserted."""
    batch = t.raw_orders.where("order_key IS NULL OR customer_text NOT LIKE 'C-%'").withColumn(
        "customer_text", F.concat(F.lit("new "), "customer_text")
    )
    return merge.merge_upsert(t.raw_orders, batch, ["order_key"])


_LINE_KEY = "l_orderkey, l_linenumber"
_LATEST_LINE = f"""
    SELECT * EXCLUDE (position) FROM (
        SELECT *, row_number() OVER (PARTITION BY {_LINE_KEY} ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC,
               l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS position
        FROM lineitem) ranked WHERE position = 1"""


@book.query(f"""
    SELECT * FROM (SELECT * FROM ({_LATEST_LINE}) a WHERE l_returnflag <> 'R'
    AND (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_shipdate > TIMESTAMP '1997-01-01 00:00:00')
    UNION ALL
    SELECT * EXCLUDE (position) FROM (
        SELECT *, row_number() OVER (PARTITION BY {_LINE_KEY} ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC,
               l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS position
        FROM lineitem WHERE l_shipdate > TIMESTAMP '1997-01-01 00:00:00') ranked WHERE position = 1) merged""")
def merge_upsert_latest(t):
    composite = ["l_orderkey", "l_linenumber"]
    target = key_ops.latest_of_group(t.lineitem, composite, ["l_shipdate"]).where("l_returnflag <> 'R'")
    batch = t.lineitem.where("l_shipdate > TIMESTAMP_NTZ '1997-01-01 00:00:00'")
    return merge.merge_upsert(target, batch, composite, "latest", ["l_shipdate"])


@book.query("SELECT * FROM {stale_orders} UNION ALL "
            "SELECT o.* FROM orders o ANTI JOIN {stale_orders} s ON s.o_orderkey = o.o_orderkey")
def merge_insert_only(t):
    return merge.merge_insert_only(t.stale_orders, t.orders, ["o_orderkey"])


@book.query("SELECT * FROM orders")
def merge_full(t):
    return merge.merge_full(t.stale_orders, t.orders, ["o_orderkey"], full_source=t.orders)


@book.query(f"SELECT * FROM ({_KEPT} UNION ALL SELECT * FROM orders WHERE o_orderstatus <> 'F') merged")
def merge_full_soft(t):
    return merge.merge_full(t.stale_orders, t.orders, ["o_orderkey"], soft=("o_orderstatus", "F"))


@book.query("SELECT * FROM {stale_orders} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_soft(t):
    return merge.delete_soft(t.stale_orders, t.orders, ["o_orderkey"], "o_orderstatus", "F")


@book.query("SELECT s.* FROM {stale_orders} s SEMI JOIN orders o ON s.o_orderkey = o.o_orderkey")
def delete_comparison(t):
    return merge.delete_comparison(t.stale_orders, t.orders, ["o_orderkey"])


@book.query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def soft_deleted_keys(t):
    return merge.soft_deleted_keys(t.orders, ["o_orderkey"], "o_orderstatus", "F")


@book.query("SELECT * FROM {stale_orders} WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def rows_to_soft_delete(t):
    return merge.rows_to_soft_delete(t.stale_orders, t.orders, ["o_orderkey"], "o_orderstatus", "F")


@book.query("SELECT o_orderkey FROM {stale_orders} EXCEPT SELECT o_orderkey FROM orders")
def keys_missing_in_source(t):
    return merge.keys_missing_in_source(t.stale_orders, t.orders, ["o_orderkey"])


@book.query("SELECT * FROM {central_history} UNION ALL "
            "SELECT DISTINCT f.execution_id, f.project_id, f.server_id, f.config_id, CAST(NULL AS VARCHAR), f.start_time, "
            "f.duration_ms, f.status, CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR) FROM {history_feed} f "
            "WHERE f.execution_id NOT IN (SELECT execution_id FROM {central_history})")
def insert_if_absent(t):
    central = t.central_history
    return merge.insert_if_absent(central, align_to_target(t.history_feed, central.schema), "execution_id", ["start_time"])


@book.query("""
    SELECT CASE WHEN s.o_orderkey IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS action, CAST(count(*) AS BIGINT) AS row_count
    FROM orders o LEFT JOIN {stale_orders} s ON s.o_orderkey = o.o_orderkey GROUP BY 1""")
def merge_action_counts(t):
    return merge.merge_action_counts(t.stale_orders, t.orders, ["o_orderkey"])


@book.query("""
    SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS row_count FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def duplicate_keys(t):
    return key_ops.duplicate_keys(t.lineitem, ["L_ORDERKEY", "l_linenumber"])


@book.query("""
    SELECT CAST(sum(n) AS BIGINT) AS row_count,
           CAST(coalesce(sum(CASE WHEN order_key IS NULL THEN n END), 0) AS BIGINT) AS null_key_rows,
           CAST(count_if(n > 1 AND order_key IS NOT NULL) AS BIGINT) AS duplicate_keys,
           CAST(sum(untracked) AS BIGINT) AS null_tracking_rows, CAST(sum(failing) AS BIGINT) AS failed_cast_rows
    FROM (SELECT order_key, count(*) AS n, count_if(changed_at IS NULL) AS untracked,
                 count_if(TRY_CAST(customer_text AS BIGINT) IS NULL) AS failing
          FROM (SELECT * FROM {raw_orders} UNION ALL
                SELECT * FROM {raw_orders} WHERE customer_text LIKE 'C-%') r GROUP BY order_key) g""")
def validate_source(t):
    rows = t.raw_orders.unionByName(t.raw_orders.where("customer_text LIKE 'C-%'"))
    return guards.validate_source(rows, ["order_key"], "changed_at", {"customer_text": "bigint"})

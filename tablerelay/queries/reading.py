"""Sources, reports and column mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablerelay.functions.identity import source_object_name
from tablerelay.operators import mapping
from tablerelay.queries.book import Book
from tablerelay.session import shared_folder
from tablerelay.sources import queries as src
from tablerelay.sources import reports, run_log

book = Book()
QUERIES, SQL = book.queries, book.sql


@book.query("""
    SELECT n_name, CAST(count(*) AS BIGINT) AS order_count, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS revenue
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name""")
def source_query(t):
    return src.source_query(
        t.spark,
        """SELECT n_name, count(*) AS order_count, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS revenue
           FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
           GROUP BY n_name""",
        orders=t.orders, customer=t.customer, nation=t.nation,
    )


@book.query("""
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AND o_orderstatus = 'F'""")
def source_params(t):
    parameters = src.parse_parameters(["Since=1997-01-01", "status=F", " ", "since = 1998-01-01"])
    return src.source_params(
        t.spark,
        """SELECT o_orderkey, o_custkey, o_totalprice FROM {orders}
           WHERE o_orderdate >= CAST(:since AS TIMESTAMP_NTZ) AND o_orderstatus = :status""",
        parameters,
        {"orders": t.orders},
    )


@book.query("""
    SELECT o_orderkey, ':Since' AS note FROM orders
    WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AND o_orderstatus = 'F'""")
def source_params_case(t):
    """Names agree whatever their case and sign; a query goes before a dataset."""
    parameters = src.parse_parameters(["@Since=1997-01-01", "STATUS=P", "since=1998-01-01", "@Status=F"])
    datasets = src.DatasetRegistry()
    datasets.add("Everything", lambda spark, _: t.orders)
    return src.read_source(
        t.spark,
        """SELECT o_orderkey, ':Since' AS note FROM {orders}  -- not :Since here
           WHERE o_orderdate >= CAST(:SINCE AS TIMESTAMP_NTZ) AND o_orderstatus = :status""",
        "everything", parameters, registry=datasets, tables={"orders": t.orders},
    )


@book.query("""
    SELECT event_id, json_extract_string(props, '$.k') AS k,
           CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS BIGINT) AS parameter_count
    FROM events""")
def source_params_json(t):
    stored = F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(F.col("props"))
    parsed = src.source_params_json(stored)
    return t.events.select(
        "event_id",
        src.source_params_json(F.col("props"))["k"].alias("k"),
        F.size(parsed).cast("bigint").alias("parameter_count"),
    )


@book.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def source_top_n(t):
    orders = t.orders.select("o_orderkey", "o_totalprice")
    return src.source_top_n(orders, 25, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@book.query("SELECT count(*) AS row_count FROM lineitem")
def table_row_count(t):
    return reports.table_row_count(t.lineitem)


@book.query("""
    SELECT doc_id, concat('dbo.', source, '_', lang) AS object_name,
           'UnknownSource' AS without_object FROM documents""")
def source_object_name_(t):
    return t.job_queries.select(
        "doc_id",
        source_object_name(F.col("query_text")).alias("object_name"),
        source_object_name(F.concat(F.lit("EXEC "), "source_server")).alias("without_object"),
    )


QUERIES["source_object_name"] = QUERIES.pop("source_object_name_")
SQL["source_object_name"] = SQL.pop("source_object_name_")


@book.query("""
    SELECT evt, level, CAST(count(*) AS BIGINT) AS line_count, max(ts) AS last_ts
    FROM {log_lines} WHERE level IN ('Info', 'Warn', 'Error', 'Fatal') GROUP BY evt, level""")
def read_run_log(t):
    path = shared_folder(t.spark, "run-log")
    t.log_lines.select(F.to_json(F.struct("ts", "level", "app", "evt", "msg", "ex"), {
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})).write.text(path)
    log = run_log.read_run_log(t.spark, path, "info")
    return log.groupBy("evt", "level").agg(
        F.count(F.lit(1)).alias("line_count"), F.max("ts").alias("last_ts")
    )


@book.query("""
    SELECT (SELECT count(*) FROM customer) AS customer, (SELECT count(*) FROM orders) AS orders,
           (SELECT count(*) FROM lineitem) AS lineitem, (SELECT count(*) FROM events) AS events""")
def inventory_counts(t):
    return reports.inventory_counts({n: getattr(t, n) for n in ("customer", "orders", "lineitem", "events")})


@book.query("SELECT execution_id, config_id, start_time, duration_ms, status FROM {history}")
def export_report(t):
    path = shared_folder(t.spark, "report")
    listing = t.history.select("execution_id", "config_id", "start_time", "duration_ms", "status")
    stamped = listing.withColumn("start_time", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    reports.export_report(stamped, path, "csv")
    schema = "execution_id bigint, config_id bigint, start_time timestamp_ntz, duration_ms bigint, status string"
    return t.spark.read.schema(schema).option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)


@book.query("""
    SELECT doc_id, lang, text FROM documents""")
def export_report_quoted(t):
    path = shared_folder(t.spark, "report")
    reports.export_report(t.documents.select("doc_id", "lang", "text"), path, "json")
    return t.spark.read.schema("doc_id bigint, lang string, text string").json(path)


@book.query("SELECT o_totalprice AS price, o_orderkey AS order_id, o_orderpriority AS customer FROM orders")
def map_columns(t):
    pairs = [("O_TOTALPRICE", "price"), ("o_orderkey", "order_id"), ("o_custkey", "customer"),
             ("O_OrderPriority", "Customer")]
    return mapping.map_columns(t.orders, pairs)


@book.query("SELECT * FROM customer")
def auto_map(t):
    return mapping.map_columns(t.customer, mapping.auto_map(t.customer))


@book.query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_totalprice AS DECIMAL(18, 2)) AS amount,
           CAST(o_orderdate AS DATE) AS order_day, CAST(NULL AS VARCHAR) AS remark FROM orders""")
def align_to_target(t):
    target = t.spark.createDataFrame(
        [], "order_id string, amount decimal(18,2), order_day date, remark string"
    ).schema
    pairs = [("o_orderkey", "ORDER_ID"), ("o_totalprice", "amount"), ("o_orderdate", "order_day"),
             ("o_custkey", "not_in_target")]
    return mapping.align_to_target(t.orders, target, pairs)


@book.query("""
    SELECT * FROM {stale_orders}
    UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders""")
def insert_by_name(t):
    reordered = t.orders.select("o_orderpriority", "o_orderdate", "o_totalprice", "o_orderstatus", "o_custkey", "o_orderkey")
    return mapping.insert_by_name(t.stale_orders, reordered)


@book.query("""
    SELECT upper(c_name) AS name, c_custkey % 10 AS shard, c_nationkey + 100 AS nation_code FROM customer""")
def transform_columns(t):
    return mapping.transform_columns(
        t.customer, [("upper(c_name)", "name"), ("c_custkey % 10", "shard"), ("c_nationkey + 100", "nation_code")]
    )

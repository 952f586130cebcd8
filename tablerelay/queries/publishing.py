"""Publishing tables and whole relay jobs, read back after they were written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerelay.operators import snapshot
from tablerelay.plans import guards, publish
from tablerelay.plans.history import read_history
from tablerelay.plans.job import run_job
from tablerelay.queries.book import Book, Tables
from tablerelay.queries.fixtures import AS_OF
from tablerelay.session import ntz, shared_folder
from tablerelay.spec import DeleteDetection, Incremental, JobSpec, Options

book = Book()
QUERIES, SQL = book.queries, book.sql


def _table() -> str:
    return f"relay_{uuid.uuid4().hex}"


def _published(t: Tables, table: str) -> DataFrame:
    """What readers of a table see; the catalog entry goes, the files stay."""
    shown = t.spark.table(table)
    path, seen, files = publish.table_location(t.spark, table), shown.count(), shown.inputFiles()
    bucketed = "_bucket" in shown.columns
    t.spark.sql(f"DROP TABLE {table}")
    # Buckets lie in folders of several runs.
    rows = t.spark.read.parquet(*files) if bucketed and files else t.spark.read.parquet(path)
    guards.count_parity_guard(seen, rows.count())
    return rows


@book.query("SELECT * FROM orders")
def full_refresh_swap(t):
    table, folder = _table(), shared_folder(t.spark, "swap")
    publish.full_refresh_swap(t.stale_orders, table, folder)
    publish.full_refresh_swap(t.orders, table, folder, Options(min_rows=1, batch_rows=1_000_000))
    return _published(t, table)


@book.query("SELECT * FROM orders")
def full_refresh_rewrite(t):
    table, folder = _table(), shared_folder(t.spark, "rewrite")
    publish.full_refresh_swap(t.stale_orders, table, folder)
    publish.full_refresh_rewrite(t.orders, table)
    return _published(t, table)


@book.query("SELECT * FROM {stale_orders} UNION ALL SELECT * FROM orders")
def append_load(t):
    table, folder = _table(), shared_folder(t.spark, "append")
    publish.full_refresh_swap(t.stale_orders, table, folder)
    publish.append_load(t.orders.select(*reversed(t.orders.columns)), table)
    return _published(t, table)


@book.query("SELECT * FROM {stale_orders} UNION ALL SELECT * FROM orders")
def append_retried(t):
    """A run that appended a part and died; tried again, it adds the whole once."""
    table, folder = _table(), shared_folder(t.spark, "append")
    publish.full_refresh_swap(t.stale_orders, table, folder)
    publish.append_once(t.spark, table, t.orders.where("o_orderkey % 2 = 0"), "run-1")
    publish.append_once(t.spark, table, t.orders, "run-1")
    return _published(t, table)


@book.query("SELECT * FROM lineitem")
def load_partitioned(t):
    path = shared_folder(t.spark, "load")
    load = publish.load_partitioned(t.lineitem, path, batch_rows=500_000)
    return publish.read_load(t.spark, load)


@book.query("SELECT * FROM customer UNION ALL SELECT * FROM customer")
def load_direct(t):
    table, folder = _table(), shared_folder(t.spark, "direct")
    publish.load_direct(t.customer, table, folder)
    publish.load_direct(t.customer, table, folder)
    publish.load_direct(t.customer, table, folder, append=True)
    return _published(t, table)


@book.query("""
    SELECT o_custkey AS batch_id, row_count, minimum,
           CASE WHEN row_count >= minimum OR force THEN 'commit' WHEN skip THEN 'skip' ELSE 'abort' END AS decision
    FROM (SELECT o_custkey, CAST(count(*) AS BIGINT) AS row_count, o_custkey % 20 AS minimum,
                 o_custkey % 3 = 0 AS force, o_custkey % 2 = 0 AS skip FROM orders GROUP BY o_custkey) batches""")
def min_row_guard(t):
    key = F.col("o_custkey")
    batches = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("row_count"))
    minimum = key % 20
    decision = guards.min_row_decision(F.col("row_count"), minimum, key % 3 == 0, key % 2 == 0)
    return batches.select(
        key.alias("batch_id"), "row_count", minimum.alias("minimum"), decision.alias("decision")
    )


@book.query("SELECT count(*) AS rows_read, count(*) AS rows_staged, TRUE AS parity FROM lineitem")
def count_parity_guard(t):
    load = publish.load_partitioned(t.lineitem, shared_folder(t.spark, "parity"))
    staged = publish.read_load(t.spark, load)
    return staged.agg(F.count(F.lit(1)).alias("rows_staged")).select(
        F.lit(load.rows).cast("bigint").alias("rows_read"),
        "rows_staged",
        (F.col("rows_staged") == F.lit(load.rows)).alias("parity"),
    )


@book.query("""
    SELECT s.* FROM {stale_orders} s ANTI JOIN orders o ON s.o_orderkey = o.o_orderkey
    UNION ALL SELECT * FROM orders""")
def merge_touched(t):
    path, bucket = shared_folder(t.spark, "bucketed"), "pmod(xxhash64(o_orderkey), 8)"
    publish.write_bucketed(t.stale_orders, path, bucket)
    publish.merge_touched(t.spark, path, t.orders, ["o_orderkey"], bucket, on_duplicate="unique")
    return t.spark.read.parquet(path).drop("_bucket")


def _job(t: Tables, incremental: Incremental, mappings=None, bucket=None, options=None) -> DataFrame:
    """Two runs of a job: first the older part of its source, then the whole of it."""
    table, folder = _table(), shared_folder(t.spark, "job")
    early = t.stale_orders.where(F.col("o_orderdate") < ntz("2000-01-01"))
    for source, clock in ((early, "2024-01-30 00:00:00"), (t.orders, AS_OF)):
        spec = JobSpec("orders", source, table, folder, ["o_orderkey"] if mappings is None else ["order_id"],
                       mappings, incremental, options or Options(), bucket)
        run_job(t.spark, spec, f"{folder}/states", clock)
    return _published(t, table)


_FIRST = "SELECT * FROM {stale_orders} WHERE o_orderdate < {ts} '2000-01-01 00:00:00'"
# The mark of the first run is the highest date it read.
_NEW = f"SELECT * FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM ({_FIRST}) m)"


@book.query(f"""
    SELECT o_orderkey AS order_id, o_totalprice AS price, o_orderpriority AS priority
    FROM (SELECT f.* FROM ({_FIRST}) f ANTI JOIN ({_NEW}) n ON f.o_orderkey = n.o_orderkey UNION ALL {_NEW}) merged""")
def run_job_timestamp(t):
    pairs = [("o_orderkey", "order_id"), ("o_totalprice", "price"), ("o_orderpriority", "priority")]
    return _job(t, Incremental("timestamp", "o_orderdate"), mappings=pairs)


@book.query(f"SELECT f.* FROM ({_FIRST}) f ANTI JOIN ({_NEW}) n ON f.o_orderkey = n.o_orderkey UNION ALL {_NEW}")
def run_job_bucketed(t):
    return _job(t, Incremental("timestamp", "o_orderdate"), bucket="pmod(xxhash64(o_orderkey), 8)").drop("_bucket")


@book.query(f"""
    WITH before AS ({_FIRST}), fresh AS ({_NEW}),
    merged AS (SELECT f.* FROM before f ANTI JOIN fresh n ON f.o_orderkey = n.o_orderkey UNION ALL SELECT * FROM fresh)
    SELECT m.b AS bucket, m.row_count, m.total_price, coalesce(n.touched, FALSE) AS rewritten
    FROM (SELECT o_orderkey % 32 AS b, CAST(count(*) AS BIGINT) AS row_count, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total_price FROM merged GROUP BY 1) m
    LEFT JOIN (SELECT DISTINCT o_orderkey % 32 AS b, TRUE AS touched FROM fresh) n ON n.b = m.b""")
def run_job_bucket_locations(t):
    """Each bucket's rows, and whether the second run gave it a folder of its own."""
    table, folder = _table(), shared_folder(t.spark, "job")
    early = t.stale_orders.where(F.col("o_orderdate") < ntz("2000-01-01"))
    for source, clock in ((early, "2024-01-30 00:00:00"), (t.orders, AS_OF)):
        spec = JobSpec("orders", source, table, folder, ["o_orderkey"], None, Incremental("timestamp", "o_orderdate"), bucket="o_orderkey % 32")
        run_job(t.spark, spec, f"{folder}/states", clock)
    first = publish.table_location(t.spark, table).rsplit("/", 1)[-1]
    rows = t.spark.read.parquet(*t.spark.table(table).inputFiles())
    t.spark.sql(f"DROP TABLE {table}")
    return rows.groupBy((F.col("o_orderkey") % 32).alias("bucket")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total_price"),
        (~F.max(F.contains(F.col("_metadata.file_path"), F.lit(first)))).alias("rewritten"),
    ).withColumn("total_price", F.col("total_price").cast("decimal(38,2)"))


_LATER = "SELECT * FROM orders WHERE o_orderkey % 97 <> 3"
_LATEST = f"SELECT * FROM ({_NEW}) n WHERE o_orderkey % 97 <> 3"
_LEFT = f"SELECT f.* FROM ({_FIRST}) f SEMI JOIN ({_LATER}) s ON f.o_orderkey = s.o_orderkey ANTI JOIN ({_LATEST}) n ON f.o_orderkey = n.o_orderkey"


def _full_merge_runs(t, table, folder):
    """A first load, then a full merge by comparison with a source that has lost some rows."""
    early = t.stale_orders.where(F.col("o_orderdate") < ntz("2000-01-01"))
    how = Incremental("timestamp", "o_orderdate", merge="full", deletes=DeleteDetection("comparison"))
    for source, clock in ((early, "2024-01-30 00:00:00"), (t.orders.where("o_orderkey % 97 <> 3"), AS_OF)):
        spec = JobSpec("orders", source, table, folder, ["o_orderkey"], None, how, bucket="o_orderkey % 64")
        result = run_job(t.spark, spec, f"{folder}/states", clock)
    return result


@book.query(f"SELECT * FROM ({_LEFT}) k UNION ALL SELECT * FROM ({_LATEST}) n")
def run_job_bucketed_full(t):
    table, folder = _table(), shared_folder(t.spark, "job")
    _full_merge_runs(t, table, folder)
    return _published(t, table)


@book.query(f"""
    SELECT 'INSERT' AS action, CAST(count(*) AS BIGINT) AS row_count FROM ({_LATEST}) n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_FIRST}) f)
    UNION ALL SELECT 'UPDATE', count(*) FROM ({_LATEST}) n WHERE o_orderkey IN (SELECT o_orderkey FROM ({_FIRST}) f)
    UNION ALL SELECT 'DELETE', count(*) FROM ({_FIRST}) f WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_LATER}) s)""")
def run_job_bucketed_full_counts(t):
    """What the run counted, from the layout and while merging."""
    table, folder = _table(), shared_folder(t.spark, "job")
    changes = _full_merge_runs(t, table, folder).changes
    t.spark.sql(f"DROP TABLE {table}")
    return t.spark.createDataFrame(list(changes.items()), "action string, row_count bigint")


@book.query("SELECT * FROM orders")
def run_job_snapshot(t):
    return _job(t, Incremental("snapshot"))


@book.query(f"""
    SELECT m.* FROM (SELECT f.* FROM ({_FIRST}) f ANTI JOIN ({_NEW}) n ON f.o_orderkey = n.o_orderkey UNION ALL {_NEW}) m
    ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') d ON m.o_orderkey = d.o_orderkey""")
def run_job_full_merge(t):
    deletes = DeleteDetection("soft", "o_orderstatus", "F")
    return _job(t, Incremental("timestamp", "o_orderdate", merge="full", deletes=deletes))


@book.query(f"SELECT * FROM ({_FIRST}) f UNION ALL SELECT n.* FROM ({_NEW}) n ANTI JOIN ({_FIRST}) f ON f.o_orderkey = n.o_orderkey")
def run_job_insert_only(t):
    return _job(t, Incremental("timestamp", "o_orderdate", merge="insert_only"))


def _runs(t: Tables, *runs: tuple[DataFrame, dict], pairs=None, clock=None) -> DataFrame:
    """Runs of one job, each with its source and settings; what readers see after the last."""
    table, folder = _table(), shared_folder(t.spark, "job")
    for day, (source, more) in enumerate(runs, start=1):
        how = Incremental("timestamp", **{"tracking_column": "o_orderdate", **more.get("incremental", {})})
        spec = JobSpec("orders", source, table, folder, ["o_orderkey"], pairs, how, more.get("options", Options()))
        run_job(t.spark, spec, f"{folder}/states", clock or f"2024-01-{day:02d} 00:00:00")
    return _published(t, table)


@book.query("SELECT * FROM orders")
def run_job_top(t):
    """Three runs of at most half the rows each leave what one full refresh leaves."""
    half = {"options": Options(top=t.orders.count() // 2 + 1)}
    return _runs(t, (t.orders, half), (t.orders, half), (t.orders, half))


@book.query("SELECT * FROM orders")
def run_job_forced_back(t):
    """A forced full run over a source that was set back lowers the mark."""
    early = t.orders.where(F.col("o_orderdate") < ntz("1998-01-01"))
    return _runs(t, (t.orders, {}), (early, {"incremental": {"force_full": True}}), (t.orders, {}))


@book.query("SELECT o_orderkey, o_totalprice FROM orders")
def run_job_latest_unmapped(t):
    """Of copies the newest counts by a tracking column that the mapping drops."""
    older = t.orders.withColumn("o_totalprice", F.col("o_totalprice") + 1000).withColumn("o_orderdate", F.col("o_orderdate") - F.expr("INTERVAL '1' DAY"))
    both = older.unionByName(t.orders)
    early = both.where(F.col("o_orderdate") < ntz("1998-01-01"))
    latest = {"incremental": {"on_duplicate": "latest"}}
    return _runs(t, (early, latest), (both, latest), (both.where("false"), latest),
                 pairs=[("o_orderkey", "o_orderkey"), ("o_totalprice", "o_totalprice")]).select("o_orderkey", "o_totalprice")


@book.query("SELECT o_orderkey, o_totalprice FROM orders")
def run_job_zoned(t):
    """Marks of zoned instants hold in a session of another zone."""
    stamped = t.orders.withColumn("at", F.timestamp_seconds(F.col("o_orderkey") * 60))
    middle = t.orders.agg(F.max("o_orderkey")).first()[0] // 2
    own, by = t.spark.conf.get("spark.sql.session.timeZone"), {"incremental": {"tracking_column": "at"}}
    table, folder = _table(), shared_folder(t.spark, "job")
    try:
        for zone, source in (("Asia/Tokyo", stamped.where(F.col("o_orderkey") <= middle)), ("UTC", stamped)):
            t.spark.conf.set("spark.sql.session.timeZone", zone)
            spec = JobSpec("orders", source, table, folder, ["o_orderkey"], [("o_orderkey", "o_orderkey"), ("o_totalprice", "o_totalprice")], Incremental("timestamp", **by["incremental"]))
            run_job(t.spark, spec, f"{folder}/states", AS_OF if zone == "UTC" else "2024-01-30 00:00:00")
    finally:
        t.spark.conf.set("spark.sql.session.timeZone", own)
    return _published(t, table)


@book.query("""
    SELECT 'orders' AS config_id, 'Success' AS status, CAST(count(*) AS BIGINT) AS rows_read, FALSE AS has_error FROM orders
    UNION ALL SELECT 'orders', 'Failed', CAST(NULL AS BIGINT), TRUE""")
def run_job_history(t):
    """One good run and one that its guard refuses."""
    table, folder = _table(), shared_folder(t.spark, "job")
    for options, clock in ((Options(), "2024-01-30 00:00:00"), (Options(min_rows=2**40), AS_OF)):
        spec = JobSpec("orders", t.orders, table, folder, ["o_orderkey"], options=options)
        try:
            run_job(t.spark, spec, f"{folder}/states", clock, history_path=f"{folder}/history")
        except guards.GuardError:
            pass
    t.spark.sql(f"DROP TABLE {table}")
    return read_history(t.spark, f"{folder}/history").select(
        "config_id", "status", "rows_read", F.col("error_message").isNotNull().alias("has_error")
    )


@book.query(f"""
    SELECT CAST(coalesce(n.o_orderkey, f.o_orderkey) AS VARCHAR) AS pk_value,
           CASE WHEN f.o_orderkey IS NULL THEN 'INSERT' WHEN n.o_orderkey IS NULL THEN 'DELETE'
                WHEN f.o_totalprice <> n.o_totalprice THEN 'UPDATE' ELSE 'UNCHANGED' END AS change_type,
           CASE WHEN f.o_orderkey IS NULL THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '2024-01-30 00:00:00' END AS first_seen
    FROM ({_FIRST}) f FULL JOIN orders n ON n.o_orderkey = f.o_orderkey""")
def run_job_snapshot_stored(t):
    """The snapshot that a job keeps, after its second run."""
    table, folder = _table(), shared_folder(t.spark, "job")
    early = t.stale_orders.where(F.col("o_orderdate") < ntz("2000-01-01"))
    for source, clock in ((early, "2024-01-30 00:00:00"), (t.orders, AS_OF)):
        run_job(t.spark, JobSpec("007", source, table, folder, ["o_orderkey"], incremental=Incremental("snapshot")), f"{folder}/states", clock)
    t.spark.sql(f"DROP TABLE {table}")
    return snapshot.get_snapshot(t.spark, f"{folder}/snapshots", "007").select("pk_value", "change_type", "first_seen")

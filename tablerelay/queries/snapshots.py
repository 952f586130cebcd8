"""Row hashes and snapshots of orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablerelay.functions import identity
from tablerelay.operators import snapshot
from tablerelay.queries.book import Book
from tablerelay.queries.fixtures import AS_OF
from tablerelay.session import shared_folder

book = Book()
QUERIES, SQL = book.queries, book.sql

EARLIER = "2024-01-01 00:00:00"
_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
_HASH = "base64(unhex(sha256(concat({}))))".format(", ".join(f"CAST({c} AS VARCHAR), '|'" for c in _COLUMNS))


def _snapshot_sql(table: str) -> str:
    return f"SELECT CAST(o_orderkey AS VARCHAR) AS pk_value, {_HASH} AS row_hash, o_orderkey FROM {{{table}}}"


_OLD, _NEW = _snapshot_sql("priced_stale_orders"), _snapshot_sql("priced_orders")
_DIFF = f"""
    SELECT coalesce(n.pk_value, o.pk_value) AS pk_value, n.pk_value AS new_pk, o.pk_value AS old_pk,
           coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, n.row_hash AS new_hash, o.row_hash AS old_hash,
           CASE WHEN o.pk_value IS NULL THEN 'INSERT' WHEN n.pk_value IS NULL THEN 'DELETE'
                WHEN n.row_hash <> o.row_hash THEN 'UPDATE' END AS change_type
    FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.pk_value = n.pk_value"""


def _take(df, job: str, when: str):
    return snapshot.build_snapshot(df, job, ["o_orderkey"], when, [F.col(c) for c in _COLUMNS], "compat")


def _old(t, job="orders"):
    return _take(t.priced_stale_orders, job, EARLIER)


def _new(t, job="orders", when=AS_OF):
    return _take(t.priced_orders, job, when)


@book.query("""
    SELECT o_orderkey, strftime(TIMESTAMP '2024-11-03 04:00:00' + INTERVAL 1 MINUTE * (o_orderkey % 180), '%Y-%m-%dT%H:%M:%S.%f') || 'Z||' || o_orderkey AS pk_value
    FROM orders""")
def row_key_zoned(t):
    """Keys of instants around a clock change, in the zone where the clock changes."""
    at = F.timestamp_seconds(F.lit(1730606400) + 60 * (F.col("o_orderkey") % 180))
    rows = t.orders.select("o_orderkey", at.alias("at"))
    own = t.spark.conf.get("spark.sql.session.timeZone")
    try:
        t.spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        path = shared_folder(t.spark, "zoned-keys")
        rows.select("o_orderkey", identity.row_key([F.col("at"), F.col("o_orderkey")]).alias("pk_value")).write.parquet(path)
    finally:
        t.spark.conf.set("spark.sql.session.timeZone", own)
    return t.spark.read.parquet(path)


@book.query(f"SELECT o_orderkey, {_HASH} AS row_hash FROM {{priced_orders}}")
def row_hash(t):
    return t.priced_orders.select(
        "o_orderkey", identity.row_hash([F.col(c) for c in _COLUMNS], "compat").alias("row_hash")
    )


@book.query("""
    SELECT doc_id, base64(unhex(sha256(concat(coalesce(text, 'NULL'), '|', coalesce(lang, 'NULL'), '|')))) AS row_hash
    FROM documents""")
def row_hash_texts(t):
    return t.documents.select("doc_id", identity.row_hash([F.col("text"), F.col("lang")], "compat").alias("row_hash"))


@book.query("""
    SELECT l_orderkey, l_linenumber, l_partkey,
           concat(CAST(l_orderkey AS VARCHAR), '||', coalesce(CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_linenumber AS VARCHAR) END, 'NULL')) AS row_key
    FROM lineitem""")
def row_key(t):
    line = F.when(F.col("l_returnflag") != "R", F.col("l_linenumber"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", identity.row_key([F.col("l_orderkey"), line], "compat").alias("row_key")
    )


@book.query("""
    SELECT p_partkey, concat(replace(replace(concat(p_brand, '|', p_type), '\\', '\\\\'), '|', '\\|'), '||',
           coalesce(CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END, '\\N')) AS row_key
    FROM part""")
def row_key_safe(t):
    """Bars inside a key and missing parts stay apart from what joins the parts."""
    parts = [F.concat("p_brand", F.lit("|"), "p_type"), F.when(F.col("p_size") % 3 != 0, F.col("p_size"))]
    return t.part.select("p_partkey", identity.row_key(parts).alias("row_key"))


@book.query("""
    SELECT o_orderkey, base64(unhex(sha256(concat('{"c0":', o_orderkey, ',"c1":"', o_orderstatus, '","c2":"',
           strftime(o_orderdate + to_microseconds(o_orderkey % 1000), '%Y-%m-%dT%H:%M:%S.%f'), '","c3":',
           CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '"x"' END, '}')))) AS row_hash
    FROM orders""")
def row_hash_safe(t):
    """Instants count to the microsecond, and NULL is no text."""
    stamp = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("o_orderkey") % 1000) / F.lit(1_000_000))
    values = [F.col("o_orderkey"), F.col("o_orderstatus"), stamp.cast("timestamp_ntz"), F.when(F.col("o_orderkey") % 2 != 0, "x")]
    return t.orders.select("o_orderkey", identity.row_hash(values).alias("row_hash"))


@book.query(f"SELECT pk_value, change_type FROM ({_DIFF}) d WHERE change_type IS NOT NULL")
def snapshot_diff(t):
    return snapshot.snapshot_diff(_old(t), _new(t))


@book.query(f"""
    SELECT d.o_orderkey, p.o_custkey, p.o_orderstatus, p.o_totalprice, p.o_orderdate, d.change_type
    FROM ({_DIFF}) d LEFT JOIN {{priced_orders}} p ON p.o_orderkey = d.o_orderkey WHERE d.change_type IS NOT NULL""")
def snapshot_changes(t):
    return snapshot.snapshot_changes(
        t.priced_stale_orders, t.priced_orders, ["o_orderkey"], list(_COLUMNS), "compat"
    )


@book.query(f"""
    SELECT 'orders' AS job_id, pk_value, coalesce(new_hash, old_hash) AS row_hash,
           CASE WHEN old_pk IS NULL THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '{EARLIER}' END AS first_seen,
           CASE WHEN new_pk IS NULL THEN TIMESTAMP '{EARLIER}' ELSE TIMESTAMP '{AS_OF}' END AS last_seen,
           coalesce(change_type, 'UNCHANGED') AS change_type
    FROM ({_DIFF}) d""")
def snapshot_merge_seen(t):
    return snapshot.snapshot_merge_seen(_old(t), _new(t), AS_OF)


LATER = "2024-02-29 00:00:00"


@book.query(f"""
    SELECT 'orders' AS job_id, pk_value, coalesce(old_hash, new_hash) AS row_hash,
           CASE WHEN old_pk IS NULL THEN TIMESTAMP '{AS_OF}' WHEN new_pk IS NULL THEN TIMESTAMP '{LATER}' ELSE TIMESTAMP '{EARLIER}' END AS first_seen,
           CASE WHEN old_pk IS NULL THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '{LATER}' END AS last_seen,
           CASE WHEN old_pk IS NULL THEN 'DELETE' WHEN new_pk IS NULL THEN 'INSERT' WHEN old_hash <> new_hash THEN 'UPDATE' ELSE 'UNCHANGED' END AS change_type
    FROM ({_DIFF}) d""")
def snapshot_returning_key(t):
    """Keys leave and come back: the third snapshot is the first again."""
    second = snapshot.snapshot_merge_seen(_old(t), _new(t), AS_OF)
    return snapshot.snapshot_merge_seen(second, _take(t.priced_stale_orders, "orders", LATER), LATER)


def _saved(t):
    """Two jobs' snapshots, of which one was then saved again."""
    path = shared_folder(t.spark, "snapshots")
    snapshot.save_snapshot(_old(t), path)
    snapshot.save_snapshot(_old(t, "copy"), path)
    snapshot.save_snapshot(_new(t), path)
    return path


_COLS = "job_id, pk_value, row_hash, first_seen, last_seen, change_type"
_STORED = f"""
    SELECT 'orders' AS job_id, pk_value, row_hash, TIMESTAMP '{AS_OF}' AS first_seen, TIMESTAMP '{AS_OF}' AS last_seen,
           'INSERT' AS change_type FROM ({_NEW}) n
    UNION ALL
    SELECT 'copy', pk_value, row_hash, TIMESTAMP '{EARLIER}', TIMESTAMP '{EARLIER}', 'INSERT' FROM ({_OLD}) o"""


def _both(t):
    return _new(t).unionByName(_old(t, "copy"))


@book.query(_STORED)
def save_snapshot(t):
    return t.spark.read.parquet(_saved(t))


@book.query(f"SELECT * FROM ({_STORED}) s WHERE job_id = 'copy'")
def get_snapshot(t):
    return snapshot.get_snapshot(t.spark, _saved(t), "copy")


@book.query(f"SELECT * FROM ({_STORED}) s WHERE job_id <> 'orders'")
def drop_snapshot(t):
    return snapshot.drop_snapshot(_both(t), "orders")


@book.query(f"""
    SELECT job_id, CAST(count(*) AS BIGINT) AS row_count, max(last_seen) AS last_snapshot_time, TRUE AS has_snapshot
    FROM ({_STORED}) s GROUP BY job_id""")
def snapshot_stats(t):
    return snapshot.snapshot_stats(_both(t))


@book.query(f"""
    SELECT job_id, max(last_seen) AS last_snapshot_date, CAST(count(*) AS BIGINT) AS total_rows,
           CAST(sum(CAST(CAST(concat('0x', substr(sha256(concat(pk_value, '|', row_hash)), 1, 15)) AS BIGINT) AS DECIMAL(38, 0))) AS VARCHAR) AS snapshot_hash
    FROM ({_STORED}) s GROUP BY job_id""")
def snapshot_metadata(t):
    return snapshot.snapshot_metadata(_both(t))


@book.query(f"SELECT * FROM ({_STORED}) s WHERE last_seen >= TIMESTAMP '2024-01-21 00:00:00'")
def retention_snapshots(t):
    return snapshot.retention_snapshots(_both(t), AS_OF, 10)


@book.query(f"SELECT pk_value, change_type FROM ({_DIFF}) d WHERE change_type IS NOT NULL")
def snapshot_diff_stored(t):
    """The difference to a snapshot that is stored in buckets by key and doesn't move."""
    table = f"snapshot_{uuid.uuid4().hex}"
    path = shared_folder(t.spark, "stored")
    snapshot.store_snapshot(_old(t), table, path, "v1")
    found = snapshot.snapshot_diff(t.spark.table(table), _new(t))
    kept = shared_folder(t.spark, "diff")
    found.write.parquet(kept)
    snapshot.drop_stored(t.spark, table)
    return t.spark.read.parquet(kept)

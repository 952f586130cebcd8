"""Snapshots of a table: one hash per key, kept per job, compared between runs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablerelay.functions.identity import row_hash, row_key
from tablerelay.operators.keys import columns_of, find_keys, latest_of_group, quoted
from tablerelay.session import before, ntz


SNAPSHOT_SCHEMA = (
    "pk_value string, row_hash string, first_seen timestamp_ntz, last_seen timestamp_ntz, change_type string, job_id string"
)


def build_snapshot(
    df: DataFrame,
    job_id: str,
    keys: Sequence[str],
    as_of: str | dt.datetime,
    values: Sequence[Column] | None = None,
    encoding: str = "safe",
) -> DataFrame:
    """(job_id, pk_value, row_hash, first_seen, last_seen, change_type) of a table as it is.

    Rows that share a key count as one, with the greatest of their hashes; the aggregate
    reduces them before the shuffle.
    """
    names = find_keys(df, keys)
    hashed = columns_of(df.columns) if values is None else list(values)
    rows = df.select(
        row_key(columns_of(names), encoding).alias("pk_value"),
        row_hash(hashed, encoding).alias("row_hash"),
    )
    return rows.groupBy("pk_value").agg(F.max("row_hash").alias("row_hash")).select(
        F.lit(job_id).alias("job_id"),
        "pk_value",
        "row_hash",
        ntz(as_of).alias("first_seen"),
        ntz(as_of).alias("last_seen"),
        F.lit("INSERT").alias("change_type"),
    )


def _change_type(old_hash: Column, new_hash: Column) -> Column:
    return (
        F.when(old_hash.isNull(), "INSERT")
        .when(new_hash.isNull(), "DELETE")
        .when(old_hash != new_hash, "UPDATE")
    )


def _living(stored: DataFrame) -> DataFrame:
    """A stored snapshot without the keys that had left before."""
    if "change_type" not in stored.columns:
        return stored
    return stored.where(~F.col("change_type").eqNullSafe("DELETE"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(pk_value, change_type) for the keys that were inserted, updated or deleted.

    Keys that ``old`` only keeps on record as deleted were not there.
    """
    before_side = _living(old).select("pk_value", F.col("row_hash").alias("_old"))
    after_side = new.select("pk_value", F.col("row_hash").alias("_new"))
    return (
        before_side.join(after_side, "pk_value", "full")
        .select("pk_value", _change_type(F.col("_old"), F.col("_new")).alias("change_type"))
        .where(F.col("change_type").isNotNull())
    )


def snapshot_changes(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    values: Sequence[str | Column] | None = None,
    encoding: str = "safe",
) -> DataFrame:
    """The rows themselves: new and changed rows of ``new``, and the bare keys of deleted ones.

    Key and hash are computed beside the row, so one join gives the rows as well. Of rows
    that share a key, the one with the greatest hash counts, as in a snapshot. ``values``
    names what is hashed, in columns of either table.
    """
    names = find_keys(new, keys)
    hashed = columns_of(new.columns) if values is None else [
        F.expr(v) if isinstance(v, str) else v for v in values
    ]
    key, digest = row_key(columns_of(names), encoding), row_hash(hashed, encoding)
    before_side = latest_of_group(
        old.select(key.alias("_pk"), digest.alias("_old"), *[F.col(quoted(k)).alias(f"_was_{k}") for k in names]),
        ["_pk"], ["_old"],
    )
    after_side = latest_of_group(new.select(key.alias("_pk"), digest.alias("_new"), *columns_of(new.columns)), ["_pk"], ["_new"])

    def value(column: str) -> Column:
        own = F.col(quoted(column))
        return F.coalesce(own, F.col(quoted(f"_was_{column}"))).alias(column) if column in names else own

    return (
        before_side.join(after_side, "_pk", "full")
        .select(*[value(c) for c in new.columns], _change_type(F.col("_old"), F.col("_new")).alias("change_type"))
        .where(F.col("change_type").isNotNull())
    )


def snapshot_merge_seen(stored: DataFrame, current: DataFrame, as_of: str | dt.datetime) -> DataFrame:
    """The stored snapshot brought up to date.

    Keys still there get a new last_seen; first_seen stays. Keys that left stay on
    record, marked DELETE, with the last_seen they had; one that comes back is an INSERT
    with a new first_seen.
    """
    was_there = ~F.col("change_type").eqNullSafe("DELETE")
    old = stored.select(
        "job_id", "pk_value", F.col("row_hash").alias("_kept"), F.when(was_there, F.col("row_hash")).alias("_old"),
        F.when(was_there, F.col("first_seen")).alias("_first"), F.col("first_seen").alias("_began"),
        F.col("last_seen").alias("_last"),
    )
    new = current.select("job_id", "pk_value", F.col("row_hash").alias("_new"))
    gone = F.col("_new").isNull()
    changed = F.when(gone, "DELETE").otherwise(_change_type(F.col("_old"), F.col("_new")))
    return old.join(new, ["job_id", "pk_value"], "full").select(
        "job_id",
        "pk_value",
        F.coalesce("_new", "_kept").alias("row_hash"),
        F.when(gone, F.col("_began")).otherwise(F.coalesce(F.col("_first"), ntz(as_of))).alias("first_seen"),
        F.when(gone, F.col("_last")).otherwise(ntz(as_of)).alias("last_seen"),
        F.coalesce(changed, F.lit("UNCHANGED")).alias("change_type"),
    )


def save_snapshot(snapshot: DataFrame, path: str) -> None:
    """Replace the snapshots of the jobs in ``snapshot``; other jobs are not touched.

    The snapshot must not be read from ``path`` itself.
    """
    (
        snapshot.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("job_id")
        .parquet(path)
    )


def store_snapshot(snapshot: DataFrame, table: str, folder: str, version: str, buckets: int | None = None) -> None:
    """Store a snapshot in buckets by key, each sorted, and show it to readers of ``table``.

    ``table`` is a view of the version shown last, so the snapshot may be made from it: one change of
    the view replaces it, and the version before it goes. Joins on the key then move the other side
    only, if that is dealt out to as many partitions: ``buckets``, by default the session's number.
    """
    spark = snapshot.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{table}__{version}"
    placed = snapshot.repartition(n, "pk_value")
    placed.write.mode("overwrite").bucketBy(n, "pk_value").sortBy("pk_value").option("path", f"{folder.rstrip('/')}/{version}").saveAsTable(name)
    old = stored_versions(spark, table)
    spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM {name}")
    for before in old:
        if before != name:
            spark.sql(f"DROP TABLE {before}")


def stored_versions(spark: SparkSession, table: str) -> list[str]:
    """The tables that hold versions of a stored snapshot."""
    base = table.rsplit(".", 1)
    place = f" IN {base[0]}" if len(base) > 1 else ""
    found = spark.sql(f"SHOW TABLES{place} LIKE '{base[-1]}__*'").collect()
    return [".".join([*base[:-1], r["tableName"]]) for r in found]


def drop_stored(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP VIEW IF EXISTS {table}")
    for name in stored_versions(spark, table):
        spark.sql(f"DROP TABLE {name}")


def get_snapshot(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    """One job's snapshot; only its partition is read."""
    stored = _read(spark, path)
    return stored.where(F.col("job_id") == job_id)


def stored_snapshot(spark: SparkSession, path: str, job_id: str) -> DataFrame | None:
    """One job's snapshot, or None where none was saved."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    found = get_snapshot(spark, path, job_id)
    return None if found.isEmpty() else found


def _read(spark: SparkSession, path: str) -> DataFrame:
    # Folder names are read as text, whatever they look like.
    return spark.read.schema(SNAPSHOT_SCHEMA).parquet(path)


def drop_snapshot(stored: DataFrame, job_id: str) -> DataFrame:
    """The snapshot table without one job."""
    return stored.where(F.col("job_id") != job_id)


def snapshot_stats(stored: DataFrame) -> DataFrame:
    """Rows and time of the latest entry per job."""
    return stored.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.max("last_seen").alias("last_snapshot_time"),
        (F.count(F.lit(1)) > 0).alias("has_snapshot"),
    )


def snapshot_metadata(stored: DataFrame) -> DataFrame:
    """Per job: date, rows, and a hash over all rows that does not depend on their order.

    Each row gives the first 60 bits of a SHA-256 over key and hash; their exact sum
    changes with any row added, lost or altered.
    """
    digest = F.sha2(F.concat("pk_value", F.lit("|"), "row_hash").cast("binary"), 256)
    bits = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
    return stored.groupBy("job_id").agg(
        F.max("last_seen").alias("last_snapshot_date"),
        F.count(F.lit(1)).alias("total_rows"),
        F.sum(bits).cast("string").alias("snapshot_hash"),
    )


def retention_snapshots(stored: DataFrame, as_of: str | dt.datetime, days: int) -> DataFrame:
    """Snapshot rows seen within the last ``days``."""
    return stored.where(F.col("last_seen") >= before(as_of, days=days))

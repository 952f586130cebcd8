"""Upserting a stream of rows, or a change feed, into a table.

Each micro-batch only appends to a log of batches, at a cost that follows the batch and
not the table. One merge at the end of a run brings the log into the table. A batch's
folder is named by its id, so a batch that Spark repeats replaces itself.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablerelay.operators.changes import apply_changes, clashing, settled_changes
from tablerelay.operators.keys import columns_of, find_keys, key_set, latest_of_group, latest_per_key, quoted, sortable, without_keys
from tablerelay.operators.mapping import align_to_target, insert_by_name
from tablerelay.plans import buckets
from tablerelay.plans.buckets import table_property
from tablerelay.plans.publish import Load, full_refresh_swap, remove_folder, table_location, version_path
from tablerelay.spec import Options


#: How many small clocks are kept before they become one.
CLOCKS = 16


def log_batches(
    stream: DataFrame, log_path: str, checkpoint: str, keys: Sequence[str], order_by: Sequence[str], whole: bool = False
) -> StreamingQuery:
    """Take everything that has arrived and append it to the log, one row per key and batch.

    ``whole`` keeps all rows: of a change feed, events of one age are to be compared.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        rows = batch if whole else newest_rows(batch, keys, order_by)
        rows.write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _tie(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> Column:
    """What settles rows of one key and age, wherever batches begin: a hash of their other columns."""
    aside = {*keys, *order_by, "batch_id"}
    return F.xxhash64(F.lit(0), *columns_of([f.name for f in df.schema.fields if f.name not in aside and sortable(f.dataType)]))


def newest_rows(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, whatever batches it came in; rows with a NULL key are all kept."""
    return latest_per_key(df.withColumn("_tie", _tie(df, keys, order_by)), keys, [*order_by, "_tie"]).drop("_tie")


def read_batches(spark: SparkSession, log_path: str, schema: str, after: int = -1) -> DataFrame:
    """Logged rows of the batches after a given one, with their ``batch_id``; none where
    nothing has arrived yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log_path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{schema}, batch_id bigint")
    logged = spark.read.schema(f"{schema}, batch_id bigint").parquet(log_path)
    return logged.where(F.col("batch_id") > after)


def not_outdated(rows: DataFrame, clock: DataFrame, keys: Sequence[str], order_by: Sequence[str], clash: Column | None = None) -> DataFrame:
    """``rows`` (one per key, with ``_tie``) without those older than what the clock has of their key.

    Of one age the greater ``_tie`` wins, a missing one loses; with ``clash`` different ones
    raise that error. Rows with a NULL key are all kept.
    """
    ours, theirs = (F.struct(*[F.col(f"{side}.{quoted(c)}") for c in order_by]) for side in ("r", "c"))
    tie, known = F.col("r._tie"), F.col("c._tie")
    same_age = (tie >= known) if clash is None else F.when(tie != known, clash.cast("boolean")).otherwise(True)
    later = F.when(ours == theirs, F.coalesce(same_age, F.lit(True))).otherwise(ours > theirs)
    on = [F.col(f"r.{quoted(k)}") == F.col(f"c.{quoted(k)}") for k in keys]
    found = clock.withColumn("_known", F.lit(True)).alias("c")
    joined = rows.alias("r").join(found, on, "left").where(F.col("c._known").isNull() | later)
    return joined.select(*[F.col(f"r.{quoted(c)}") for c in rows.columns])


def own_clock(target: DataFrame, rows: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame | None:
    """What the target's rows say of their age, for the keys of ``rows``; None without such columns."""
    has = {c.lower() for c in target.columns}
    if not all(c.lower() in has for c in (*keys, *order_by)):
        return None
    named = target.select(*columns_of([*keys, *order_by])).join(key_set(rows, keys), list(keys), "left_semi")
    aged = named.groupBy(*columns_of(keys)).agg(F.max(F.struct(*columns_of(order_by))).alias("_age"))
    ages = [F.col("_age").getField(c).alias(c) for c in order_by]
    return aged.select(*columns_of(keys), *ages, F.lit(None).cast("bigint").alias("_tie"))


def fold_rows(
    target: DataFrame, logged: DataFrame, keys: Sequence[str], order_by: Sequence[str], clock: DataFrame | None = None
) -> DataFrame:
    """The target after the logged rows: for each key the newest row wins, in whatever batch it
    came. A row older than the target's, or than the ``clock``'s of its key, is too late."""
    newest = _due(target, logged, keys, order_by, clock)
    return insert_by_name(without_keys(target, key_set(newest, keys), keys), newest.drop("_tie"))


def _due(target: DataFrame, logged: DataFrame, keys: Sequence[str], order_by: Sequence[str], clock: DataFrame | None) -> DataFrame:
    """The newest logged row of each key, with ``_tie``, where it is not too late."""
    rows = newest_rows(logged.drop("batch_id"), keys, order_by)
    rows = rows.withColumn("_tie", _tie(rows, keys, order_by))
    for known in (clock, own_clock(target, rows, keys, order_by)):
        rows = rows if known is None else not_outdated(rows, known, keys, order_by)
    return rows


def _due_changes(target: DataFrame, logged: DataFrame, keys: Sequence[str], version: str, op: str, clock: DataFrame | None) -> DataFrame:
    """The newest logged event of each key, with ``_gone`` and ``_tie``, where it is not too late."""
    events = settled_changes(logged.drop("batch_id"), keys, version, op, target.columns).withColumnRenamed("_said", "_tie")
    return events if clock is None else not_outdated(events, clock, keys, [version], clashing([F.col(f"r.{quoted(k)}") for k in keys]))


def fold_changes(
    target: DataFrame, logged: DataFrame, keys: Sequence[str], version: str, op: str, clock: DataFrame | None = None
) -> DataFrame:
    """The target after logged inserts, updates and deletes; those older than what the ``clock``
    has of their key are too late, also where the key was deleted."""
    if clock is None:
        return apply_changes(target, logged.drop("batch_id"), keys, version, op)
    due = _due_changes(target, logged, keys, version, op, clock)
    kept = without_keys(target, key_set(due, keys), keys)
    return kept.unionByName(align_to_target(due.where(~F.col("_gone")).drop("_gone", "_tie"), target.schema))


def stream_upsert(
    target: DataFrame,
    stream: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    log_path: str,
    checkpoint: str,
    op: str | None = None,
    after: int = -1,
) -> DataFrame:
    """Take in what has arrived since the last run and return the target with it merged.

    With ``op`` the stream is a change feed whose version is ``order_by``'s column.
    ``after`` is the last batch that an earlier run already published.
    """
    logged = _taken_in(target.sparkSession, stream, keys, order_by, log_path, checkpoint, after, op)
    return _folded(target, logged, keys, order_by, op)


def _taken_in(spark, stream, keys, order_by, log_path, checkpoint, after, op) -> DataFrame:
    log_batches(stream, log_path, checkpoint, keys, order_by, whole=op is not None).awaitTermination()
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in stream.schema.fields)
    return read_batches(spark, log_path, schema, after)


def _folded(target, logged, keys, order_by, op, clock=None) -> DataFrame:
    if op is None:
        return fold_rows(target, logged, keys, order_by, clock)
    return fold_changes(target, logged, keys, order_by[0], op, clock)


def published_batch(spark: SparkSession, table: str) -> int:
    """The last batch in a table that :func:`publish_stream` keeps; -1 before the first.

    It is part of the version's name, so one change shows the rows and says how far they go. A
    table in buckets has it as a property, set after the rows are shown: batches that a lost
    run has merged already are merged again, which changes nothing.
    """
    found = re.search(r"-batch(\d+)$", (table_location(spark, table) or "").rstrip("/"))
    if found is None:
        found = re.search(r"(\d+)$", table_property(spark, table, _POSITION) or "") if spark.catalog.tableExists(table) else None
    return int(found[1]) if found else -1


_POSITION = "relay.batch"


def _folders(spark: SparkSession, path: str) -> list[str]:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(root)) if files.exists(root) else []


def read_clock(spark: SparkSession, folder: str, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame | None:
    """The age of the newest event of every key that a stream has published, deleted ones too.

    Every run adds the keys of its own batches; the newest entry of a key counts. Entries of a
    run that died before it published are those of events that the next run takes again.
    """
    entries = [n for n in _folders(spark, f"{folder}/clocks") if "_SUCCESS" in _folders(spark, f"{folder}/clocks/{n}")]
    if not entries:
        return None
    rows = spark.read.parquet(*[f"{folder}/clocks/{n}" for n in entries])
    return latest_of_group(rows, keys, [*order_by, "_tie"])


def _add_to_clock(spark: SparkSession, folder: str, due: DataFrame, keys: Sequence[str], order_by: Sequence[str], name: str) -> None:
    entries = due.dropna(subset=list(keys)).select(*columns_of([*keys, *order_by]), "_tie")
    entries.write.mode("overwrite").parquet(f"{folder}/clocks/{name}")


def _tidy(spark: SparkSession, folder: str, keys: Sequence[str], order_by: Sequence[str], after: int) -> None:
    """Drop the log's batches that an earlier run published, and make many clocks one."""
    for name in _folders(spark, f"{folder}/log"):
        found = re.fullmatch(r"batch_id=(\d+)", name)
        if found and int(found[1]) <= after:
            remove_folder(spark, f"{folder}/log/{name}")
    names = _folders(spark, f"{folder}/clocks")
    if len(names) > CLOCKS:
        read_clock(spark, folder, keys, order_by).write.parquet(f"{folder}/clocks/{version_path('').strip('/')}-all")
        for name in names:
            remove_folder(spark, f"{folder}/clocks/{name}")


def publish_stream(
    spark: SparkSession,
    table: str,
    folder: str,
    stream: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    op: str | None = None,
    options: Options | None = None,
    bucket: str | None = None,
) -> Load | None:
    """Take in what has arrived, merge only the batches not yet published, and flip.

    What is published does not depend on where batches or runs begin: an event that comes
    later than a newer one of its key, or than its delete, changes nothing. A run that dies
    before the flip is made good by the next, which folds the same batches. None where
    nothing new has come. The guards of a full refresh hold.

    With ``bucket``, an expression over the keys, only the buckets that the batches fall into
    are read and written; such a table is one of :mod:`tablerelay.plans.buckets`, its guards
    are those of merges, and rows without a key are left out of it.
    """
    after = published_batch(spark, table)
    logged = _taken_in(spark, stream, keys, order_by, f"{folder}/log", f"{folder}/checkpoint", after, op)
    last = logged.agg(F.max("batch_id")).first()[0]
    if last is None:
        return None
    order = list(order_by) if op is None else [order_by[0]]
    target, clock = spark.table(table), read_clock(spark, folder, keys, order)
    version = f"{version_path('', None).rsplit('=', 1)[-1]}-batch{last}"
    # What is due is written once: for the clock, for the merge and, in buckets, for the counts.
    stage = version_path(f"{folder}/due", version)
    try:
        found = _due(target, logged, keys, order, clock) if op is None else _due_changes(target, logged, keys, order[0], op, clock)
        found.write.parquet(stage)
        due = spark.read.schema(found.schema).parquet(stage)
        _add_to_clock(spark, folder, due, keys, order, version)
        if bucket is not None:
            load = _publish_buckets(spark, table, folder, due, keys, bucket, op)
            spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{_POSITION}' = '{last}')")
        else:
            living = due if op is None else due.where(~F.col("_gone"))
            rows = align_to_target(living.drop("_gone", "_tie"), target.schema)
            merged = insert_by_name(without_keys(target, key_set(due, keys), keys), rows)
            load = full_refresh_swap(merged, table, folder, options, version)
    finally:
        remove_folder(spark, stage)
    _tidy(spark, folder, keys, order, after)
    return load


def _publish_buckets(spark: SparkSession, table: str, folder: str, due: DataFrame, keys: Sequence[str], bucket: str, op: str | None) -> Load:
    schema = buckets.rows_schema(spark, table)
    keyed = due.dropna(subset=list(keys))
    living = keyed if op is None else keyed.where(~F.col("_gone"))
    rows = align_to_target(living.drop("_gone", "_tie"), schema)
    names = find_keys(rows, keys)
    layout = buckets.current_layout(spark, table, folder, names, bucket)
    if op is None:
        changes = buckets.merge_buckets(spark, table, folder, layout, rows, names, bucket)
    else:
        wanted = T.StructType([schema[n] for n in names])
        gone = key_set(align_to_target(keyed.where("_gone").select(*columns_of(keys)), wanted), names)
        touched = buckets.flagged_buckets(spark, schema, layout, gone, names, bucket)
        changes = buckets.merge_buckets(spark, table, folder, layout, rows, names, bucket, buckets.full_by_flag(gone), touched)
    buckets.drop_old_layouts(spark, folder)
    return Load(table_location(spark, table), sum(changes.values()), changes)

"""Publishing: a table's rows live in version folders, and readers follow one of them.

A load writes a new folder beside the current one. Once its guards hold, one
``ALTER TABLE .. SET LOCATION`` shows it to readers; a failed load changes nothing, and
readers that began earlier finish on the files they know.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerelay.operators.keys import columns_of, find_column, find_keys, quoted
from tablerelay.operators.mapping import align_to_target
from tablerelay.operators.merge import merge_upsert
from tablerelay.plans.guards import count_parity_guard, min_row_guard
from tablerelay.session import shared_folder
from tablerelay.spec import Options


@dataclass(frozen=True)
class Load:
    """A written folder, with the figures observed while it was written."""

    path: str
    rows: int
    figures: dict[str, Any]


def load_partitioned(
    df: DataFrame,
    path: str,
    *,
    batch_rows: int | None = None,
    writers: int | None = None,
    figures: dict[str, Column] | None = None,
    mapped: Callable[[DataFrame], DataFrame] | None = None,
) -> Load:
    """Write rows in parallel, in files of at most ``batch_rows``, counting them on the way.

    ``figures`` are aggregates over ``df`` taken in the same pass; ``mapped`` then gives
    the columns that are written. ``writers`` bounds the tasks that write: the finished rows
    are dealt out to so many, and what comes before keeps its own tasks.
    The write replaces ``path``, so a retried load leaves no rows of a failed one.
    """
    seen, written = Observation(), Observation()
    rows = df.observe(seen, *[c.alias(n) for n, c in figures.items()]) if figures else df
    rows = rows if mapped is None else mapped(rows)
    rows = rows.observe(written, F.count(F.lit(1)).alias("rows"))
    if writers is not None:
        rows = rows.repartition(writers)
    writer = rows.write.mode("overwrite")
    if batch_rows is not None:
        writer = writer.option("maxRecordsPerFile", batch_rows)
    writer.parquet(path)
    return Load(path, written.get["rows"], dict(seen.get) if figures else {})


def load_clustered(df: DataFrame, path: str, column: str, *, row_group_bytes: int = 16 << 20, figures: dict[str, Column] | None = None) -> Load:
    """Write rows in the order of a tracking column, for sources that are read incrementally.

    Files hold ranges of the column and are sorted by it, in row groups whose statistics say
    what they hold: a reader of what is new skips the others. Rows of one value are spread over
    several files where they are many; rows without a value come first. Later loads that are
    appended hold newer rows, so they keep the order.
    """
    name = F.col(quoted(find_column(df.columns, column)))
    seen, written = Observation(), Observation()
    rows = df.observe(seen, *[c.alias(n) for n, c in figures.items()]) if figures else df
    # The second key tells rows of one value apart, so that ranges can cut between them.
    placed = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(name, "_row")
    ordered = placed.sortWithinPartitions(name, "_row").drop("_row").observe(written, F.count(F.lit(1)).alias("rows"))
    ordered.write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)
    return Load(path, written.get["rows"], dict(seen.get) if figures else {})


def read_load(spark: SparkSession, load: Load) -> DataFrame:
    """The written rows; their number, from the files' footers, must be the one written."""
    staged = spark.read.parquet(load.path)
    count_parity_guard(load.rows, staged.count())
    return staged


def version_path(folder: str, version: str | None = None) -> str:
    """A version's folder. Names made here sort by time, then tell runs of one time apart."""
    made = f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex}"
    return f"{folder.rstrip('/')}/v={version or made}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that no reader was ever shown, such as a stage or a refused load."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def table_location(spark: SparkSession, table: str) -> str | None:
    """The folder readers of a table follow, or None if there is no such table."""
    if not spark.catalog.tableExists(table):
        return None
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}")
    return described.where("col_name = 'Location'").head()["data_type"]


#: Marks a version folder that was shown to readers.
_SHOWN = "_shown"


def flip(spark: SparkSession, table: str, path: str) -> None:
    """Show ``path`` to readers of ``table``, in one catalog change."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mark = jvm.org.apache.hadoop.fs.Path(path, _SHOWN)
    mark.getFileSystem(conf).create(mark, True).close()
    if spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
        spark.catalog.refreshTable(table)
    else:
        spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{path}'")


def remove_unpublished(spark: SparkSession, table: str, path: str) -> None:
    """Delete a folder unless readers of ``table`` follow it by now.

    Where that can't be told, as after a fault of the catalog, the folder stays.
    """
    location = table_location(spark, table)
    if location is None or location.rstrip("/").rsplit("/", 1)[-1] != path.rstrip("/").rsplit("/", 1)[-1]:
        remove_folder(spark, path)


def drop_old_versions(spark: SparkSession, table: str, folder: str, keep: int = 2) -> list[str]:
    """Delete all but the ``keep`` newest version folders; the published one always stays.

    Keep at least two: the version before serves readers that began earlier. Names give the
    order, since not every store keeps the time of a folder. Of folders older than the
    published one, those that were never shown to readers don't count and go.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(conf)
    if not files.exists(root):
        return []
    found = {s.getPath().getName(): s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("v=")}
    current = (table_location(spark, table) or "").rstrip("/").rsplit("/", 1)[-1]
    marked = [n for n, path in found.items() if files.exists(jvm.org.apache.hadoop.fs.Path(path, _SHOWN))]
    # Folders from before there were marks all count as shown.
    shown = sorted(marked if current in marked else found, reverse=True)
    kept = {*shown[:keep], current}
    old = [n for n in found if n not in kept and (n in shown or n < current)]
    for name in old:
        files.delete(found[name], True)
    return old


def full_refresh_swap(
    df: DataFrame, table: str, folder: str, options: Options | None = None, version: str | None = None
) -> Load | None:
    """Replace a table by a guarded load and one flip. None if the guard skipped the load."""
    options, spark = options or Options(), df.sparkSession
    load = load_partitioned(
        df, version_path(folder, version), batch_rows=options.batch_rows, writers=options.writers
    )
    read_load(spark, load)
    if not min_row_guard(load.rows, options.min_rows, options.force, options.skip):
        return None
    flip(spark, table, load.path)
    return load


def full_refresh_rewrite(df: DataFrame, table: str) -> None:
    """Replace a table's rows in place, for targets whose location cannot change.

    Readers can see the table empty meanwhile; ``df`` must not read from it.
    """
    spark = df.sparkSession
    align_to_target(df, spark.table(table).schema).write.insertInto(table, overwrite=True)
    spark.catalog.refreshTable(table)


def append_load(df: DataFrame, table: str) -> None:
    """Add rows to a table by column name; duplicates are kept."""
    spark = df.sparkSession
    align_to_target(df, spark.table(table).schema).write.insertInto(table)
    spark.catalog.refreshTable(table)


def append_once(spark: SparkSession, table: str, df: DataFrame, run_name: str) -> int:
    """Add rows to a table as the part of one run; returns how many.

    The part is written beside the table and its files move into it under the run's name. A run
    that is tried again first removes what it had added, so its rows are there once. A record
    in the table's hidden folder ``_runs`` says that a part is complete.
    """
    location = table_location(spark, table)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path_of = jvm.org.apache.hadoop.fs.Path
    root, record = path_of(location), path_of(f"{location}/_runs/{run_name}")
    files = root.getFileSystem(conf)
    stage = f"{location}/_stage-{run_name}-{uuid.uuid4().hex}"
    prefix = f"part-run-{run_name}-"
    before = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith(prefix)]
    try:
        # The rows may be read from the table itself: without what the failed run had added.
        if before:
            files.delete(record, False)
            for path in before:
                files.delete(path, False)
            spark.catalog.refreshTable(table)
        load = load_partitioned(align_to_target(df, spark.table(table).schema), stage)
        read_load(spark, load)
        written = [s.getPath() for s in files.listStatus(path_of(stage)) if s.getPath().getName().startswith("part-")]
        for path in written:
            if not files.rename(path, path_of(root, prefix + path.getName().removeprefix("part-"))):
                raise OSError(f"could not move {path} into {location}")
        files.create(record, True).close()
    finally:
        remove_folder(spark, stage)
        spark.catalog.refreshTable(table)
    return load.rows


def load_direct(df: DataFrame, table: str, folder: str, append: bool = False) -> Load | None:
    """Load a table without a separate stage: replacing its rows, or adding to them."""
    if append and df.sparkSession.catalog.tableExists(table):
        append_load(df, table)
        return None
    load = load_partitioned(df, version_path(folder))
    flip(df.sparkSession, table, load.path)
    return load


def write_bucketed(df: DataFrame, path: str, bucket: str) -> Load:
    """Write a table in folders by the SQL expression ``bucket``, for :func:`merge_touched` and
    :mod:`tablerelay.plans.buckets`.

    Rows are rebalanced by bucket first, so a small bucket becomes one file, not one per
    task, and a large one is shared out among tasks.
    """
    seen = Observation()
    placed = df.withColumn("_bucket", F.expr(bucket)).hint("rebalance", F.col("_bucket"))
    counted = placed.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").partitionBy("_bucket").parquet(path)
    return Load(path, seen.get["rows"], {})


def merge_touched(
    spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], bucket: str,
    merge: Callable[..., DataFrame] = merge_upsert, **how: Any,
) -> int:
    """Merge into a bucketed table, reading and rewriting only the buckets the batch names.

    ``bucket`` is an expression over the key columns alone, so a key never changes its
    bucket. Which buckets those are is a join that prunes the scan's folders, however many.
    The merged buckets are written beside the table first; each then replaces its old
    folder. Buckets are replaced one after another, which readers can notice: for folders
    without a catalog. Tables have :func:`tablerelay.plans.buckets.merge_buckets`.
    Returns the number of rows of the replaced buckets.
    """
    names = find_keys(batch, keys)
    # Resolving the expression over the keys alone fails if it uses another column.
    touched = batch.select(*columns_of(names)).select(F.expr(bucket).alias("_bucket")).distinct()
    # Folder names are read as the expression's own type, not as what they look like.
    columns = [f for f in spark.read.parquet(path).schema.fields if f.name != "_bucket"]
    table = spark.read.schema(T.StructType([*columns, touched.schema["_bucket"]])).parquet(path)
    named = table.join(touched.where("_bucket IS NOT NULL"), "_bucket", "left_semi")
    if touched.schema["_bucket"].nullable:
        nameless = touched.where("_bucket IS NULL").select(F.lit(0).alias("_none"))
        nowhere = table.where("_bucket IS NULL").withColumn("_none", F.lit(0))
        named = named.unionByName(nowhere.join(nameless, "_none", "left_semi").select(*columns_of(named.columns)))
    merged = merge(named.drop("_bucket").select(*columns_of([f.name for f in columns])), batch, names, **how)
    stage = shared_folder(spark, "touched")
    try:
        staged = write_bucketed(merged, stage, bucket)
        replacement = spark.read.schema(table.schema).parquet(staged.path)
        count_parity_guard(staged.rows, replacement.count())
        if staged.rows:
            (
                replacement.write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("_bucket")
                .parquet(path)
            )
    finally:
        remove_folder(spark, stage)
    return staged.rows

"""Tables in buckets, each bucket in a folder of its own that the catalog points to.

A merge reads and writes only the buckets it touches. A touched bucket gets a new folder, and
one change of that partition's location shows it, so readers see the old bucket or the new
one, never a part, and no row is written twice.

A numbered layout beside the table says where each bucket lies, how many rows it has and what
its keys sum up to. It is written once all new folders are: from then on the merge counts as
done, and a run that dies while it changes locations is carried on by the next. The layout
also spares the work of listing or counting the table, and its key sums tell which buckets
of a source and its target hold different keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from decimal import Decimal
from urllib.parse import unquote

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerelay.operators.keys import any_null, columns_of, find_keys, key_set, quoted, split_null_keys, without_keys
from tablerelay.operators.mapping import insert_by_name
from tablerelay.operators.merge import merge_insert_only
from tablerelay.plans.guards import count_parity_guard
from tablerelay.plans.publish import remove_folder, table_location, version_path, write_bucketed

LAYOUT_SCHEMA = (
    "bucket string, location string, row_count bigint, key_count bigint, key_sum decimal(38,0), key_xor bigint"
)
_NUMBER, _BUCKET_BY = "relay.layout", "relay.bucket"
_NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Bucket:
    """Where a bucket lies, its rows, and the number and order-free sums of its complete keys."""

    location: str
    row_count: int
    key_count: int
    key_sum: int
    key_xor: int


@dataclass(frozen=True)
class Layout:
    """The buckets of a table by name (None for the NULL bucket), as of a numbered merge."""

    number: int
    buckets: dict[str | None, Bucket]


def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _children(spark: SparkSession, path: str) -> list[str]:
    files, folder = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []


def layout_folder(folder: str) -> str:
    return f"{folder.rstrip('/')}/layouts"


def _layout_path(folder: str, number: int) -> str:
    return f"{layout_folder(folder)}/n={number:012d}"


def layout_numbers(spark: SparkSession, folder: str) -> list[int]:
    """The complete layouts that are kept, oldest first."""
    found = sorted(int(n[2:]) for n in _children(spark, layout_folder(folder)) if n.startswith("n="))
    return [n for n in found if "_SUCCESS" in _children(spark, _layout_path(folder, n))]


def read_layout(spark: SparkSession, folder: str, number: int | None = None) -> Layout | None:
    """The latest complete layout, or a given one. One row per bucket reaches the driver."""
    numbers = layout_numbers(spark, folder)
    if number is None and not numbers:
        return None
    number = numbers[-1] if number is None else number
    rows = spark.read.schema(LAYOUT_SCHEMA).parquet(_layout_path(folder, number)).collect()
    return Layout(number, {r.bucket: Bucket(*r[1:4], int(r[4]), r[5]) for r in rows})


def _write_layout(spark: SparkSession, folder: str, layout: Layout) -> None:
    rows = [(name, b.location, b.row_count, b.key_count, Decimal(b.key_sum), b.key_xor) for name, b in layout.buckets.items()]
    spark.createDataFrame(rows, LAYOUT_SCHEMA).coalesce(1).write.mode("overwrite").parquet(_layout_path(folder, layout.number))


def key_figures(keys: Sequence[str]) -> list[Column]:
    """Aggregates over rows: how many there are, and the number and sums of complete keys.

    The sums don't depend on order, and two sets of keys that differ have different ones
    but for a chance of one in 2^100. Keys must have the same types wherever they are compared.
    """
    whole, named = ~any_null(keys), columns_of(keys)
    return [
        F.count(F.lit(1)).alias("row_count"), F.count_if(whole).alias("key_count"),
        F.coalesce(F.sum(F.when(whole, F.xxhash64(*named)).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("key_sum"),
        F.coalesce(F.bit_xor(F.when(whole, F.xxhash64(F.lit(1), *named))), F.lit(0)).alias("key_xor"),
    ]


def named_bucket(bucket: str) -> Column:
    """A bucket's name as its folder says it; the empty text is the NULL bucket there."""
    return F.nullif(F.expr(bucket).cast("string"), F.lit("")).alias("bucket")


def _measured(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], bucket: str) -> dict[str | None, Bucket]:
    """The buckets written under ``path``: one pass over their key columns."""
    names = [n for n in _children(spark, path) if n.startswith("_bucket=")]
    if not names:
        return {}
    places = {None if n == f"_bucket={_NULL_FOLDER}" else unquote(n.split("=", 1)[1]): f"{path}/{n}" for n in names}
    rows = spark.read.schema(schema).parquet(*places.values())
    counted = rows.groupBy(named_bucket(bucket)).agg(*key_figures(keys)).collect()
    return {r.bucket: Bucket(places[r.bucket], r.row_count, r.key_count, int(r.key_sum), r.key_xor) for r in counted}


def rows_schema(spark: SparkSession, table: str) -> T.StructType:
    return T.StructType([f for f in spark.table(table).schema.fields if f.name != "_bucket"])


def read_buckets(spark: SparkSession, schema: T.StructType, layout: Layout, names: Iterable[str | None] | None = None) -> DataFrame:
    """The rows of some buckets of a layout, or of all: fixed files, whatever is published later."""
    wanted = layout.buckets if names is None else [n for n in names if n in layout.buckets]
    paths = [layout.buckets[n].location for n in wanted]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _partition(name: str | None) -> str:
    escaped = None if name is None else name.replace("\\", "\\\\").replace("'", "\\'")
    return "PARTITION (_bucket = null)" if name is None else f"PARTITION (_bucket = '{escaped}')"


def table_property(spark: SparkSession, table: str, name: str) -> str | None:
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    return found.get(name)


def _show(spark: SparkSession, table: str, layout: Layout, before: Layout | None) -> None:
    """Point the catalog to a layout, bucket by bucket; ``before`` is what it shows now, if known."""
    shown = before.buckets if before is not None else {}
    new = [n for n in layout.buckets if n not in shown]
    for at in range(0, len(new), 200):
        added = " ".join(f"{_partition(n)} LOCATION '{layout.buckets[n].location}'" for n in new[at:at + 200])
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {added}")
    for name, bucket in layout.buckets.items():
        # What the catalog shows is unknown after a run that died, so each location is set.
        if (before is None) or (name in shown and shown[name].location != bucket.location):
            spark.sql(f"ALTER TABLE {table} {_partition(name)} SET LOCATION '{bucket.location}'")
    for name in set(shown) - set(layout.buckets):
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {_partition(name)}")
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{_NUMBER}' = '{layout.number}')")
    spark.catalog.refreshTable(table)


def current_layout(spark: SparkSession, table: str, folder: str, keys: Sequence[str], bucket: str) -> Layout:
    """The layout that readers see, after carrying on what a run left half shown.

    A table without one, with all its buckets below its own location, is measured first.
    """
    made_by = table_property(spark, table, _BUCKET_BY)
    if made_by is not None and made_by != bucket:
        raise ValueError(f"the table is bucketed by {made_by!r}, not by {bucket!r}")
    layout = read_layout(spark, folder)
    if layout is None:
        found = _measured(spark, table_location(spark, table), rows_schema(spark, table), keys, bucket)
        layout = Layout(1, found)
        _write_layout(spark, folder, layout)
        _show(spark, table, layout, None)
    elif table_property(spark, table, _NUMBER) != str(layout.number):
        _drop_unlisted(spark, table, layout)
        _show(spark, table, layout, None)
    return layout


def _drop_unlisted(spark: SparkSession, table: str, layout: Layout) -> None:
    listed = [unquote(r[0].split("=", 1)[1]) for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    for name in {None if n in (_NULL_FOLDER, "null") else n for n in listed} - set(layout.buckets):
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {_partition(name)}")


def replace_buckets(spark: SparkSession, table: str, folder: str, rows: DataFrame, keys: Sequence[str], bucket: str) -> str:
    """Publish a whole load as the table's buckets; returns the folder that holds them.

    A table of other columns, or with a bucket of another type, is dropped and made anew, which
    readers can notice; otherwise bucket after bucket changes its location.
    """
    path = version_path(folder)
    committed = False
    try:
        load = write_bucketed(rows, path, bucket)
        names = find_keys(rows, keys)
        found = _measured(spark, path, rows.schema, names, bucket)
        count_parity_guard(load.rows, sum(b.row_count for b in found.values()))
        numbers = layout_numbers(spark, folder)
        layout = Layout((numbers[-1] if numbers else 0) + 1, found)
        kind = rows.select(F.expr(bucket).alias("_bucket")).schema["_bucket"]
        wanted = [(f.name, f.dataType) for f in [*rows.schema.fields, kind]]
        exists = spark.catalog.tableExists(table)
        before = read_layout(spark, folder) if exists else None
        if exists and (before is None or [(f.name, f.dataType) for f in spark.table(table).schema.fields] != wanted):
            spark.sql(f"DROP TABLE {table}")
            exists, before = False, None
        _write_layout(spark, folder, layout)
        committed = True
        if not exists:
            columns = ", ".join(f"{quoted(name)} {t.simpleString()}" for name, t in wanted)
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY (_bucket) LOCATION '{path}'")
            escaped = bucket.replace("\\", "\\\\").replace("'", "\\'")
            spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{_BUCKET_BY}' = '{escaped}')")
            before = Layout(0, {})
        elif table_property(spark, table, _NUMBER) != str(before.number):
            _drop_unlisted(spark, table, layout)
            before = None
        _show(spark, table, layout, before)
        if exists:
            spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
            spark.catalog.refreshTable(table)
    except Exception:
        if not committed:
            remove_folder(spark, path)
        raise
    return path


#: Gives the merged rows, and how many of the old ones the batch did not replace, told after the write.
Merge = Callable[[DataFrame, DataFrame, Sequence[str]], tuple[DataFrame, Callable[[], int]]]


def _counted(rows: DataFrame) -> tuple[DataFrame, Callable[[], int]]:
    """``rows``, counted while they are read, and their number once they have been.

    Where Spark finds at run time that nothing of them is needed, it leaves out the count with
    the rows; then they are counted on their own.
    """
    seen = Observation()

    def number() -> int:
        try:
            return seen.get["rows"]
        except (Py4JError, KeyError):
            return rows.count()

    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), number


def upsert(old: DataFrame, batch: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Callable[[], int]]:
    """Old rows that stay, counted, and the batch."""
    kept, seen = _counted(without_keys(old, key_set(batch, names), names))
    return insert_by_name(kept, batch), seen


def insert_only(old: DataFrame, batch: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Callable[[], int]]:
    kept, seen = _counted(old)
    return merge_insert_only(kept, batch, names, "unique"), seen


def full_by_comparison(present: DataFrame) -> Merge:
    """Upsert, then only what has its key among those ``present`` in the source."""

    def merge(old: DataFrame, batch: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Callable[[], int]]:
        kept, seen = _counted(without_keys(old, key_set(batch, names), names))
        left = split_null_keys(kept, names)[0].join(present, list(names), "left_semi")
        return insert_by_name(left, split_null_keys(batch, names)[0].join(present, list(names), "left_semi")), seen

    return merge


def full_by_flag(gone: DataFrame) -> Merge:
    """Upsert, then all but the keys flagged as ``gone``."""

    def merge(old: DataFrame, batch: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Callable[[], int]]:
        kept, seen = _counted(without_keys(old, key_set(batch, names), names))
        return insert_by_name(without_keys(kept, gone, names), without_keys(batch, gone, names)), seen

    return merge


def bucket_names(rows: DataFrame, bucket: str) -> set[str | None]:
    """The buckets that rows fall into. There are no more than the table has partitions."""
    return {r[0] for r in rows.select(named_bucket(bucket)).distinct().collect()}


def differing_buckets(layout: Layout, source: DataFrame, keys: Sequence[str], bucket: str) -> tuple[set[str | None], int]:
    """Buckets whose keys are others in the source than in the table, and the source's keys.

    One pass over the source's key columns, reduced to a row per bucket before its shuffle. A
    bucket with rows without a key counts as differing, and so does one whose keys repeat.
    """
    counted = source.groupBy(named_bucket(bucket)).agg(*key_figures(keys)).collect()
    theirs = {r.bucket: (r.key_count, int(r.key_sum), r.key_xor) for r in counted if r.key_count}
    ours = {
        name: (b.key_count, b.key_sum, b.key_xor) if b.row_count == b.key_count else None for name, b in layout.buckets.items()
    }
    return {n for n in {*ours, *theirs} if ours.get(n) != theirs.get(n)}, sum(t[0] for t in theirs.values())


def flagged_buckets(spark: SparkSession, schema: T.StructType, layout: Layout, gone: DataFrame, keys: Sequence[str], bucket: str) -> set[str | None]:
    """Buckets of the table that hold a flagged key: key columns only, of buckets such keys fall into."""
    maybe = bucket_names(gone, bucket)
    held = read_buckets(spark, schema, layout, maybe).select(*columns_of(keys))
    return bucket_names(split_null_keys(held, keys)[0].join(gone, list(keys), "left_semi"), bucket)


def merge_buckets(
    spark: SparkSession, table: str, folder: str, layout: Layout, batch: DataFrame, keys: Sequence[str], bucket: str,
    merge: Merge = upsert, also: Iterable[str | None] = (),
) -> dict[str, int]:
    """Merge a batch, one row per key, into the buckets it falls into and those named in ``also``.

    ``bucket`` is an expression over the key columns alone, so a key never changes its bucket.
    Returns the rows inserted, updated and deleted: from the layout's figures and one count
    taken while merging, so the table is neither counted nor joined again.
    """
    schema, names = rows_schema(spark, table), find_keys(batch, keys)
    # Resolving the expression over the keys alone fails if it uses another column.
    touched = bucket_names(batch.select(*columns_of(names)), bucket) | set(also)
    rows, seen = merge(read_buckets(spark, schema, layout, touched), batch, names)
    path, committed = version_path(folder), False
    try:
        load = write_bucketed(rows, path, bucket)
        found = _measured(spark, path, schema, names, bucket)
        count_parity_guard(load.rows, sum(b.row_count for b in found.values()))
        before = sum(layout.buckets[n].row_count for n in touched if n in layout.buckets)
        if merge is insert_only:
            changes = {"INSERT": load.rows - before, "UPDATE": 0, "DELETE": 0}
        else:
            changes = actions(before, load.rows, seen(), batch.count())
        kept = {n: b for n, b in layout.buckets.items() if n not in touched}
        after = Layout(layout.number + 1, {**kept, **found})
        _write_layout(spark, folder, after)
        committed = True
        _show(spark, table, after, layout)
    except Exception:
        if not committed:
            remove_folder(spark, path)
        raise
    return changes


def actions(before: int, after: int, kept: int, batch: int) -> dict[str, int]:
    """What a merge did, from rows before and after it, those it did not replace and the batch's."""
    updated = before - kept
    return {"INSERT": batch - updated, "UPDATE": updated, "DELETE": before + batch - updated - after}


def drop_old_layouts(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Delete all but the ``keep`` newest layouts, and the buckets that only those named.

    Readers that began earlier finish on the buckets of the layout before.
    """
    numbers = layout_numbers(spark, folder)
    old, held = numbers[:-keep], numbers[-keep:]
    wanted = {b.location for n in held for b in read_layout(spark, folder, n).buckets.values()}
    gone = {b.location for n in old for b in read_layout(spark, folder, n).buckets.values()} - wanted
    folders = {w.rsplit("/", 1)[0] for w in wanted}
    for location in sorted(gone):
        parent = location.rsplit("/", 1)[0]
        remove_folder(spark, location if parent in folders else parent)
    for n in old:
        remove_folder(spark, _layout_path(folder, n))
    return sorted(gone)

"""Key handling shared by the merge, snapshot and history operators.

Two rules hold throughout. NULL keys never match anything, so rows that carry one
stay out of the join's shuffle instead of piling up in a single partition. And no
key's rows are gathered in one task before they have been reduced on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerelay.session import shared_folder


def quoted(name: str) -> str:
    """A column's name as SQL takes it, whatever dots or backticks are in it."""
    return "`" + name.replace("`", "``") + "`"


def columns_of(names: Sequence[str]) -> list[Column]:
    return [F.col(quoted(c)) for c in names]


def find_column(columns: Sequence[str], name: str) -> str:
    """The column called ``name``, whatever its case."""
    for column in columns:
        if column.lower() == name.lower():
            return column
    raise ValueError(f"column {name!r} does not exist; there are {', '.join(columns)}")


def find_keys(df: DataFrame, keys: Sequence[str]) -> list[str]:
    if not keys:
        raise ValueError("at least one key column is required")
    return [find_column(df.columns, k) for k in keys]


def any_null(columns: Sequence[str]) -> Column:
    return reduce(or_, [c.isNull() for c in columns_of(columns)])


def split_null_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows with complete keys, and rows with a NULL key (None if the schema rules them out)."""
    nullable = [k for k in keys if df.schema[k].nullable]
    if not nullable:
        return df, None
    return df.where(~any_null(nullable)), df.where(any_null(nullable))


def key_set(df: DataFrame, keys: Sequence[str], repeated: bool = False) -> DataFrame:
    """Only the complete keys of ``df``: all a semi or anti join has to move.

    ``repeated`` says that keys can occur many times; they are then made distinct on the
    map side, so that a frequent key does not fill one partition.
    """
    named = df.select(*columns_of(keys)).where(~any_null(keys))
    return named.distinct() if repeated else named


def without_keys(df: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``present``. NULL keys match nothing and stay."""
    keyed, unkeyed = split_null_keys(df, keys)
    kept = keyed.join(present, list(keys), "left_anti")
    return kept if unkeyed is None else kept.unionByName(unkeyed)


def sortable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.MapType):
        return False
    if isinstance(data_type, T.ArrayType):
        return sortable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(sortable(f.dataType) for f in data_type.fields)
    return not isinstance(data_type, T.VariantType)


def newest_first(df: DataFrame, order_by: Sequence[str]) -> list[Column]:
    """Descending order by the named columns, then by the rest so that ties are settled."""
    rest = [f.name for f in df.schema.fields if f.name not in order_by and sortable(f.dataType)]
    return [c.desc_nulls_last() for c in columns_of([*order_by, *rest])]


def latest_of_group(df: DataFrame, groups: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per group, the newest; NULL is a group like any other.

    ``row_number() = 1`` is planned with a group limit on both sides of the shuffle,
    so a group that holds much of the table sends one row per map task.
    """
    window = Window.partitionBy(*columns_of(groups)).orderBy(*newest_first(df, order_by))
    ranked = df.withColumn("_position", F.row_number().over(window))
    return ranked.where("_position = 1").drop("_position")


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, the newest; rows with a NULL key are all kept."""
    keyed, unkeyed = split_null_keys(df, keys)
    kept = latest_of_group(keyed, keys, order_by)
    return kept if unkeyed is None else kept.unionByName(unkeyed)


def top_n_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group.

    Groups are cut slice by slice and then whole, so that at most ``n`` rows of each slice
    meet in one task. Slices follow the input partitions, which spreads equal rows too.
    """
    def cut(frame: DataFrame, by: Sequence[Column]) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(*order)
        return (
            frame.withColumn("_position", F.row_number().over(window))
            .where(F.col("_position") <= n)
            .drop("_position")
        )

    by = columns_of(groups)
    sliced = cut(df.withColumn("_slice", F.spark_partition_id()), [*by, F.col("_slice")])
    return cut(sliced.drop("_slice"), by)


def previous_row(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], columns: Sequence[str], name: str
) -> DataFrame:
    """Add struct ``name`` with ``columns`` of the previous row of the same key.

    Rows are range-partitioned by key and order, so one key spreads over as many tasks as
    its rows fill, and each range takes its first predecessor from the last row of the
    range before.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "ranges")
    settled = [c for c in df.columns if c not in order_by and sortable(df.schema[c].dataType)]
    order, by = columns_of([*order_by, *settled, "_tie"]), columns_of(keys)
    # Range bounds come from a sample, so the ranges are written once: every later
    # read, and every retried task, sees the same ones. The tie spreads equal rows.
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    tied.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    taken = F.struct(*columns_of(columns))
    lagged = ranged.withColumn(name, F.lag(taken).over(Window.partitionBy("_range", *by).orderBy(*order)))
    # One row per range and key: the ranges bound the rows of any key here.
    tails = ranged.groupBy("_range", *by).agg(F.max_by(taken, F.struct(*order)).alias("_tail"))
    carried = (
        tails.withColumn("_tail", F.lag("_tail").over(Window.partitionBy(*by).orderBy("_range")))
        .where(F.col("_tail").isNotNull())
    )
    matches = [F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}")) for c in map(quoted, ["_range", *keys])]
    # Only the first row of a range lacks a predecessor in it.
    return (
        lagged.alias("l")
        .join(carried.alias("c"), matches, "left")
        .select(
            *[F.col(f"l.{quoted(c)}") for c in df.columns],
            F.coalesce(F.col(f"l.{quoted(name)}"), F.col("c._tail")).alias(name),
        )
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Complete keys that occur more than once, with their row counts."""
    names = find_keys(df, keys)
    return (
        df.where(~any_null(names))
        .groupBy(*columns_of(names))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .where(F.col("row_count") > 1)
    )


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Fail, naming one key, if a key repeats. Brings at most one row to the driver."""
    first = duplicate_keys(df, keys).head(1)
    if first:
        raise ValueError(f"key {first[0].asDict()} occurs more than once in the merge source")

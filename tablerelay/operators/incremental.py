"""High-water marks: which rows are new, and up to where the table has been read."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerelay.operators.keys import find_column, quoted
from tablerelay.session import ntz, shared_folder


def _after(column: Column, mark: Column, inclusive: bool) -> Column:
    return column >= mark if inclusive else column > mark


def incremental_timestamp(
    df: DataFrame, column: str, since: str | dt.datetime, inclusive: bool = False
) -> DataFrame:
    """Rows stamped after ``since``; a NULL stamp never qualifies.

    ``inclusive`` also takes rows stamped exactly then, which catches late ties and is
    safe wherever the rows are upserted.
    """
    name = find_column(df.columns, column)
    mark = instant(since) if isinstance(df.schema[name].dataType, T.TimestampType) else ntz(since)
    return df.where(_after(F.col(quoted(name)), mark, inclusive))


def instant(since: str | dt.datetime) -> Column:
    """An instant as a literal of the zoned type, whatever the session's zone. Texts are UTC."""
    when = dt.datetime.fromisoformat(since) if isinstance(since, str) else since
    return F.lit(when if when.tzinfo else when.replace(tzinfo=dt.timezone.utc))


def utc_text(zoned: Column) -> Column:
    """A zoned instant as text in UTC, to the microsecond, whatever the session's zone."""
    micros = F.unix_micros(zoned)
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)"))
    return (F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + since.cast("interval day to second")).cast("string")


def oldest_rows(df: DataFrame, column: str, n: int, untracked: bool) -> DataFrame:
    """The ``n`` rows of least tracking value, with all that share the last one's.

    So the highest value of the cut is a mark below which nothing was left out. Rows without
    a value come along only with ``untracked``.
    """
    name = quoted(find_column(df.columns, column))
    last = _value_of_rank(df.where(F.col(name).isNotNull()).select(F.col(name).alias("_value")), n)
    if last is None:
        return df if untracked else df.where(F.col(name).isNotNull())
    within = F.col(name) <= F.lit(bytearray(last) if isinstance(last, (bytes, bytearray)) else last)
    return df.where(within | F.col(name).isNull() if untracked else within)


def _value_of_rank(values: DataFrame, n: int) -> object:
    """The ``n``-th least of ``_value``, or the greatest of fewer; None of none.

    Values are counted and cut into ranges; only the one that holds the rank is ordered in a
    task. A row per range reaches the driver.
    """
    spark, path = values.sparkSession, shared_folder(values.sparkSession, "ranks")
    counted = values.groupBy("_value").agg(F.count(F.lit(1)).alias("_rows"))
    # Bounds come from a sample, so the ranges are written once.
    counted.repartitionByRange("_value").withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged, before, held = spark.read.schema(T.StructType([*counted.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(path), 0, None
    for part in ranged.groupBy("_range").agg(F.sum("_rows").alias("rows")).orderBy("_range").collect():
        held, rest = part["_range"], n - before
        before += part["rows"]
        if before >= n:
            break
    if held is None:
        return None
    within = ranged.where(F.col("_range") == held)
    if before < n:
        return within.agg(F.max("_value")).first()[0]
    upto = F.sum("_rows").over(Window.partitionBy("_range").orderBy("_value"))
    return within.withColumn("_upto", upto).where(F.col("_upto") >= rest).agg(F.min("_value")).first()[0]


def incremental_rowversion(
    df: DataFrame, column: str, since: bytes | None, inclusive: bool = False
) -> DataFrame:
    """Rows whose binary version is above ``since``, in unsigned big-endian order."""
    if since is None:
        raise ValueError("no row version is stored, so an incremental read is not possible")
    name = find_column(df.columns, column)
    return df.where(_after(F.col(name), F.lit(bytearray(since)), inclusive))


def max_watermark(column: str, previous: Column | None = None) -> Column:
    """Aggregate: the highest tracking value, or ``previous`` where there is none."""
    highest = F.max(column)
    return highest if previous is None else F.coalesce(highest, previous)


def max_watermark_ts(df: DataFrame, column: str, previous: str | dt.datetime | None = None) -> DataFrame:
    """One row: the highest timestamp. An empty or all-NULL batch keeps ``previous``."""
    name = find_column(df.columns, column)
    keep = None if previous is None else ntz(previous)
    return df.agg(max_watermark(name, keep).alias("watermark"))


def max_watermark_rowversion(df: DataFrame, column: str, previous: bytes | None = None) -> DataFrame:
    """One row: the highest row version, as hex text."""
    name = find_column(df.columns, column)
    keep = None if previous is None else F.lit(bytearray(previous))
    return df.agg(F.hex(max_watermark(name, keep)).alias("watermark_hex"))


def backfill_tracking(df: DataFrame, column: str, as_of: str | dt.datetime) -> DataFrame:
    """Stamp rows that have no tracking value, so that incremental reads can see them."""
    name = find_column(df.columns, column)
    return df.withColumn(name, F.coalesce(F.col(name), ntz(as_of)))

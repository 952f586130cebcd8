"""Checks between loading rows and showing them to readers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerelay.operators.history import count_where
from tablerelay.operators.keys import any_null, find_column, find_keys

# Whole-number types, and the texts Spark's casts to them take.
_WHOLE_NUMBERS = ("tinyint", "smallint", "int", "bigint")
_WHOLE_NUMBER = r"^[\x00-\x20\x7f]*[+-]?[0-9]+[\x00-\x20\x7f]*$"

COMMIT, SKIP, ABORT = "commit", "skip", "abort"


class GuardError(RuntimeError):
    """A load was refused; the published table is as it was."""


def min_row_decision(rows: Column, minimum: Column, force: Column, skip: Column) -> Column:
    """``commit`` with enough rows or by force, else ``skip`` where allowed, else ``abort``."""
    return F.when(rows >= minimum, COMMIT).when(force, COMMIT).when(skip, SKIP).otherwise(ABORT)


def min_row_guard(rows: int, minimum: int, force: bool = False, skip: bool = False) -> bool:
    """Whether to publish a load of ``rows``; raises where it is neither forced nor skippable."""
    if rows >= minimum or force:
        return True
    if skip:
        return False
    raise GuardError(f"{rows} rows are fewer than the minimum of {minimum}")


def count_parity_guard(read: int, staged: int) -> None:
    """The stage must hold exactly the rows that were read."""
    if read != staged:
        raise GuardError(f"{read} rows were read but {staged} were staged")


def cast_fails(df: DataFrame, column: str, kind: str) -> Column:
    """Whether a value is set but cannot become ``kind``."""
    name = find_column(df.columns, column)
    value, failed = F.col(name), F.col(name).try_cast(kind).isNull()
    if isinstance(df.schema[name].dataType, T.StringType) and kind in _WHOLE_NUMBERS:
        # A failing try_cast is costly; the pattern settles all but values out of range.
        failed = F.when(value.rlike(_WHOLE_NUMBER), failed).otherwise(F.lit(True))
    return value.isNotNull() & failed


def validate_source(
    df: DataFrame,
    keys: Sequence[str],
    tracking: str | None = None,
    casts: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row of counts: rows, NULL keys, repeated keys, NULL tracking values, failing casts.

    Rows are reduced per key first, so the counts need a single shuffle.
    """
    names = find_keys(df, keys)
    row_count = F.count(F.lit(1))
    untracked = F.lit(0) if tracking is None else F.count_if(F.col(find_column(df.columns, tracking)).isNull())
    failing = F.lit(False)
    for column, kind in (casts or {}).items():
        failing = failing | cast_fails(df, column, kind)
    per_key = df.groupBy(*names).agg(
        row_count.alias("_rows"),
        untracked.cast("bigint").alias("_untracked"),
        F.count_if(failing).alias("_failing"),
    )

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    incomplete = any_null(names)
    return per_key.agg(
        total(F.col("_rows")).alias("row_count"),
        total(F.when(incomplete, F.col("_rows"))).alias("null_key_rows"),
        count_where((F.col("_rows") > 1) & ~incomplete).alias("duplicate_keys"),
        total(F.col("_untracked")).alias("null_tracking_rows"),
        total(F.col("_failing")).alias("failed_cast_rows"),
    )

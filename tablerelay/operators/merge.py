"""Merging a batch of source rows into a target, and detecting deleted rows.

Parquet tables take no MERGE or DELETE, so each operator computes the new table:
the target's untouched rows by an anti join on the keys alone, plus the batch.
The target moves at most once; a batch whose keys are small enough for Spark's own
broadcast threshold is sent to the target instead, and the target does not move.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerelay.operators.keys import (
    columns_of,
    find_column,
    find_keys,
    key_set,
    latest_of_group,
    latest_per_key,
    quoted,
    require_unique,
    split_null_keys,
    without_keys,
)
from tablerelay.operators.mapping import insert_by_name


def check_duplicates(source: DataFrame, keys: Sequence[str], on_duplicate: str) -> None:
    if on_duplicate not in ("raise", "latest", "unique"):
        raise ValueError(f"on_duplicate is 'raise', 'latest' or 'unique', not {on_duplicate!r}")
    if on_duplicate == "raise":
        require_unique(source, keys)


def one_per_key(
    source: DataFrame, keys: Sequence[str], on_duplicate: str, order_by: Sequence[str]
) -> DataFrame:
    """The source with at most one row per key, as ``on_duplicate`` asks."""
    check_duplicates(source, keys, on_duplicate)
    return latest_per_key(source, keys, order_by) if on_duplicate == "latest" else source


def merge_upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    on_duplicate: str = "raise",
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Replace matched rows, insert new ones, keep rows only the target has.

    ``on_duplicate`` says what a key that repeats in the source does: ``raise`` checks
    and fails, ``latest`` keeps the newest by ``order_by``, ``unique`` trusts the caller.
    """
    names = find_keys(target, keys)
    batch = one_per_key(source, names, on_duplicate, order_by)
    # The source has the same keys as the batch, without the work of ranking its rows.
    replaced = key_set(source, names, repeated=on_duplicate == "latest")
    return insert_by_name(without_keys(target, replaced, names), batch)


def rows_not_in(
    target: DataFrame, source: DataFrame, keys: Sequence[str], source_keys: DataFrame | None = None
) -> DataFrame:
    """Source rows with a complete key that the target lacks.

    The target's keys are first reduced to those the source names, which needs no
    shuffle of the target when the source's keys fit a broadcast. ``source_keys`` gives
    the source's keys where they can be had more cheaply than from ``source``.
    """
    names = find_keys(target, keys)
    wanted = key_set(source, names) if source_keys is None else source_keys
    known = key_set(target, names).join(wanted, names, "left_semi")
    return split_null_keys(source, names)[0].join(known, names, "left_anti")


def rows_to_insert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    on_duplicate: str = "raise",
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Source rows with keys the target lacks, one per key, and those without a key."""
    names = find_keys(target, keys)
    check_duplicates(source, names, on_duplicate)
    keyed, unkeyed = split_null_keys(source, names)
    if on_duplicate == "latest":
        # Copies are reduced before the join, so they do not meet in one partition.
        keyed = latest_of_group(keyed, names, order_by)
    fresh = rows_not_in(target, keyed, names, key_set(source, names, repeated=on_duplicate == "latest"))
    return fresh if unkeyed is None else fresh.unionByName(unkeyed)


def merge_insert_only(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    on_duplicate: str = "raise",
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Insert rows with new keys, and those without a key; rows already there stay."""
    return insert_by_name(target, rows_to_insert(target, source, keys, on_duplicate, order_by))


def insert_if_absent(target: DataFrame, source: DataFrame, key: str, order_by: Sequence[str] = ()) -> DataFrame:
    """Append rows whose id is absent, taking one of any copies within the batch."""
    return merge_insert_only(target, source, [key], "latest", order_by)


def is_flagged(df: DataFrame, column: str, value: Any) -> Column:
    """Whether the soft-delete column holds ``value``, compared as the column's own type."""
    name = find_column(df.columns, column)
    return F.col(quoted(name)) == F.lit(value).cast(df.schema[name].dataType)


def soft_deleted_keys(source: DataFrame, keys: Sequence[str], column: str, value: Any) -> DataFrame:
    """Keys of source rows that carry the deletion flag."""
    return source.where(is_flagged(source, column, value)).select(*columns_of(find_keys(source, keys)))


def rows_to_soft_delete(
    target: DataFrame, source: DataFrame, keys: Sequence[str], column: str, value: Any
) -> DataFrame:
    """Target rows whose key is flagged as deleted in the source."""
    names = find_keys(target, keys)
    flagged = key_set(soft_deleted_keys(source, names, column, value), names)
    return split_null_keys(target, names)[0].join(flagged, names, "left_semi")


def delete_soft(
    target: DataFrame, source: DataFrame, keys: Sequence[str], column: str, value: Any
) -> DataFrame:
    """The target without the rows flagged as deleted in the source."""
    names = find_keys(target, keys)
    return without_keys(target, key_set(soft_deleted_keys(source, names, column, value), names), names)


def keys_missing_in_source(target: DataFrame, full_source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target keys that the full source no longer has."""
    names = find_keys(target, keys)
    return without_keys(target.select(*columns_of(names)), key_set(full_source, names), names)


def delete_comparison(
    target: DataFrame, full_source: DataFrame, keys: Sequence[str], allow_empty: bool = False
) -> DataFrame:
    """The target without rows whose key the full source lacks.

    ``full_source`` is the whole source, never a delta. An empty one would delete
    everything and is refused unless ``allow_empty``.
    """
    names = find_keys(target, keys)
    present = key_set(full_source, names)
    if not allow_empty and present.isEmpty():
        raise ValueError("the source is empty, so every target row would be deleted")
    return split_null_keys(target, names)[0].join(present, names, "left_semi")


def merge_full(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    *,
    soft: tuple[str, Any] | None = None,
    deleted_keys: DataFrame | None = None,
    full_source: DataFrame | None = None,
    allow_empty: bool = False,
    on_duplicate: str = "raise",
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Upsert plus deletion, by a soft-delete flag, by known keys or by comparison.

    ``soft`` is the (column, value) that flags deleted rows of the source; ``deleted_keys``
    are keys known to be deleted. With neither, rows whose key ``full_source`` lacks go.
    """
    names = find_keys(target, keys)
    batch = one_per_key(source, names, on_duplicate, order_by)
    replaced = key_set(source, names, repeated=on_duplicate == "latest")
    if soft is not None:
        batch = batch.where(~F.coalesce(is_flagged(batch, *soft), F.lit(False)))
    if deleted_keys is not None:
        # Replaced and deleted rows leave the target in one join.
        gone = key_set(deleted_keys, names)
        replaced, batch = replaced.unionByName(gone), without_keys(batch, gone, names)
    if soft is not None or deleted_keys is not None:
        return insert_by_name(without_keys(target, replaced, names), batch)
    if full_source is None:
        raise ValueError("a comparison delete needs the full source")
    # Two joins on the same keys: the target moves once for both.
    kept = split_null_keys(target, names)[0].join(replaced, names, "left_anti")
    return insert_by_name(
        delete_comparison(kept, full_source, names, allow_empty),
        delete_comparison(batch, full_source, names, allow_empty=True),
    )


def merge_action_counts(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows a merge would INSERT and UPDATE; a matched row counts even if unchanged."""
    names = find_keys(target, keys)
    keyed, unkeyed = split_null_keys(source.select(*columns_of(names)), names)
    known = key_set(target, names).join(key_set(source, names), names, "left_semi")
    actions = keyed.join(known.withColumn("_known", F.lit(True)), names, "left").select(
        F.when(F.col("_known"), "UPDATE").otherwise("INSERT").alias("action")
    )
    if unkeyed is not None:
        actions = actions.unionByName(unkeyed.select(F.lit("INSERT").alias("action")))
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("row_count"))

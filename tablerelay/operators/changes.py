"""Change feeds: ordered inserts, updates and deletes by key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablerelay.operators.keys import (
    columns_of,
    find_column,
    find_keys,
    key_set,
    latest_of_group,
    newest_first,
    previous_row,
    quoted,
    sortable,
    without_keys,
)
from tablerelay.operators.mapping import align_to_target

# How a feed marks its operations. A missing mark is an update.
DELETE_OPS = ("D", "DELETE")
UPSERT_OPS = ("I", "INSERT", "U", "UPDATE", "M", "MERGE")


def settled_changes(
    feed: DataFrame, keys: Sequence[str], version: str, op: str, shown: Sequence[str], then: Sequence[str] = ()
) -> DataFrame:
    """The newest event of each complete key, with ``_gone`` for a delete and ``_said``, a hash
    of what the event says: that the row goes, or the values of the columns ``shown``.

    Events are ordered by ``version`` and, within one, by the columns ``then``. Fails on an
    operation that is neither an upsert nor a delete, and where the two newest events of a key
    are of one age and say different things.
    """
    names, op = find_keys(feed, keys), find_column(feed.columns, op)
    age = [find_column(feed.columns, c) for c in (version, *then)]
    mark = F.upper(F.coalesce(F.col(quoted(op)), F.lit("U")))
    gone = F.when(mark.isin(*DELETE_OPS, *UPSERT_OPS), mark.isin(*DELETE_OPS)).otherwise(
        F.raise_error(F.concat(F.lit("unknown operation "), mark)).cast("boolean")
    )
    named = feed.dropna(subset=names).withColumn("_gone", gone)
    newest = Window.partitionBy(*columns_of(names)).orderBy(*newest_first(named, age))
    two = named.withColumn("_position", F.row_number().over(newest)).where("_position <= 2")
    visible = {c.lower() for c in shown}
    values = [f.name for f in feed.schema.fields if f.name not in (*names, *age, op) and f.name.lower() in visible and sortable(f.dataType)]
    what = F.struct(F.col("_gone"), *[F.when(~F.col("_gone"), c) for c in columns_of(values)])
    said = F.struct(*columns_of(age), what.alias("_said"))
    other = F.lead(said).over(Window.partitionBy(*columns_of(names)).orderBy("_position"))
    same_age = [F.col(quoted(c)).eqNullSafe(F.col("_other").getField(c)) for c in age]
    clash = reduce(and_, same_age, F.col("_other").isNotNull()) & ~F.col("_said").eqNullSafe(F.col("_other._said"))
    latest = two.withColumns({"_other": other, "_said": said["_said"]}).where("_position = 1")
    checked = F.when(clash, clashing(columns_of(names)).cast("boolean")).otherwise(F.col("_gone"))
    return latest.select(*columns_of(feed.columns), checked.alias("_gone"), F.xxhash64("_said").alias("_said"))


def clashing(keys: Sequence[Column]) -> Column:
    return F.raise_error(F.concat(F.lit("events of one age disagree on key "), F.to_json(F.struct(*keys))))


def apply_changes(
    target: DataFrame, feed: DataFrame, keys: Sequence[str], version: str, op: str, then: Sequence[str] = ()
) -> DataFrame:
    """The target after the feed: the newest event of each key decides, as
    :func:`settled_changes` finds it. Events with a NULL key name no row and are left out.
    """
    names = find_keys(feed, keys)
    latest = settled_changes(feed, names, version, op, target.columns, then).where(~F.col("_gone"))
    kept = without_keys(target, key_set(feed, names, repeated=True), names)
    return kept.unionByName(align_to_target(latest.select(*columns_of(feed.columns)), target.schema))


def change_history(
    feed: DataFrame, keys: Sequence[str], version: str, values: Sequence[str], before: DataFrame | None = None
) -> DataFrame:
    """The feed with each value before and after the event (``before_x``, ``after_x``).

    ``before`` has the last rows of earlier feeds, as :func:`last_rows` gives them: what the
    first event of a key in this feed follows. So feeds taken one after another have the
    history of one feed.
    """
    names, age = find_keys(feed, keys), find_column(feed.columns, version)
    known = feed
    if before is not None:
        # Only keys of this feed need their last row.
        due = before.join(key_set(feed, names, repeated=True), names, "left_semi").withColumn("_earlier", F.lit(True))
        known = feed.withColumn("_earlier", F.lit(False)).unionByName(due, allowMissingColumns=True)
    lagged = previous_row(known, names, [age], values, "_before")
    if before is not None:
        lagged = lagged.where(~F.col("_earlier"))
    other = [c for c in feed.columns if c not in values]
    return lagged.select(
        *columns_of(other),
        *[F.col("_before").getField(v).alias(f"before_{v}") for v in values],
        *[F.col(quoted(v)).alias(f"after_{v}") for v in values],
    )


def last_rows(
    feed: DataFrame, keys: Sequence[str], version: str, values: Sequence[str], before: DataFrame | None = None
) -> DataFrame:
    """Keys, version and values of the last event of each key, of this feed and of those ``before``."""
    names, age = find_keys(feed, keys), find_column(feed.columns, version)
    rows = feed.select(*columns_of([*names, age, *values]))
    if before is not None:
        rows = rows.unionByName(before.select(*columns_of([*names, age, *values])))
    return latest_of_group(rows, names, [age])


def changes_by_table(feed: DataFrame, table: str) -> DataFrame:
    """Number of changes per table, most first."""
    return feed.groupBy(table).agg(F.count(F.lit(1)).alias("changes_count")).orderBy(
        F.col("changes_count").desc(), F.col(table)
    )

"""Column mapping: from the source's columns to the target's."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerelay.operators.keys import find_column, quoted


def _resolve(df: DataFrame, mappings: Iterable[tuple[str, str]]) -> dict[str, tuple[str, str]]:
    """Destination (lower case) -> (source column, destination); the last entry wins."""
    resolved: dict[str, tuple[str, str]] = {}
    for source, dest in mappings:
        if not (source or "").strip() or not (dest or "").strip():
            raise ValueError("a column mapping has an empty entry")
        first_spelling = resolved.get(dest.lower(), (None, dest))[1]
        resolved[dest.lower()] = (find_column(df.columns, source), first_spelling)
    return resolved


def map_columns(df: DataFrame, mappings: Iterable[tuple[str, str]]) -> DataFrame:
    """Subset, rename and reorder columns by (source, destination) pairs."""
    return df.select(*[F.col(quoted(s)).alias(d) for s, d in _resolve(df, mappings).values()])


def auto_map(df: DataFrame) -> list[tuple[str, str]]:
    """The identity mapping over a source, used where none is given."""
    if not df.columns:
        raise ValueError("the source returned no columns")
    seen: set[str] = set()
    for position, column in enumerate(df.columns, start=1):
        if not column.strip():
            raise ValueError(f"source column {position} has no name")
        if column.lower() in seen:
            raise ValueError(f"source column {column!r} occurs twice; give one an alias")
        seen.add(column.lower())
    return [(c, c) for c in df.columns]


# Whole-number types, the narrowest first: each takes all values of those before it.
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _fitted(name: str, given: T.DataType, wanted: T.DataType) -> Column:
    """A column cast so that a set value never turns into NULL or another one unseen."""
    value, kinds = F.col(quoted(name)), (type(given), type(wanted))
    wider = all(k in _WHOLE for k in kinds) and _WHOLE.index(kinds[0]) <= _WHOLE.index(kinds[1])
    if given == wanted or wider or isinstance(wanted, T.StringType) or isinstance(given, T.NullType):
        return value.cast(wanted)
    fitting = value.try_cast(wanted)
    message = F.concat(F.lit(f"a value of {name!r} does not fit {wanted.simpleString()}: "), F.coalesce(value.cast("string"), F.lit("")))
    return F.when(value.isNotNull() & fitting.isNull(), F.raise_error(message).cast(wanted)).otherwise(fitting)


def align_to_target(
    df: DataFrame, target: T.StructType, mappings: Iterable[tuple[str, str]] | None = None
) -> DataFrame:
    """Project to the target's schema: mapped columns cast, the others NULL.

    A value that does not fit fails the job, whatever the session's ANSI setting.
    """
    resolved = _resolve(df, auto_map(df) if mappings is None else mappings)

    def column(field: T.StructField) -> Column:
        hit = resolved.get(field.name.lower())
        if hit is None:
            return F.lit(None).cast(field.dataType).alias(field.name)
        return _fitted(hit[0], df.schema[hit[0]].dataType, field.dataType).alias(field.name)

    return df.select(*[column(f) for f in target.fields])


def insert_by_name(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Target plus ``rows``, matched by column name; diverged column sets are an error."""
    ours, theirs = {c.lower() for c in target.columns}, {c.lower() for c in rows.columns}
    if ours != theirs:
        raise ValueError(
            f"columns differ: only in target {sorted(ours - theirs)}, only in rows {sorted(theirs - ours)}"
        )
    return target.unionByName(align_to_target(rows, target.schema))


def transform_columns(df: DataFrame, transforms: Sequence[tuple[str, str]]) -> DataFrame:
    """Select (expression, destination) pairs, each a Spark SQL expression over ``df``."""
    return df.select(*[F.expr(e).alias(d) for e, d in transforms])

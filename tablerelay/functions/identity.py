"""Names and identifiers derived from job definitions, row versions and row contents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what a job's source is called when no object can be found in its query.
UNKNOWN_SOURCE = "UnknownSource"


# What Spark and SQL take as one part of a name: plain, in brackets, in quotes or in backticks.
_PART = r"""(?:\w+|\[[^\]]+\]|"[^"]+"|`[^`]+`)"""
_NAME_AFTER_FROM = rf"(?i)\bFROM\s+({_PART}(?:\s*\.\s*{_PART})*)"


def source_object_name(query: Column) -> Column:
    """First object named after FROM, its parts joined by dots, without brackets or quotes."""
    found = F.regexp_replace(F.regexp_extract(query, _NAME_AFTER_FROM, 1), r"\s*\.\s*", ".")
    return F.when(F.coalesce(found, F.lit("")) == "", UNKNOWN_SOURCE).otherwise(F.translate(found, '[]"`', ""))


def job_identifier(
    source_server: Column,
    source_database: Column,
    source_object: Column,
    dest_server: Column,
    dest_database: Column,
    dest_table: Column,
) -> Column:
    """Stable name of a job: both ends joined by ``_``, dots as ``_``, no brackets."""
    joined = F.concat_ws(
        "_",
        *[F.coalesce(c, F.lit("")) for c in (source_server, source_database, source_object)],
        F.lit("TO"),
        *[F.coalesce(c, F.lit("")) for c in (dest_server, dest_database, dest_table)],
    )
    return F.translate(joined, ".[]", "_")


def rowversion_hex(version: Column) -> Column:
    """A binary row version as a hex literal."""
    return F.concat(F.lit("0x"), F.hex(version))


ENCODINGS = ("safe", "compat")

# Microseconds, in UTC, wherever in a row an instant stands.
_JSON = {
    "ignoreNullFields": "false", "timeZone": "UTC",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _check_encoding(encoding: str) -> None:
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding is 'safe' or 'compat', not {encoding!r}")


def row_key(keys: Sequence[Column], encoding: str = "safe") -> Column:
    """Key values as one text, joined by ``||``.

    ``safe`` puts a backslash before backslashes and bars and writes NULL as ``\\N``, so that
    different keys never fall together; zoned instants are in UTC to the microsecond, whatever the
    session's zone. ``compat`` leaves texts alone and reads NULL ``NULL``.
    """
    _check_encoding(encoding)
    if encoding == "compat":
        return F.concat_ws("||", *[F.coalesce(k.cast("string"), F.lit("NULL")) for k in keys])
    # The type is known when the plan is made, so one branch is left of each.
    texts = [
        F.when(F.typeof(k) == "timestamp", F.get_json_object(F.to_json(F.struct(k.alias("k")), _JSON), "$.k")).otherwise(k.cast("string"))
        for k in keys
    ]
    escaped = [F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for t in texts]
    return F.concat_ws("||", *[F.coalesce(t, F.lit("\\N")) for t in escaped])


def row_hash(values: Sequence[Column], encoding: str = "safe") -> Column:
    """SHA-256 of a row's values, Base64.

    ``compat`` writes each value as text followed by ``|`` with NULL as ``NULL``, so a
    NULL and the text NULL, or values holding ``|``, can collide. ``safe`` hashes JSON
    with instants to the microsecond and keeps them apart.
    """
    _check_encoding(encoding)
    if encoding == "compat":
        text = F.concat(
            *[F.concat(F.coalesce(v.cast("string"), F.lit("NULL")), F.lit("|")) for v in values]
        )
    else:
        text = F.to_json(F.struct(*[v.alias(f"c{i}") for i, v in enumerate(values)]), _JSON)
    return F.base64(F.unhex(F.sha2(text.cast("binary"), 256)))

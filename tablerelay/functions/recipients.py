"""Recipient lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_recipients(text: Column) -> Column:
    """Addresses separated by ``,`` or ``;``, trimmed, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]"), lambda part: F.trim(part))
    return F.filter(parts, lambda part: part != "")


def parse_recipients_json(text: Column) -> Column:
    """Addresses in a JSON array; anything else gives an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def recipients_json(addresses: Column) -> Column:
    """A list of addresses as a JSON array."""
    return F.to_json(addresses)

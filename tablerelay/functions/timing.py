"""Durations and elapsed time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_seconds(ms: Column) -> Column:
    """Milliseconds as seconds with two decimals; NULL stays NULL."""
    return (ms / F.lit(1000.0).cast("decimal(5,1)")).cast("decimal(10,2)")


def _epoch_seconds(ts: Column) -> Column:
    since = ts.cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    return F.floor(since.cast("interval second").cast("decimal(20,6)")).cast("bigint")


def boundaries_crossed(start: Column, end: Column, unit_seconds: int) -> Column:
    """How many clock boundaries of a unit lie between two instants.

    From 00:00:59 to 00:01:01 is one minute boundary although only two seconds pass.
    """
    def tick(ts: Column) -> Column:
        return F.floor(_epoch_seconds(ts) / F.lit(unit_seconds))

    return (tick(end) - tick(start)).cast("bigint")


def minutes_between(start: Column, end: Column) -> Column:
    return boundaries_crossed(start, end, 60)


def seconds_between(start: Column, end: Column) -> Column:
    return (_epoch_seconds(end) - _epoch_seconds(start)).cast("bigint")


def _parts(ms: Column, wrap_days: bool) -> tuple[Column, Column, Column]:
    def div(column: Column, by: int) -> Column:
        return F.floor(column / F.lit(by)).cast("bigint")

    hours = div(ms, 3_600_000)
    return (
        F.pmod(hours, F.lit(24)) if wrap_days else hours,
        F.pmod(div(ms, 60_000), F.lit(60)),
        F.pmod(div(ms, 1000), F.lit(60)),
    )


def format_duration(ms: Column, wrap_days: bool = False) -> Column:
    """Two leading units: ``3h 5m``, ``5m 7s``, ``7s`` or ``80ms``.

    ``wrap_days`` shows the hour of the day instead of all hours, so 25 hours read 1h.
    """
    hours, minutes, seconds = _parts(ms, wrap_days)
    return (
        F.when(ms >= 3_600_000, F.concat(hours, F.lit("h "), minutes, F.lit("m")))
        .when(ms >= 60_000, F.concat(minutes, F.lit("m "), seconds, F.lit("s")))
        .when(ms >= 1000, F.concat(seconds, F.lit("s")))
        .when(ms.isNotNull(), F.concat(ms, F.lit("ms")))
    )


def format_duration_long(ms: Column, wrap_days: bool = False) -> Column:
    """All units down to seconds: ``3h 5m 7s``; NULL reads ``-``."""
    hours, minutes, seconds = _parts(ms, wrap_days)
    return (
        F.when(ms.isNull(), "-")
        .when(ms >= 3_600_000, F.concat(hours, F.lit("h "), minutes, F.lit("m "), seconds, F.lit("s")))
        .when(ms >= 60_000, F.concat(minutes, F.lit("m "), seconds, F.lit("s")))
        .otherwise(F.concat(seconds, F.lit("s")))
    )

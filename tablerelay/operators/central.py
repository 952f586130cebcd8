"""Bringing run histories of many machines together."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerelay.operators.history import history_filter
from tablerelay.operators.keys import key_set, latest_of_group
from tablerelay.operators.known import maybe_known
from tablerelay.operators.mapping import insert_by_name
from tablerelay.operators.merge import rows_not_in
from tablerelay.session import before, ntz


def consolidate_history(
    central: DataFrame,
    feed: DataFrame,
    configs: DataFrame,
    synced_at: str | dt.datetime,
    days: int | None = 7,
    max_rows: int | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """The central history with the feed's runs that it lacks.

    ``feed`` holds runs stamped with project_id and server_id, from any number of
    machines; ``configs`` gives config_id and config_display_name; of an id that repeats
    the greatest name counts. Copies of a run within the feed count once, and a feed that was sent before adds nothing.
    A run without an id is rejected. Columns the feed lacks are NULL. ``max_rows`` keeps
    the newest runs of the feed only. With ``known``, the stored filters of the ids that
    ``central`` has (:mod:`tablerelay.operators.known`), only runs they may hold are looked up there.
    """
    fresh = new_runs(central, feed, synced_at, days, max_rows, known)
    names_of = configs.groupBy("config_id").agg(F.max("config_display_name").alias("config_display_name"))
    named = fresh.join(names_of, "config_id", "left")
    stamped = named.withColumn("synced_at", ntz(synced_at))
    for field in central.schema.fields:
        if field.name not in stamped.columns:
            stamped = stamped.withColumn(field.name, F.lit(None).cast(field.dataType))
    return insert_by_name(central, stamped.select(*central.columns))


def new_runs(
    central: DataFrame,
    feed: DataFrame,
    synced_at: str | dt.datetime,
    days: int | None = 7,
    max_rows: int | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """The feed's runs, one of each id, that the central history lacks."""
    key = ["execution_id"]
    rows = feed.dropna(subset=key)
    if days is not None:
        rows = rows.where(F.col("start_time") >= before(synced_at, days=days))
    names = key_set(rows, key, repeated=True)
    rows = latest_of_group(rows, key, ["start_time"])
    if max_rows is not None:
        rows = history_filter(rows, limit=max_rows)
    if known is None:
        return rows_not_in(central, rows, key, names)
    maybe = maybe_known(names, "execution_id", known)
    asked = rows.join(maybe, key, "left_semi")
    return rows.join(maybe, key, "left_anti").unionByName(rows_not_in(central, asked, key, maybe))


def heartbeat_upsert(servers: DataFrame, beats: DataFrame) -> DataFrame:
    """Servers with their latest heartbeat and online; unknown servers are added.

    ``beats`` has server_id, project_id and beat_at, any number of rows per server. They
    are reduced to one row per server before the join.
    """
    keys = ["server_id", "project_id"]
    latest = beats.groupBy(*keys).agg(F.max("beat_at").alias("_beat"))
    updated = {
        "last_heartbeat": F.coalesce("_beat", "last_heartbeat"),
        "is_online": F.coalesce(F.when(F.col("_beat").isNotNull(), F.lit(True)), F.col("is_online")),
    }
    return servers.join(latest, keys, "full").withColumns(updated).select(*servers.columns)

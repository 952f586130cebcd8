"""The tracking state: one row per job with its high-water mark and last counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerelay.operators.keys import key_set, latest_of_group, without_keys
from tablerelay.operators.mapping import insert_by_name

STATE_SCHEMA = (
    "job_identifier string, last_sync_time timestamp_ntz, last_row_version binary, "
    "last_change_tracking_version bigint, rows_processed bigint, rows_inserted bigint, "
    "rows_updated bigint, rows_deleted bigint, success boolean, error_message string, "
    "published_path string, created_at timestamp_ntz, updated_at timestamp_ntz"
)


def last_success_state(states: DataFrame) -> DataFrame:
    """The state of each job's latest successful run.

    The time of the run decides, not its mark: after a forced full run over a source that was
    set back, the lower mark is the true one. Of runs at one time the later ``run_number``
    counts, where the states have it.
    """
    succeeded = states.where(F.col("success"))
    numbers = [c for c in states.columns if c == "run_number"]
    return latest_of_group(succeeded, ["job_identifier"], ["updated_at", *numbers, "last_sync_time"])


def save_state(states: DataFrame, updates: DataFrame) -> DataFrame:
    """States after an upsert, the latest per job; created_at of a known job stays, the
    earliest where ``states`` holds a job more than once.

    A state without a job's name belongs to no job and is left out.
    """
    key = ["job_identifier"]
    named = updates.dropna(subset=key)
    created = states.dropna(subset=key).groupBy(*key).agg(F.min("created_at").alias("_created"))
    batch = (
        latest_of_group(named, key, ["updated_at"])
        .join(created, key, "left")
        .withColumn("created_at", F.coalesce("_created", "created_at"))
        .drop("_created")
    )
    return insert_by_name(without_keys(states, key_set(named, key, repeated=True), key), batch)


def save_settings(settings: DataFrame, updates: DataFrame) -> DataFrame:
    """Key-value settings after an upsert; a NULL value removes its key."""
    key = ["key"]
    named = updates.dropna(subset=key)
    kept = without_keys(settings, key_set(named, key, repeated=True), key)
    return insert_by_name(kept, latest_of_group(named, key, [])).where(F.col("value").isNotNull())


def reset_state(states: DataFrame, job_identifier: str) -> DataFrame:
    """States without one job, whose next run is then a full one."""
    return states.where(~F.col("job_identifier").eqNullSafe(job_identifier))


def tracking_monitor(states: DataFrame, containing: str | None = None, newest: int | None = None) -> DataFrame:
    """States, newest first, labelled OK or ERROR; optionally by part of the job's name."""
    rows = states
    if containing is not None:
        rows = rows.where(F.col("job_identifier").contains(containing))
    listed = rows.select(
        "job_identifier",
        F.col("last_sync_time").alias("last_sync"),
        F.col("rows_processed").alias("total_rows"),
        F.col("rows_inserted").alias("inserted"),
        F.col("rows_updated").alias("updated"),
        F.col("rows_deleted").alias("deleted"),
        F.when(F.col("success"), "OK").otherwise("ERROR").alias("status"),
        "error_message",
    ).orderBy(F.col("last_sync").desc_nulls_last(), F.col("job_identifier"))
    return listed if newest is None else listed.limit(newest)

"""One relay job from source to published table."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerelay.operators.incremental import (
    incremental_rowversion,
    incremental_timestamp,
    max_watermark,
    oldest_rows,
    utc_text,
)
from tablerelay.operators.keys import columns_of, find_column, find_keys, key_set, latest_per_key, quoted
from tablerelay.operators.mapping import align_to_target, auto_map, map_columns
from tablerelay.operators.merge import check_duplicates, is_flagged, rows_to_insert
from tablerelay.operators.snapshot import (
    build_snapshot,
    save_snapshot,
    snapshot_diff,
    snapshot_merge_seen,
    stored_snapshot,
)
from tablerelay.operators.state import STATE_SCHEMA, last_success_state
from tablerelay.plans import buckets
from tablerelay.plans.guards import GuardError, min_row_guard
from tablerelay.plans.history import RunRecord
from tablerelay.plans.publish import (
    Load,
    append_once,
    drop_old_versions,
    flip,
    load_partitioned,
    read_load,
    remove_folder,
    remove_unpublished,
    table_location,
    version_path,
)
from tablerelay.sources.queries import source_top_n
from tablerelay.spec import JobSpec


@dataclass(frozen=True)
class RunResult:
    """What a run read and published. ``published`` is False where nothing changed.

    ``changes`` holds rows inserted, updated and deleted, as far as the mode knows them.
    ``untracked`` counts rows of a whole load that have no tracking value: incremental runs
    will not see them again until they get one.
    """

    rows_read: int
    published: bool
    location: str | None
    changes: dict[str, int] = field(default_factory=dict)
    untracked: int | None = None


@dataclass(frozen=True)
class Marks:
    """How far a job's source has been read."""

    time: str | None = None
    version: bytes | None = None


#: What runs record: the state, and a number that settles runs at one time.
RECORDED = f"{STATE_SCHEMA}, run_number bigint"
#: Files of the state log above which they become one table, and seconds for which readers that
#: began earlier may still need those that did.
STATE_FILES, STATE_GRACE = 32, 3600
#: Bytes of the log for each task that makes such a table, so that no task holds more as logs grow.
STATE_BYTES = 8_000_000


def _state_files(spark: SparkSession, path: str) -> tuple[list, list]:
    """The files and tables of a state log that count, and the notes of those that a larger table replaced."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(conf)
    found = list(files.listStatus(folder)) if files.exists(folder) else []
    notes = [s for s in found if s.getPath().getName().startswith("_replaced-")]
    replaced = {name for note in notes for name in _lines(spark, files, note.getPath())}
    return [s.getPath() for s in found if s.getPath().getName().endswith(".parquet") and s.getPath().getName() not in replaced], notes


def _lines(spark: SparkSession, files, path) -> list[str]:
    stream = files.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
    finally:
        stream.close()


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """All states that runs have recorded, earlier ones included."""
    files, _ = _state_files(spark, path)
    if not files:
        return spark.createDataFrame([], RECORDED)
    return spark.read.schema(RECORDED).parquet(*[str(p) for p in files])


def compact_states(spark: SparkSession, path: str, most: int = STATE_FILES, grace: int = STATE_GRACE) -> bool:
    """Make the files of a state log one table, if there are more than ``most``.

    The table is a folder in the log that counts as one of its files; equal states meet in one
    of its tasks. A note then says which files it replaces; they are deleted once the note is older
    than ``grace`` seconds. A run that dies before the note leaves states twice, which changes nothing.
    """
    old, notes = _state_files(spark, path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path_of = jvm.org.apache.hadoop.fs.Path
    files = path_of(path).getFileSystem(conf)
    for note in notes:
        if note.getModificationTime() <= (time.time() - grace) * 1000:
            for name in _lines(spark, files, note.getPath()):
                files.delete(path_of(path, name), True)
            files.delete(note.getPath(), False)
    if len(old) <= most:
        return False
    parts = max(1, math.ceil(sum(files.getContentSummary(p).getLength() for p in old) / STATE_BYTES))
    rows = spark.read.schema(RECORDED).parquet(*[str(p) for p in old])
    rows.repartition(parts, *rows.columns).distinct().write.parquet(f"{path.rstrip('/')}/compact-{uuid.uuid4().hex}.parquet")
    out = files.create(path_of(path, f"_replaced-{uuid.uuid4().hex}"), True)
    out.write(bytearray("\n".join(p.getName() for p in old), "utf-8"))
    out.close()
    return True


def _record_state(
    spark: SparkSession, path: str, job: JobSpec, as_of: str, result: RunResult, marks: Marks, number: int
) -> None:
    version = None if marks.version is None else bytearray(marks.version)
    values = {
        "job_identifier": job.job_id,
        "last_sync_time": marks.time,
        "last_row_version": version,
        "last_change_tracking_version": None,
        "rows_processed": result.rows_read,
        "rows_inserted": result.changes.get("INSERT"),
        "rows_updated": result.changes.get("UPDATE"),
        "rows_deleted": result.changes.get("DELETE"),
        "success": True,
        "error_message": None,
        "published_path": result.location,
        "created_at": as_of,
        "updated_at": as_of,
        "run_number": number,
    }
    fields = spark.createDataFrame([], RECORDED).schema.fields
    row = spark.range(1).select(*[F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in fields])
    row.coalesce(1).write.mode("append").parquet(path)
    compact_states(spark, path)


def _next_number(states: DataFrame) -> int:
    """The number of a job's next run: one that is tried again gets the same."""
    last, runs = states.agg(F.max("run_number"), F.count(F.lit(1))).first()
    return max(last or 0, runs) + 1


def _known_marks(states: DataFrame) -> Marks | None:
    found = last_success_state(states).select(F.col("last_sync_time").cast("string"), "last_row_version").head()
    if found is None:
        return None
    return Marks(found[0], None if found[1] is None else bytes(found[1]))


def _delta(job: JobSpec, source: DataFrame, marks: Marks) -> DataFrame:
    how = job.incremental
    if how.mode == "timestamp" and marks.time is not None:
        return incremental_timestamp(source, how.tracking_column, marks.time, how.inclusive)
    if how.mode == "rowversion" and marks.version is not None:
        return incremental_rowversion(source, how.tracking_column, marks.version, how.inclusive)
    return source


_AGE, _GONE = "_newest", "_gone"


def _living(job: JobSpec, rows: DataFrame) -> DataFrame:
    """Source rows without those flagged as deleted, in target columns.

    With ``on_duplicate="latest"`` one of each key: the newest by the source's own tracking
    column, which the mapping may drop. Where that one is flagged, the key has no row.
    """
    how, gone = job.incremental, F.lit(False)
    if how.deletes is not None and how.deletes.mode == "soft":
        gone = F.coalesce(is_flagged(rows, how.deletes.column, how.deletes.value), F.lit(False))
    if how.on_duplicate != "latest" or not how.tracking_column:
        rows = rows.where(~gone)
        return rows if job.mappings is None else map_columns(rows, job.mappings)
    pairs = auto_map(rows) if job.mappings is None else job.mappings
    aged = map_columns(rows.withColumn(_GONE, gone), [*pairs, (how.tracking_column, _AGE), (_GONE, _GONE)])
    newest = latest_per_key(aged, find_keys(aged, job.keys), [_AGE])
    return newest.where(~F.col(_GONE)).drop(_AGE, _GONE)


def _flagged_keys(job: JobSpec) -> DataFrame:
    """Keys of all source rows flagged as deleted, in target columns."""
    found = job.incremental.deletes
    rows = job.source.where(is_flagged(job.source, found.column, found.value))
    return (rows if job.mappings is None else map_columns(rows, job.mappings)).select(*job.keys)


def _merge_of(job: JobSpec, target: DataFrame, keys: Sequence[str]) -> buckets.Merge:
    """How a batch, whose keys were checked before if they must not repeat, meets the whole target."""
    how = job.incremental
    if how.merge == "upsert":
        return buckets.upsert
    if how.deletes.mode == "soft":
        return buckets.full_by_flag(key_set(_flagged_keys(job), keys, repeated=True))
    whole = job.source if job.mappings is None else map_columns(job.source, job.mappings)
    present = key_set(align_to_target(whole, target.schema), keys)
    if not how.deletes.allow_empty and present.isEmpty():
        raise ValueError("the source is empty, so every target row would be deleted")
    return buckets.full_by_comparison(present)


def snapshot_folder(job: JobSpec) -> str:
    return f"{job.folder.rstrip('/')}/snapshots"


def _take_snapshot(
    spark: SparkSession, job: JobSpec, published: DataFrame | None, batch: DataFrame, as_of: str, stage: str
) -> dict[str, int]:
    """What changed since the last run; at most three rows reach the driver.

    The source alone is hashed: it is held against the snapshot of the run before, which is
    brought up to date in ``stage``. Only where there is none yet is the published table hashed.
    """
    stored = stored_snapshot(spark, snapshot_folder(job), job.job_id)
    current = build_snapshot(batch, job.job_id, job.keys, as_of)
    seen = current if stored is None else snapshot_merge_seen(stored, current, as_of)
    seen.write.parquet(stage)
    if stored is None and published is None:
        return {}
    old = stored if stored is not None else build_snapshot(align_to_target(published, batch.schema), job.job_id, job.keys, as_of)
    counted = snapshot_diff(old, current).groupBy("change_type").count()
    return {r["change_type"]: r["count"] for r in counted.collect()}


def _merge_counts(target: DataFrame, batch: DataFrame, kept: int, after: int) -> dict[str, int]:
    """Rows inserted, updated and deleted by a merge that replaced all but ``kept`` rows and left
    ``after``; the target's number comes from its files' footers."""
    return buckets.actions(target.count(), after, kept, batch.count())


def _merge_buckets(spark: SparkSession, job: JobSpec, batch: DataFrame) -> dict[str, int]:
    """Merge into the touched buckets: the batch's, and for a full merge those that lose keys.

    For a comparison, the source's keys are summed up per bucket and held against the layout's
    sums; only where they differ are keys compared. For flags, the table's keys are looked
    up in the buckets that flagged keys fall into.
    """
    how, folder, keys = job.incremental, job.folder, find_keys(batch, job.keys)
    layout = buckets.current_layout(spark, job.target, folder, keys, job.bucket)
    known = partial(buckets.merge_buckets, spark, job.target, folder, layout, batch, keys, job.bucket)
    if how.merge != "full":
        return known(buckets.insert_only if how.merge == "insert_only" else buckets.upsert)
    if how.deletes.mode == "soft":
        gone = key_set(align_to_target(_flagged_keys(job), batch.select(*columns_of(keys)).schema), keys, repeated=True)
        touched = buckets.flagged_buckets(spark, batch.schema, layout, gone, keys, job.bucket)
        return known(buckets.full_by_flag(gone), touched)
    whole = job.source if job.mappings is None else map_columns(job.source, job.mappings)
    source = align_to_target(whole.select(*columns_of(find_keys(whole, job.keys))), batch.select(*columns_of(keys)).schema)
    differing, found = buckets.differing_buckets(layout, source, keys, job.bucket)
    if not found and not how.deletes.allow_empty:
        raise ValueError("the source is empty, so every target row would be deleted")
    touched = differing | buckets.bucket_names(batch.select(*columns_of(keys)), job.bucket)
    present = source.where(F.coalesce(buckets.named_bucket(job.bucket), F.lit("")).isin([n or "" for n in touched]))
    return known(buckets.full_by_comparison(key_set(present, keys)), touched)


def check_job(job: JobSpec) -> None:
    """Fail, naming it, on a column that the job names and its source does not have.

    Needs the source's schema only; nothing is read.
    """
    how, columns = job.incremental, job.source.columns
    if how.tracking_column:
        find_column(columns, how.tracking_column)
    if how.deletes is not None and how.deletes.mode == "soft":
        find_column(columns, how.deletes.column)
    mapped = map_columns(job.source, auto_map(job.source) if job.mappings is None else job.mappings)
    for key in job.keys:
        find_column(mapped.columns, key)


def _write(job: JobSpec, rows: DataFrame, path: str, **more) -> Load:
    return load_partitioned(
        rows, path, batch_rows=job.options.batch_rows, writers=job.options.writers, **more
    )


def _check_copies(job: JobSpec, batch: DataFrame) -> None:
    """Fail on a key that repeats, unless the batch was reduced when it was written."""
    if job.incremental.on_duplicate != "latest":
        check_duplicates(batch, find_keys(batch, job.keys), job.incremental.on_duplicate)


def _publish_merge(
    spark: SparkSession, job: JobSpec, batch: DataFrame, location: str, run_name: str
) -> tuple[str, dict]:
    """Merge a batch into the published table; returns its location and what changed.

    Whatever fails, readers follow the rows from before or those from after the merge.
    """
    how, target = job.incremental, spark.table(job.target)
    aligned = align_to_target(batch, target.drop("_bucket").schema)
    _check_copies(job, aligned)
    if job.bucket is not None:
        return location, _merge_buckets(spark, job, aligned)
    if how.merge == "insert_only":
        # New rows become new files; what is there is neither read whole nor written again.
        added = append_once(spark, job.target, rows_to_insert(target, aligned, job.keys, "unique"), run_name)
        return location, {"INSERT": added, "UPDATE": 0, "DELETE": 0}
    path = version_path(job.folder)
    try:
        names = find_keys(target, job.keys)
        rows, kept = _merge_of(job, target, names)(target, aligned, names)
        merged = _write(job, rows, path)
        read_load(spark, merged)
        changes = _merge_counts(target, aligned, kept(), merged.rows)
        flip(spark, job.target, path)
    finally:
        remove_unpublished(spark, job.target, path)
    return path, changes


def _publish_whole(
    spark: SparkSession, job: JobSpec, batch: DataFrame, path: str, location: str | None, as_of: str, run_name: str
) -> tuple[str, dict]:
    """Put a whole load, written to ``path``, in the place of the table, or at its end."""
    how, tracking = job.incremental, job.incremental.mode in ("timestamp", "rowversion")
    if job.options.append and location is not None and not tracking:
        append_once(spark, job.target, batch, run_name)
        return location, {}
    changes: dict[str, int] = {}
    if how.mode == "snapshot":
        stage = version_path(f"{job.folder.rstrip('/')}/stage")
        try:
            published = None if location is None else spark.table(job.target)
            changes = _take_snapshot(spark, job, published, batch, as_of, stage)
            flip(spark, job.target, path)
            # A fault from here on fails the run, but the rows that readers follow stay.
            save_snapshot(spark.read.parquet(stage), snapshot_folder(job))
        finally:
            remove_folder(spark, stage)
        return path, changes
    if tracking:
        _check_copies(job, batch)
    if job.bucket is not None:
        return buckets.replace_buckets(spark, job.target, job.folder, batch, job.keys, job.bucket), changes
    flip(spark, job.target, path)
    return path, changes


def _cut(job: JobSpec, delta: DataFrame, merging: bool, known_table: bool) -> DataFrame:
    """At most ``top`` rows, such that the next run finds the rest."""
    top, tracking = job.options.top, job.incremental.mode in ("timestamp", "rowversion")
    if not top:
        return delta
    if known_table and not merging and not (job.options.append and not tracking):
        raise ValueError("top would replace the whole table by a part of its source")
    if tracking:
        return oldest_rows(delta, job.incremental.tracking_column, top, untracked=not merging)
    return source_top_n(delta, top)


def run_job(
    spark: SparkSession, job: JobSpec, state_path: str, as_of: str | dt.datetime, history_path: str | None = None
) -> RunResult:
    """Read, guard, merge and publish; then record the new high-water mark.

    The first run of a job, or a forced full one, loads everything. Later runs merge what
    is new, so a delta never replaces the table. The mark is kept when a batch is empty or
    carries none, and is written after the flip: a run that dies in between is read again.
    A stage, and a load that a guard refuses, is removed again. With ``history_path`` the
    run's start and its end, good or bad, are appended to the run history there.
    """
    as_of = as_of.isoformat(sep=" ") if isinstance(as_of, dt.datetime) else as_of
    if history_path is None:
        return _run(spark, job, state_path, as_of)
    run = RunRecord(spark, history_path, job.job_id, job.incremental.mode, as_of)
    run.started()
    try:
        result = _run(spark, job, state_path, as_of)
    except Exception as error:
        run.failed(error)
        raise
    run.succeeded(result.rows_read, result.changes)
    return result


def _run(spark: SparkSession, job: JobSpec, state_path: str, as_of: str) -> RunResult:
    check_job(job)
    how, options, folder = job.incremental, job.options, job.folder.rstrip("/")
    states = read_states(spark, state_path).where(F.col("job_identifier") == job.job_id)
    known, number, location = _known_marks(states), _next_number(states), table_location(spark, job.target)
    tracking = how.mode in ("timestamp", "rowversion")
    merging = tracking and known is not None and location is not None and not how.force_full
    marks = known or Marks()

    delta = _delta(job, job.source, marks) if merging else job.source
    delta = _cut(job, delta, merging, location is not None)
    # The mark comes from the source's own column, which the mapping may drop. Whole
    # loads are written where they can be published as they are.
    figures = {}
    if tracking:
        tracked = find_column(delta.columns, how.tracking_column)
        mark = max_watermark(quoted(tracked))
        zoned = isinstance(delta.schema[tracked].dataType, T.TimestampType)
        text = utc_text(mark) if zoned else mark.cast("timestamp_ntz").cast("string")
        figures["mark"] = mark if how.mode == "rowversion" else text
        if not merging:
            figures["untracked"] = F.count_if(F.col(quoted(tracked)).isNull())
    appending = options.append and not tracking and location is not None
    stage = version_path(f"{folder}/stage" if merging or job.bucket or appending else folder)
    run_name = hashlib.sha256(f"{number}|{job.job_id}".encode()).hexdigest()[:32]
    try:
        load = _write(job, delta, stage, figures=figures, mapped=lambda rows: _living(job, rows))
        batch = read_load(spark, load)
        if merging and load.rows == 0 and how.merge != "full" and options.empty == "noop":
            return RunResult(0, False, location)
        if not min_row_guard(load.rows, options.min_rows, options.force, options.skip):
            return RunResult(load.rows, False, location)
        if how.mode == "snapshot" and load.rows == 0 and location is not None and not options.force:
            raise GuardError("the source is empty, so every target row would be deleted")
        if merging:
            shown, changes = _publish_merge(spark, job, batch, location, run_name)
        else:
            shown, changes = _publish_whole(spark, job, batch, load.path, location, as_of, run_name)
    finally:
        remove_unpublished(spark, job.target, stage)
    result = RunResult(load.rows, True, shown, changes, load.figures.get("untracked"))

    mark = load.figures.get("mark")
    if mark is not None:
        marks = Marks(version=bytes(mark)) if how.mode == "rowversion" else Marks(time=mark)
    _record_state(spark, state_path, job, as_of, result, marks, number)
    if job.bucket is not None:
        buckets.drop_old_layouts(spark, folder, options.keep_versions)
    else:
        drop_old_versions(spark, job.target, folder, options.keep_versions)
    return result

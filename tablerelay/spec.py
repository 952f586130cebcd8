"""What a relay job is: source, target, mapping, guards and incremental mode."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

MODES = ("full", "timestamp", "rowversion", "snapshot")
MERGES = ("insert_only", "upsert", "full")
DELETES = ("soft", "comparison")


@dataclass(frozen=True)
class DeleteDetection:
    """How rows deleted at the source are recognised."""

    mode: str
    column: str | None = None
    value: Any = None
    allow_empty: bool = False

    def __post_init__(self) -> None:
        if self.mode not in DELETES:
            raise ValueError(f"delete detection is one of {DELETES}, not {self.mode!r}")
        if self.mode == "soft" and not self.column:
            raise ValueError("soft-delete detection needs its column")

    @classmethod
    def of(cls, setting: str | Mapping[str, Any] | DeleteDetection | None) -> DeleteDetection | None:
        """Accept a mode's name, a mapping of settings, or the settings themselves."""
        if setting is None or isinstance(setting, cls):
            return setting
        return cls(setting) if isinstance(setting, str) else cls(**setting)


@dataclass(frozen=True)
class Incremental:
    """Which rows are read and how they are merged."""

    mode: str = "full"
    tracking_column: str | None = None
    merge: str = "upsert"
    inclusive: bool = False
    force_full: bool = False
    on_duplicate: str = "raise"
    deletes: DeleteDetection | None = None

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {MODES}, not {self.mode!r}")
        if self.merge not in MERGES:
            raise ValueError(f"merge is one of {MERGES}, not {self.merge!r}")
        if self.mode in ("timestamp", "rowversion") and not self.tracking_column:
            raise ValueError(f"mode {self.mode!r} needs a tracking column")
        if self.deletes is not None and self.merge != "full" and self.mode in ("timestamp", "rowversion"):
            raise ValueError("delete detection needs a full merge")
        if self.merge == "full" and self.mode in ("timestamp", "rowversion") and self.deletes is None:
            raise ValueError("a full merge needs delete detection")


@dataclass(frozen=True)
class Options:
    """Write and guard options.

    ``writers`` bounds how many files are written at once. ``empty`` says whether a merge
    of no rows ends quietly or goes to the minimum-row guard. ``top`` reads so many rows a
    run: the oldest that are new, with all of one age, where a column tracks changes.
    """

    min_rows: int = 0
    force: bool = False
    skip: bool = False
    append: bool = False
    batch_rows: int | None = None
    writers: int | None = None
    top: int = 0
    empty: str = "noop"
    keep_versions: int = 2

    def __post_init__(self) -> None:
        if self.batch_rows is not None and self.batch_rows <= 0:
            raise ValueError("batch_rows must be above 0")
        if self.writers is not None and self.writers <= 0:
            raise ValueError("writers must be above 0")
        if self.keep_versions < 2:
            raise ValueError("keep_versions must be at least 2, the last one for earlier readers")
        if self.empty not in ("noop", "guard"):
            raise ValueError("empty is 'noop' or 'guard'")
        if self.min_rows < 0:
            raise ValueError("min_rows must not be negative")


@dataclass(frozen=True)
class JobSpec:
    """One relay job.

    ``folder`` is the shared folder that holds its table's versions. With ``bucket``, an
    SQL expression over the keys, a merge rewrites only the buckets it touches.
    """

    job_id: str
    source: DataFrame
    target: str
    folder: str
    keys: Sequence[str] = ()
    mappings: Sequence[tuple[str, str]] | None = None
    incremental: Incremental = field(default_factory=Incremental)
    options: Options = field(default_factory=Options)
    bucket: str | None = None

    def __post_init__(self) -> None:
        if self.bucket is not None and self.incremental.mode not in ("timestamp", "rowversion"):
            raise ValueError("a bucketed table takes incremental runs")
        if self.incremental.mode == "snapshot" and (self.options.append or self.options.top):
            raise ValueError("snapshot mode compares whole tables: it takes neither append nor top")
        if not self.job_id.strip() or not self.target.strip() or not self.folder.strip():
            raise ValueError("a job needs an id, a target table and a folder")
        if self.incremental.mode != "full" and not self.keys:
            raise ValueError(f"mode {self.incremental.mode!r} needs key columns")

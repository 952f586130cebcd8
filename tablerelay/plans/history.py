"""The history that a run writes about itself: a start record, and an end record."""

from __future__ import annotations

import time
import traceback
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablerelay.operators.history import record_run

RECORD_SCHEMA = (
    "execution_id string, config_id string, start_time timestamp_ntz, end_time timestamp_ntz, duration_ms bigint, "
    "status string, execution_mode string, rows_read bigint, rows_inserted bigint, rows_updated bigint, "
    "rows_deleted bigint, error_message string, error_stack_trace string, recorded_at bigint"
)


class RunRecord:
    """Appends the records of one run. ``started_at`` is the run's clock; its end is as much
    later as the run took."""

    def __init__(self, spark: SparkSession, path: str, config_id: str, mode: str, started_at: str) -> None:
        self.spark, self.path, self.began = spark, path, time.monotonic()
        self.fixed = {"execution_id": uuid.uuid4().hex, "config_id": config_id, "execution_mode": mode, "start_time": started_at}

    def _append(self, order: int, **values: Any) -> None:
        said = {**self.fixed, **values, "recorded_at": order}
        fields = self.spark.createDataFrame([], RECORD_SCHEMA).schema.fields
        row = self.spark.range(1).select(*[F.lit(said.get(f.name)).cast(f.dataType).alias(f.name) for f in fields])
        row.coalesce(1).write.mode("append").parquet(self.path)

    def _end(self, status: str, **values: Any) -> None:
        took = round((time.monotonic() - self.began) * 1000)
        row = self.spark.sql(f"SELECT CAST(TIMESTAMP_NTZ '{self.fixed['start_time']}' + make_dt_interval(0, 0, 0, {took} / 1000.0) AS STRING) AS t")
        self._append(1, status=status, duration_ms=took, end_time=row.first()["t"], **values)

    def started(self) -> None:
        self._append(0, status="Running")

    def succeeded(self, rows_read: int, changes: Mapping[str, int]) -> None:
        counted = {f"rows_{action.lower()}{'d' if action.endswith('E') else 'ed'}": n for action, n in changes.items()}
        self._end("Success", rows_read=rows_read, **counted)

    def failed(self, error: Exception) -> None:
        self._end("Failed", error_message=str(error), error_stack_trace="".join(traceback.format_exception(error)))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """One row per run: what its records say, the end over the start."""
    return record_run(spark.read.schema(RECORD_SCHEMA).parquet(path))

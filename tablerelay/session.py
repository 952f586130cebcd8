"""Session helpers: the shared folder for written tables, and UTC literals."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_local_folder: str | None = None


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder that every executor can reach, for tables a job writes.

    The cluster names the parent in ``spark.checkpoint.dir``. Where that is unset
    a temporary folder is made, but only for a local master: on a cluster a
    machine-local folder would lose data together with its machine.
    """
    global _local_folder
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        if _local_folder is None:
            _local_folder = tempfile.mkdtemp(prefix="tablerelay-")
        base = _local_folder
    return f"{base.rstrip('/')}/tablerelay/{label}-{uuid.uuid4().hex}"


def ntz(value: str | dt.datetime | dt.date) -> Column:
    """A zone-free timestamp literal. All clocks in this library are UTC."""
    text = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else str(value)
    return F.lit(text).cast("timestamp_ntz")


def before(as_of: str | dt.datetime, *, days: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    """The instant a given span before ``as_of``."""
    span = days * 1440 + hours * 60 + minutes
    return ntz(as_of) - F.expr(f"INTERVAL '{span}' MINUTE")

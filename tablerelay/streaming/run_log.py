"""Counting run-log lines as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tablerelay.sources.run_log import RUN_LOG_SCHEMA, at_least, count_events


def stream_run_log(
    spark: SparkSession, path: str, counts_path: str, checkpoint: str, minimum: str = "Trace",
    files_per_batch: int = 100,
) -> StreamingQuery:
    """Keep lines per event and level, over everything read so far, in ``counts_path``.

    The counts are as many as there are kinds of events, and replace the earlier ones.
    """
    lines = spark.readStream.schema(RUN_LOG_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)

    def publish(counts: DataFrame, batch_id: int) -> None:
        counts.write.mode("overwrite").parquet(counts_path)

    return (
        count_events(at_least(lines, minimum))
        .writeStream.outputMode("complete")
        .foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

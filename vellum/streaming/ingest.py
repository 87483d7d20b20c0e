"""Structured Streaming over arriving document files, and a running duplicate report.

Batch analyses stay as they are: every micro-batch of files goes through the same scans and is
appended to tables, with the batch number as a column so that a replayed batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, content) of document files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    return stream.where(F.lower("path").endswith(".pdf")).select("path", "content")


def ingest(stream: DataFrame, scans: Mapping[str, Callable[[DataFrame], DataFrame]], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends each scan of every micro-batch to `out`/<name>/batch=<number>.

    A batch that is run again after a failure overwrites its own partition, so rows come once.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, scan in scans.items():
                scan(batch).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, kind, events) in tumbling windows; rows later than `late` behind the stream are left out."""
    w = F.window(time, window)
    return events.withWatermark(time, late).groupBy(w, kind).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), kind, "events")

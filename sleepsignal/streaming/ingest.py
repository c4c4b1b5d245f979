"""Resumable ingestion: every run takes the session files that are new since the last one."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from sleepsignal.sources.quarantine import Store, take_in


def session_stream(spark: SparkSession, root: str, schema: StructType, fmt: str = "parquet", batch_size: int = 10, pattern: str | None = None) -> DataFrame:
    """Stream of arriving session files, at most ``batch_size`` files per batch."""
    r = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", batch_size)
    if pattern is not None:
        r = r.option("pathGlobFilter", pattern)
    if fmt == "csv":
        r = r.option("header", "true")
    return r.load(root)


def line_stream(spark: SparkSession, root: str, batch_size: int = 10, pattern: str = "*.csv*") -> DataFrame:
    """Stream of the lines of arriving files with their path; a damaged archive doesn't stop it."""
    r = spark.readStream.format("text").option("maxFilesPerTrigger", batch_size).option("pathGlobFilter", pattern)
    r = r.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    return r.load(root).selectExpr("_metadata.file_path AS path", "value")


def ingest_tolerant(
    stream: DataFrame, schema: StructType, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, timeout_s: int | None = None, **options
) -> tuple[DataFrame | None, DataFrame]:
    """``ingest`` over a ``line_stream`` in which some files are bad: all extracted rows, and the rejects with their reason.

    A bad file costs its own rows only. A batch owns its folders, so one that is run again replaces its own rows.
    """
    store = Store(stream.sparkSession, out)

    def write(batch: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in batch.select("path").distinct().collect()]  # as many as a batch may hold
        if paths:
            take_in(store, [unquote(p) for p in paths], schema, extract, f"{batch_id:08d}", **options)

    run_waiting(stream, write, checkpoint, timeout_s)
    return store.get("rows"), store.rejects()


def ingest(
    stream: DataFrame, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, timeout_s: int | None = None
) -> None:
    """Process all waiting files batch by batch, then stop; a later call resumes from the checkpoint.

    A batch owns one folder of the output, so a batch that is run again after a failure
    replaces its own rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    run_waiting(stream, write, checkpoint, timeout_s)


def run_waiting(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, timeout_s: int | None) -> None:
    """Run all waiting batches through ``write``, then stop."""
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(timeout_s) if timeout_s else q.awaitTermination()
    if q.isActive:
        q.stop()
        raise TimeoutError(f"ingestion did not finish within {timeout_s} s")
    if q.exception() is not None:
        raise q.exception()

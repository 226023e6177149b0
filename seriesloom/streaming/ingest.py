"""Idempotent ingest of new content and of new files in a folder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.streaming.manifest import PREFIXES, append_batch
from seriesloom.streaming.settled import releases, settled_files

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state on local disk with changelogs instead of on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def once_per_content(events: DataFrame, lateness: str, content: str = "content_hash", ts: str = "ts") -> DataFrame:
    """First row of every content within the lateness horizon."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if not rows.isStreaming:
        return rows.dropDuplicates([content])
    return rows.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([content])


def _run_of(progress: str) -> str:
    """Names the run of a stream: batch numbers count within one progress folder only."""
    return hashlib.sha256(progress.encode()).hexdigest()[:16]


def ingest_stream(events: DataFrame, store: str, progress: str, content: str = "content_hash", prefixes: int = PREFIXES) -> None:
    """Drain the stream into the store, each content once over all runs."""
    run = _run_of(progress)
    query = (
        events.writeStream.foreachBatch(lambda batch, number: append_batch(batch, store, f"{run}-{number}", content, prefixes))
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def watch_folder(
    spark: SparkSession, folder: str, store: str, progress: str, convert: Callable[[DataFrame], DataFrame], pattern: str = "*",
    settle: float = 2.0, content: bool = True, prefixes: int = PREFIXES, per_batch: int = 1000,
) -> None:
    """Convert each file once, when it has settled; a file whose result is already stored is skipped.

    ``convert`` gets path, modificationTime, length and content (null unless asked for) and keeps the path.
    A look releases at most ``per_batch`` files and a run takes one look, so runs follow each other until one doesn't
    fill its batch: then every file that had settled is in.
    """
    run = _run_of(progress)

    def each(batch: DataFrame, number: int) -> None:
        append_batch(convert(batch), store, f"{run}-{number}", "path", prefixes)

    log = f"{progress}/files"
    files = settled_files(spark, folder, log, pattern, settle, per_batch, content)
    full = True
    while full:
        before = len(releases(log))
        query = files.writeStream.foreachBatch(each).option("checkpointLocation", f"{progress}/stream").trigger(availableNow=True).start()
        query.awaitTermination()
        full = max(releases(log)[before:], default=0) >= per_batch

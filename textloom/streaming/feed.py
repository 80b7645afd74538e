"""Keeping an index up to date from streams."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import iso_time
from ..operators.changes import latest_versions
from ..plans.index import Index, apply_changes, doc_bucket_of, merge_segments, open_index
from ..plans.refresh import RefreshReport, refresh
from ..plans.workdir import materialize
from ..sources.files import check_scan_options

FEED_SCHEMA = "path string, op string, content string, mtime double"


def feed_changes(feed: DataFrame) -> DataFrame:
    """Change rows for ``apply_changes`` from ``path, op, content, mtime``.

    ``op`` is ``upsert`` or ``delete``; the latest version of a path wins.
    """
    deleted = F.col("op") == "delete"
    return latest_versions(feed).select(
        "path", F.when(deleted, "deleted").otherwise("ok").alias("status"),
        F.octet_length(F.coalesce("content", F.lit(""))).alias("size"), "mtime",
        F.lit("utf-8").alias("encoding"),
        F.when(~deleted, F.coalesce("content", F.lit(""))).alias("content"),
        F.lit(None).cast("string").alias("error"), iso_time("mtime").alias("last_modified"))


def not_outdated(changes: DataFrame, index: Index | None) -> DataFrame:
    """Changes that are not older than what is stored, or was deleted, of their path.

    At equal times a deletion wins over a version, a later arrival over an earlier one.
    Changes without a time are taken as they come.
    """
    if index is None:
        return changes
    touched = [r[0] for r in changes.select(doc_bucket_of("path", index.doc_buckets)).distinct().collect()]
    stored = index.metadata(touched).select("path", F.col("mtime").alias("stored_at"))
    gone = index.deletions()
    mtime, deletes = F.col("mtime"), F.col("status") == "deleted"
    after_stored = F.coalesce(mtime >= F.col("stored_at"), F.lit(True))
    after_gone = F.coalesce(F.when(deletes, mtime >= F.col("deleted_at"))
                            .otherwise(mtime > F.col("deleted_at")), F.lit(True))
    return (changes.join(stored, "path", "left").join(gone, "path", "left")
            .where(after_stored & after_gone).select(*changes.columns))


def stream_index(feed: DataFrame, location: str, checkpoint: str, trigger: dict | None = None,
                 **options) -> StreamingQuery:
    """Apply a stream of changes to an index, one segment per micro-batch.

    The commit records the last batch of every stream, so that one replayed after a
    failure is not applied twice. Versions may arrive in any order: an older one than
    the stored one is passed over, and so is one from before a deletion, whose paths
    and times are kept in ``deletions``. Segments are merged as they grow in number.
    ``trigger`` defaults to what is available now.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        index = open_index(spark, location)
        if index is not None and index.streams.get(checkpoint, -1) >= batch_id:
            return
        changes = materialize(not_outdated(feed_changes(batch), index), "feed")
        apply_changes(spark, location, changes, time.time(), stream=checkpoint, batch_id=batch_id,
                      **options)
        merge_segments(spark, location)

    return (feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def stream_rescan(spark: SparkSession, source: str, location: str, checkpoint: str,
                  interval_seconds: int = 300,
                  on_report: Callable[[RefreshReport], None] | None = None,
                  on_error: Callable[[Exception], None] | None = None,
                  **options) -> StreamingQuery:
    """Refresh the index from its source tree at every interval.

    A failed refresh ends the stream, which tells of it; with ``on_error`` that is
    called instead and the next one is tried.
    """
    check_scan_options(source, location, interval_seconds=interval_seconds)

    def rescan(batch: DataFrame, batch_id: int) -> None:
        try:
            report = refresh(spark, source, location, **options)
        except Exception as error:
            if on_error is None:
                raise
            on_error(error)
            return
        if on_report is not None:
            on_report(report)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (ticks.writeStream.foreachBatch(rescan).option("checkpointLocation", checkpoint)
            .trigger(processingTime=f"{interval_seconds} seconds").start())

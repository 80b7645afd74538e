"""Comparing the current listing with the stored snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def classify_changes(current: DataFrame, previous: DataFrame, force: bool = False) -> DataFrame:
    """``path, action`` with action added, updated, unchanged or removed.

    Both inputs carry ``path, size, mtime``. One full outer join on the path;
    any difference in size or mtime counts as a change, an older mtime too, and so does
    one in ``digest`` if both carry it. With ``force`` every file known before is updated.
    """
    compared = [c for c in ("size", "mtime", "digest") if c in current.columns and c in previous.columns]
    now = current.select("path", *[F.col(c).alias(f"new_{c}") for c in compared], F.lit(True).alias("is_now"))
    before = previous.select("path", *[F.col(c).alias(f"old_{c}") for c in compared],
                             F.lit(True).alias("was_before"))
    same = F.lit(not force)
    for c in compared:
        same = same & F.col(f"new_{c}").eqNullSafe(F.col(f"old_{c}"))
    action = (F.when(F.col("was_before").isNull(), "added")
              .when(F.col("is_now").isNull(), "removed")
              .when(same, "unchanged").otherwise("updated"))
    return now.join(before, "path", "full_outer").select("path", action.alias("action"))


def changed_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows of the current listing that are new or differ from the snapshot."""
    before = previous.select("path", F.col("size").alias("old_size"),
                             F.col("mtime").alias("old_mtime"))
    differs = (~F.col("size").eqNullSafe(F.col("old_size"))
               | ~F.col("mtime").eqNullSafe(F.col("old_mtime")))
    return (current.join(before, "path", "left").where(differs)
            .select(*[current[c] if c != "path" else F.col("path") for c in current.columns]))


def deleted_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Stored paths that the current listing no longer holds."""
    return previous.select("path").join(current.select("path"), "path", "left_anti")


def moved_files(added: DataFrame, removed: DataFrame) -> DataFrame:
    """``path, moved_from`` of files whose content went from one path to another.

    Both inputs carry ``path, digest``. A move is told where exactly one added and one
    removed file have a content: which of several copies went where cannot be known, so
    these stay added and removed, as do files without a digest. One aggregation by
    digest, combined before its shuffle, so a content that many files have costs nothing.
    """
    nowhere = F.lit(None).cast("string")
    sides = added.select("digest", "path", nowhere.alias("moved_from")).unionByName(
        removed.select("digest", nowhere.alias("path"), F.col("path").alias("moved_from")))
    return (sides.where("digest is not null").groupBy("digest")
            .agg(F.count("path").alias("n_added"), F.count("moved_from").alias("n_removed"),
                 F.min("path").alias("path"), F.min("moved_from").alias("moved_from"))
            .where("n_added = 1 and n_removed = 1").select("path", "moved_from"))


def latest_versions(feed: DataFrame, order: Column | None = None) -> DataFrame:
    """The last row of each path in a change feed; ties fall to a delete."""
    order = F.desc("mtime") if order is None else order
    newest = Window.partitionBy("path").orderBy(order, F.asc("op"))
    return (feed.withColumn("_place", F.row_number().over(newest))
            .where("_place = 1").drop("_place"))


def _failed() -> Column:
    return F.col("action").isin("added", "updated") & (F.col("status") != "ok")


def refresh_summary(outcomes: DataFrame, duration_seconds: float = 0.0) -> DataFrame:
    """One row of counters over ``path, action, status``.

    ``status`` (ok, error, skipped) matters for added and updated rows only.
    """
    done = F.col("action").isin("added", "updated") & (F.col("status") == "ok")
    counts = outcomes.agg(
        F.count_if(done).alias("files_processed"),
        F.count_if(done & (F.col("action") == "added")).alias("files_added"),
        F.count_if(done & (F.col("action") == "updated")).alias("files_updated"),
        F.count_if(F.col("action") == "removed").alias("files_removed"),
        F.count_if(_failed()).alias("errors"))
    return counts.select(
        (F.col("errors") == 0).alias("success"), "files_processed", "files_added",
        "files_updated", "files_removed", "errors",
        F.round(F.lit(float(duration_seconds)), 2).alias("duration_seconds"))


def refresh_errors(outcomes: DataFrame) -> DataFrame:
    """``path, message``, one row per file that could not be indexed.

    A table and not a list in the summary row, as a run may fail on any number
    of files.
    """
    return outcomes.where(_failed()).select(
        "path", F.concat(F.lit("Failed to index "), F.col("path")).alias("message"))

"""Refreshing an index from a directory tree."""

from __future__ import annotations

import os
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filetypes import DEFAULT_EXTENSIONS, within_size
from ..operators.changes import refresh_errors, refresh_summary
from ..sources.files import (
    binary_files, check_scan_options, read_bytes, read_text, resolve_path, scan_corpus,
)
from .index import Index, apply_changes, merge_segments, open_index, plan_refresh
from .workdir import materialize


class RefreshReport:
    """Counters of a run (``summary``), failed files (``errors``), and every file."""

    def __init__(self, outcomes: DataFrame, seconds: float, index: Index | None):
        self.outcomes = outcomes
        self.summary = refresh_summary(outcomes, seconds)
        self.errors = refresh_errors(outcomes)
        self.index = index


def _run(spark: SparkSession, location: str, raw: DataFrame, actions: DataFrame,
         run_time: float, started: float, options: dict,
         too_large: DataFrame | None = None) -> RefreshReport:
    """Decode the files to process, store what came of them, and count.

    Files in ``too_large`` are skipped with a reason; what is stored of them stays.
    """
    read = read_text(raw)
    if too_large is not None:
        nothing = [F.lit(None).cast("string").alias(c) for c in ("encoding", "content")]
        read = read.unionByName(too_large.select(
            "path", "size", "mtime", F.lit("skipped").alias("status"), *nothing,
            F.concat(F.lit("Larger than the size cap: "), "size", F.lit(" bytes")).alias("error"),
            F.lit(None).cast("string").alias("last_modified")))
    read = materialize(read, "read")
    removed = actions.where("action = 'removed'").select(
        "path", F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("mtime"),
        F.lit("deleted").alias("status"), *[F.lit(None).cast("string").alias(c) for c in
                                            ("encoding", "content", "error", "last_modified")])
    changes = read.unionByName(removed).where("status <> 'skipped'")
    index = open_index(spark, location)
    if index is None or not changes.isEmpty():
        apply_changes(spark, location, changes, run_time, **options)
        index = merge_segments(spark, location)
    outcomes = actions.join(read.select("path", "status", F.col("error").alias("reason")),
                            "path", "left")
    return RefreshReport(outcomes, time.time() - started, index)


def refresh(spark: SparkSession, source: str, location: str, force: bool = False,
            include: Iterable[str] = DEFAULT_EXTENSIONS, exclude: Iterable[str] = (),
            max_mb: float | None = None, run_time: float | None = None, reader: str = "tree",
            **options) -> RefreshReport:
    """Bring the index up to date with a directory tree.

    Lists the tree, compares it with the stored snapshot, reads the new and the
    changed files and drops what is gone. Binary files are skipped and counted
    as errors each time; an older version of them stays until the path is gone.
    So are files above ``max_mb``, if a cap is given; ``outcomes`` says why.
    With ``reader="binaryFile"`` the source may be any URI that Spark can read;
    the scan then passes over the bytes of unchanged files too.
    ``options`` (stem, doc_buckets, term_buckets) matter for a first run.
    """
    started = time.time()
    if "://" not in source:
        check_scan_options(source, location, include, exclude, max_mb)
        source = os.path.realpath(source)
    files = materialize(
        scan_corpus(spark, source, location, include, exclude, reader=reader), "listing")
    actions = materialize(plan_refresh(open_index(spark, location), files, force), "actions")
    listed = files.join(actions.where("action in ('added', 'updated')").select("path"),
                        "path", "left_semi").select("path", "size", "mtime")
    wanted = listed.where(within_size("size", max_mb))
    too_large = None if max_mb is None else listed.where(~within_size("size", max_mb))
    if reader == "tree":
        raw = read_bytes(wanted)
    else:
        raw = binary_files(spark, source).join(wanted.select("path"), "path", "left_semi")
    return _run(spark, location, raw, actions,
                started if run_time is None else run_time, started, options, too_large)


def refresh_file(spark: SparkSession, source: str, location: str, filepath: str,
                 run_time: float | None = None, **options) -> RefreshReport:
    """Index one file below the source; extension lists and the size cap do not apply.

    Raises ValueError for a path outside the source and FileNotFoundError for a
    missing file; nothing is deleted then.
    """
    started = time.time()
    path = resolve_path(source, filepath)
    if not os.path.isfile(path):
        raise FileNotFoundError(f"File not found: {path}")
    stat = os.stat(path)
    one = spark.createDataFrame([(path, stat.st_size, stat.st_mtime)],
                                "path string, size long, mtime double")
    index = open_index(spark, location)
    known = False
    if index is not None:
        known = not index.metadata().where(F.col("path") == path).isEmpty()
    actions = one.select("path", F.lit("updated" if known else "added").alias("action"))
    return _run(spark, location, read_bytes(one), actions,
                started if run_time is None else run_time, started, options)

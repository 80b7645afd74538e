"""A directory tree as DataFrames: listing, filtering, reading, decoding.

Two listings give the same columns ``path, size, mtime``:

* ``tree`` (default) lists directories in tasks, level by level. It keeps empty files and
  names that start with ``_`` or ``.``, which Spark's file sources skip. The tree must
  be mounted at the same place on all executors.
* ``binaryFile`` works on every file system Spark can reach (object stores,
  HDFS) and skips those files.

Content is read in a second step, for the paths that need it.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filetypes as ft
from ..functions.times import iso_time
from ..plans.workdir import materialize

LISTING_SCHEMA = "path string, size long, mtime double"
_LEVEL_ARROW = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.float64()), ("folder", pa.string())])
_BATCH_ROWS = 4096
_BATCH_BYTES = 32 << 20
_FOLDERS_PER_TASK = 64


def _not_gone(error: OSError) -> None:
    """A directory that can't be listed fails the scan: its files would count as deleted."""
    if not isinstance(error, FileNotFoundError):
        raise error


def _list_directory(folder: str) -> Iterator[tuple[str, int, float]]:
    """The files of a directory; one that is gone since planning has none."""
    try:
        entries = os.scandir(folder)
    except OSError as error:
        _not_gone(error)
        return
    with entries:
        for entry in entries:
            if entry.is_dir():
                continue
            try:
                stat = entry.stat()
            except FileNotFoundError:  # gone meanwhile, or a link to nothing
                continue
            yield os.path.join(folder, entry.name), stat.st_size, stat.st_mtime


def _subfolders(folder: str, skipped: str | None) -> Iterator[str]:
    """The directories in a directory; links are not followed, and one that is gone has none."""
    try:
        entries = os.scandir(folder)
    except OSError as error:
        _not_gone(error)
        return
    with entries:
        for entry in entries:
            if entry.is_dir(follow_symlinks=False) and os.path.realpath(entry.path) != skipped:
                yield entry.path


def _lister(skipped: str | None):
    """Rows of the files and, with a null path, of the directories in each directory."""
    def listed(folders):
        for folder in folders:
            for path, size, mtime in _list_directory(folder):
                yield path, size, mtime, None
            for sub in _subfolders(folder, skipped):
                yield None, None, None, sub

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = listed(batch.column("folder").to_pylist())
            while part := list(islice(rows, _BATCH_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _LEVEL_ARROW)],
                                                 schema=_LEVEL_ARROW)
    return run


def check_scan_options(source: str, index_dir: str | None = None, include: Iterable[str] = (),
                       exclude: Iterable[str] = (), max_mb: float | None = None,
                       interval_seconds: float = 300) -> None:
    """Raises one ValueError that names everything wrong with the arguments."""
    wrong = [f"extension {e!r} has no leading dot" for e in (*include, *exclude) if e[:1] != "."]
    if max_mb is not None and max_mb <= 0:
        wrong.append(f"a size cap of {max_mb} MB lets nothing pass; leave it out for no cap")
    if interval_seconds < 60:
        wrong.append(f"rescans every {interval_seconds} s, less than a minute apart")
    if not os.path.isdir(source):
        wrong.append(f"{source} is no directory to scan")
    elif index_dir and os.path.exists(index_dir) and os.path.samefile(source, index_dir):
        wrong.append(f"the index would be written into the scanned directory {source}")
    if wrong:
        raise ValueError("; ".join(wrong))


def resolve_path(source: str, filepath: str) -> str:
    """Absolute path of a file named by the caller; it must lie below the source."""
    root = os.path.realpath(source)
    path = os.path.realpath(os.path.join(root, filepath))
    if not path.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"Path outside source directory: {filepath}")
    return path


def list_tree(spark: SparkSession, source: str, exclude_dir: str | None = None) -> DataFrame:
    """``path, size, mtime`` of all files below a directory, on the executors.

    A job for each level of the tree: its directories are a table, which is spread over
    all tasks. The driver only asks if there is another level.
    """
    skipped = os.path.realpath(exclude_dir) if exclude_dir else None
    root, files = os.path.abspath(source), None
    folders = spark.createDataFrame([(root,)] if os.path.realpath(root) != skipped else [], "folder string")
    while True:
        level = materialize(folders.mapInArrow(_lister(skipped), f"{LISTING_SCHEMA}, folder string"), "listing")
        found = level.where("path is not null").drop("folder")
        files = found if files is None else files.unionByName(found)
        folders = level.where("folder is not null").select("folder")
        n = folders.count()
        if not n:
            return files
        # So many directories to a task that small levels need no more than one.
        folders = folders.repartition(-(-n // _FOLDERS_PER_TASK), "folder")


def binary_files(spark: SparkSession, source: str) -> DataFrame:
    """``path, size, mtime, content`` of a tree through Spark's own file source."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
            .select(F.regexp_replace("path", "^file:/+", "/").alias("path"),
                    F.col("length").alias("size"),
                    (F.unix_micros("modificationTime") / 1000000).alias("mtime"),
                    "content"))


def filter_files(files: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = (),
                 max_mb: float | None = None, index_dir: str | None = None) -> DataFrame:
    """Extension, size and location filters; adds ``ext``. There is no cap by default."""
    files = files.withColumn("ext", ft.extension("path"))
    keep = ft.has_extension("ext", tuple(include), tuple(exclude)) & ft.within_size("size", max_mb)
    if index_dir:
        keep &= ~F.startswith(F.col("path"), F.lit(index_dir.rstrip("/") + "/"))
    return files.where(keep)


def scan_corpus(spark: SparkSession, source: str, index_dir: str | None = None,
                include: Iterable[str] = ft.DEFAULT_EXTENSIONS, exclude: Iterable[str] = (),
                max_mb: float | None = None, reader: str = "tree") -> DataFrame:
    """The files to index: ``path, ext, size, mtime``. No content is read."""
    if reader == "tree":
        files = list_tree(spark, source, index_dir)
    else:
        files = binary_files(spark, source).drop("content")
    inside = os.path.abspath(index_dir) if index_dir and "://" not in index_dir else index_dir
    return (filter_files(files, include, exclude, max_mb, inside)
            .select("path", "ext", "size", "mtime"))


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append the bytes of each path; batches are cut by bytes, not only by rows."""
    def emit(rows, contents):
        return pa.RecordBatch.from_arrays(
            [*rows.columns, pa.array(contents, pa.binary())],
            schema=rows.schema.append(pa.field("content", pa.binary())))

    for batch in batches:
        start, held, contents = 0, 0, []
        for at, path in enumerate(batch.column("path").to_pylist()):
            try:
                with open(path, "rb") as handle:
                    contents.append(handle.read())
                held += len(contents[-1])
            except OSError:
                contents.append(None)
            if held >= _BATCH_BYTES:
                yield emit(batch.slice(start, at + 1 - start), contents)
                start, held, contents = at + 1, 0, []
        yield emit(batch.slice(start), contents)


def read_bytes(files: DataFrame) -> DataFrame:
    """Add ``content`` (binary) to rows with a ``path``; NULL where it is unreadable.

    Rows are spread by path first, as a listing groups whole directories.
    """
    schema = files.schema.add("content", "binary")
    return files.repartition("path").mapInArrow(_read_batches, schema)


def read_text(files: DataFrame, check_content: bool = True,
              probe_bytes: int | None = None) -> DataFrame:
    """Decode raw files: ``path, size, mtime, status, encoding, content, error, last_modified``.

    ``status`` is ``ok``, ``error`` (text that does not decode; content is NULL)
    or ``skipped`` (binary, unreadable, or not a text extension). The whole content
    is judged unless ``probe_bytes`` says how much of it.
    """
    raw = F.col("content")
    text_file = F.coalesce(
        ft.is_text(ft.extension("path"), raw if check_content else None, probe_bytes), F.lit(False))
    found = (files.withColumn("text_file", text_file & raw.isNotNull())
             .withColumn("encoding", F.when(F.col("text_file"), ft.detect_encoding("content", probe_bytes)))
             .withColumn("text", F.when(F.col("text_file"), ft.decode_text("content", "encoding"))))
    status = (F.when(~F.col("text_file"), "skipped")
              .when(F.col("text").isNull(), "error").otherwise("ok"))
    return found.withColumn("status", status).select(
        "path", "size", "mtime", "status",
        F.when(F.col("status") == "ok", F.col("encoding")).alias("encoding"),
        F.col("text").alias("content"),
        F.when(F.col("status") == "error",
               F.concat(F.lit("Failed to read file: not valid "), "encoding")).alias("error"),
        F.when(F.col("status") == "ok", iso_time("mtime")).alias("last_modified"))


def write_tree(files: DataFrame, root: str) -> int:
    """Write ``path, content`` rows as files below a folder all executors share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns):  # one at a time, as contents are large
                target = os.path.join(root, path.as_py().lstrip("/"))
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as handle:
                    handle.write(content.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    os.makedirs(root, exist_ok=True)
    written = files.select("path", "content").mapInArrow(run, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

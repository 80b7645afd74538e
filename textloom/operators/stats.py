"""Views and statistics over stored documents and their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import iso_time


def indexed_files(metadata: DataFrame, documents: DataFrame) -> DataFrame:
    """Metadata of every file, with ``last_modified`` of its document if it has one."""
    return metadata.select("path", "size", "mtime", "last_indexed", "encoding", "error").join(
        documents.select("path", "last_modified"), "path", "left")


def indexed_ok(metadata: DataFrame) -> DataFrame:
    return metadata.where(F.col("error").isNull()).select("path", "size", "encoding")


def with_errors(metadata: DataFrame) -> DataFrame:
    return metadata.where(F.col("error").isNotNull()).select("path", "error")


def needs_reindex(metadata: DataFrame) -> DataFrame:
    return metadata.where(F.col("mtime") > F.col("last_indexed")).select("path")


def document_count(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("n_documents"))


def index_stats(documents: DataFrame, metadata: DataFrame, size_bytes: int = 0) -> DataFrame:
    """One row: ``indexed_files, last_scan, index_size_mb, total_documents, errors_encountered``."""
    n_documents = document_count(documents).scalar()
    last = F.max("last_indexed")
    return metadata.agg(last.alias("last"), F.count("error").alias("errors_encountered")).select(
        n_documents.alias("indexed_files"),
        F.coalesce(iso_time("last"), F.lit("Never")).alias("last_scan"),
        F.round(F.lit(size_bytes / (1024 * 1024)), 2).alias("index_size_mb"),
        n_documents.alias("total_documents"), "errors_encountered")

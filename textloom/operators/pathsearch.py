"""Finding documents by path pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_like, preview
from .search import top_k


def search_by_path(documents: DataFrame, pattern: str, k: int = 10) -> DataFrame:
    """``path, snippet, score, last_modified`` of the first k paths that match.

    The k paths are taken in byte order; previews are made for those rows only.
    """
    hits = documents.where(path_like("path", pattern))
    best = top_k(hits, k, F.asc("path"))
    return best.select("path", preview("content").alias("snippet"),
                       F.lit(0.0).alias("score"), "last_modified")

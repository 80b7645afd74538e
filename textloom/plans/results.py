"""Searches of a stored index, answered with what a user wants to see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.snippets import WIDTH
from ..operators.batch import search_batch
from ..operators.classify import classify_query
from ..operators.search import search
from ..operators.snippets import with_batch_snippets, with_snippets
from .index import Index
from .workdir import materialize

FEW = 1000    # result rows whose ids are named in a filter


def search_results(index: Index, query: str | None, k: int = 10, width: int = WIDTH) -> DataFrame:
    """``path, snippet, score, last_modified`` of the best k documents, best first.

    The ids of a few rows prune the scan of the texts by the statistics of its row
    groups, as the files of a bucket are sorted by id; more of them are joined.
    """
    corpus = index.corpus()
    best = materialize(search(corpus, query, k), "results")
    texts = index.documents()
    if 0 <= k <= FEW:
        texts = texts.where(F.col("doc_id").isin([r["doc_id"] for r in best.select("doc_id").collect()]))
    else:
        texts = texts.join(best.select("doc_id"), "doc_id", "left_semi")
    named = best.join(texts.select("doc_id", "path", "last_modified"), "doc_id")
    units = list(classify_query(query, corpus.stem).units)
    rows = with_snippets(named, texts, units, corpus.stem, width, text_col="content")
    return rows.orderBy(F.desc("score"), "doc_id").select("path", "snippet", "score", "last_modified")


def search_results_batch(index: Index, queries: DataFrame, k: int = 10, width: int = WIDTH,
                         query_id: str = "query_id", query_col: str = "query") -> DataFrame:
    """``query_id, rank, path, snippet, score, last_modified`` for a table of queries."""
    corpus = index.corpus()
    best = materialize(search_batch(corpus, queries, k, query_id, query_col), "results")
    named = best.join(index.documents().select("doc_id", "path", "last_modified"), "doc_id")
    rows = with_batch_snippets(corpus, named, queries, index.documents(), width, text_col="content",
                               query_id=query_id, query_col=query_col)
    return rows.select("query_id", "rank", "path", "snippet", "score", "last_modified")

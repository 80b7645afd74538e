"""Joining result rows with their documents and highlighting the hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.snippets import WIDTH, snippet
from ..plans.workdir import materialize
from .batch import _query_units
from .classify import Unit, classify_query
from .corpus import Corpus

_PHRASES = "array<struct<terms:array<string>,prefix:boolean,first:boolean>>"


def _phrases(units: list[Unit]):
    return F.array(*[F.struct(F.array(*[F.lit(t) for t in u.terms]).alias("terms"),
                              F.lit(u.prefix).alias("prefix"), F.lit(u.first).alias("first"))
                     for u in units]).cast(_PHRASES)


def with_snippets(results: DataFrame, documents: DataFrame, units: list[Unit], stem: bool = True,
                  width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``snippet`` to the result rows of one query.

    Only the texts of result rows reach the helper: the join comes first.
    """
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    joined = results.join(texts, "doc_id")
    return joined.withColumn(
        "snippet", snippet("_text", _phrases(units), stem, width)).drop("_text")


def snippets_for_query(corpus: Corpus, results: DataFrame, documents: DataFrame, query: str,
                       **options) -> DataFrame:
    parsed = classify_query(query, corpus.stem)
    return with_snippets(results, documents, list(parsed.units), corpus.stem, **options)


def with_batch_snippets(corpus: Corpus, results: DataFrame, queries: DataFrame,
                        documents: DataFrame, width: int = WIDTH, id_col: str = "doc_id",
                        text_col: str = "text", query_id: str = "query_id",
                        query_col: str = "query") -> DataFrame:
    """Add ``snippet`` to the result rows of a table of queries."""
    units = _query_units(corpus, queries, query_id, query_col).where("required")
    phrases = units.groupBy("query_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("item_no", "terms", "first"))),
        lambda u: F.struct(u["terms"].alias("terms"), F.lit(False).alias("prefix"),
                           u["first"].alias("first"))).alias("_phrases"))
    # Stored first, so that the join with the texts is planned by the real size
    # of the result rows and need not shuffle the texts when they are few.
    wanted = materialize(results.join(phrases, "query_id"), "results")
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    joined = wanted.join(texts, "doc_id")
    return joined.withColumn(
        "snippet", snippet("_text", "_phrases", corpus.stem, width)).drop("_text", "_phrases")

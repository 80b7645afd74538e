"""Tokens, postings and corpus statistics of a table of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.grouping import grouper
from ..functions.porter import stem_tokens
from ..functions.text import tokenize


def with_tokens(docs: DataFrame, text_col: str = "text", stem: bool = True,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns and ``tokens``, an array that is empty for NULL text."""
    tokens = F.coalesce(tokenize(text_col), F.array().cast("array<string>"))
    out = docs.select(*keep, tokens.alias("tokens"))
    return out.withColumn("tokens", stem_tokens("tokens")) if stem else out


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                stem: bool = True) -> DataFrame:
    """``doc_id, pos, term``: one row per token."""
    tokens = with_tokens(docs, text_col, stem, (id_col,))
    return tokens.select(F.col(id_col).alias("doc_id"),
                         F.posexplode(_once(F.col("tokens"))).alias("pos", "term"))


def _once(tokens: Column) -> Column:
    """The same array as an expression of its own.

    Exploding a plain column makes Spark filter on its size first and push that
    filter below the column's definition, so that text would be tokenised twice.
    """
    return F.concat(tokens, F.array().cast("array<string>"))


def build_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   stem: bool = True, keep: tuple[str, ...] = (),
                   positions: bool = True) -> DataFrame:
    """``term, doc_id, tf, doc_len, positions``: one row per term of a document.

    All tokens of a document are in one row already, so they are grouped inside
    the task that tokenises it: no shuffle, whatever the term frequencies are.
    """
    rows = with_tokens(docs.withColumn("_id", F.col(id_col)), text_col, False, ("_id", *keep))
    rows = rows.withColumnRenamed("_id", "doc_id")
    schema = StructType([StructField("term", StringType()), StructField("tf", IntegerType()),
                         StructField("doc_len", IntegerType())])
    if positions:
        schema.add("positions", ArrayType(IntegerType()))
    for field in rows.schema:
        if field.name != "tokens":
            schema.add(field.name, field.dataType)
    grouped = rows.mapInArrow(grouper(stem, positions), schema)
    places = ("positions",) if positions else ()
    return grouped.select("term", "doc_id", "tf", "doc_len", *places, *keep)


def doc_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, doc_len`` of every row, 0 for empty text. Stemming does not matter."""
    return with_tokens(docs, text_col, False, (id_col,)).select(
        F.col(id_col).alias("doc_id"), F.size("tokens").alias("doc_len"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row ``n_docs, total_len`` over document lengths."""
    return lengths.agg(F.count("*").alias("n_docs"),
                       F.coalesce(F.sum("doc_len"), F.lit(0)).cast("long").alias("total_len"))


def term_stats(docs: DataFrame, text_col: str = "text", stem: bool = True) -> DataFrame:
    """``term, df, cf``: documents with the term, and its occurrences.

    Each document is reduced to its distinct terms first; the aggregation is
    partial before its shuffle, so a frequent term costs one row per task.
    """
    postings = build_postings(docs.withColumn("_row", F.lit(0)), "_row", text_col, stem,
                              positions=False)
    return postings.groupBy("term").agg(F.count("*").alias("df"),
                                        F.sum("tf").cast("long").alias("cf"))


def stemmed_vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, stem`` for the distinct terms of a corpus."""
    tokens = with_tokens(docs, text_col, False)
    terms = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).distinct()
    return terms.select("term", F.get(stem_tokens(F.array("term")), F.lit(0)).alias("stem"))

"""Ranked search for one query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bm25
from .classify import Unit, analyze, classify_query
from .corpus import Corpus, all_of, any_of, pos_name, tf_name

RESULT_SCHEMA = "doc_id long, score double"


def top_k(scored: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows; no limit for a negative k."""
    order = order or (F.desc("score"), F.asc("doc_id"))
    return scored.orderBy(*order) if k < 0 else scored.orderBy(*order).limit(k)


def no_results(corpus: Corpus) -> DataFrame:
    return corpus.spark.createDataFrame([], RESULT_SCHEMA)


def search_units(corpus: Corpus, units: list[Unit], mode: str = "all",
                 excluded: list[Unit] = (), k: int = 10) -> DataFrame:
    """``doc_id, score`` of the best k documents; ties go to the smaller id.

    ``mode`` is ``all`` or ``any`` of the units; documents with an excluded unit
    are left out. The parts of a score are added in the order of the units.
    """
    if mode not in ("all", "any"):
        raise ValueError(f"mode must be 'all' or 'any': {mode}")
    excluded = list(excluded)
    units = list(units)
    if not units:
        return no_results(corpus)
    found = corpus.best_of_any(units, k) if mode == "any" and not excluded else None
    found = found or corpus.hits([*units, *excluded], units if mode == "all" else ())
    tf = [F.col(tf_name(i)) for i in range(len(units) + len(excluded))]
    wanted, unwanted = tf[:len(units)], tf[len(units):]
    holds = (all_of if mode == "all" else any_of)([t > 0 for t in wanted])
    for t in unwanted:
        holds &= t == 0
    score = F.lit(0.0)
    for t, df in zip(wanted, found.dfs):
        added = bm25.part(t, F.col("doc_len"), bm25.idf(found.n_docs, df), found.avg_len)
        score = score + F.when(t > 0, added).otherwise(0.0)
    return top_k(found.frame.where(holds).select("doc_id", score.alias("score")), k)


def _units(corpus: Corpus, texts, **kind) -> list[Unit]:
    found = [analyze(text, corpus.stem) for text in texts]
    return [Unit(terms, **kind) for terms in found if terms]


def search_terms(corpus: Corpus, terms, mode: str = "all", exclude=(), k: int = 10) -> DataFrame:
    """Documents with all or any of the terms and none of the excluded ones.

    A term with several tokens (``foo_bar``) counts as a phrase.
    """
    return search_units(corpus, _units(corpus, terms), mode, _units(corpus, exclude), k)


def search_phrase(corpus: Corpus, phrase: str, k: int = 10) -> DataFrame:
    """Documents with the words of the phrase in a row."""
    return search_units(corpus, _units(corpus, [phrase]), k=k)


def search_prefix(corpus: Corpus, prefix: str, k: int = 10) -> DataFrame:
    """Documents with a token that starts with the folded and stemmed prefix.

    All matching tokens together are one scoring unit.
    """
    return search_units(corpus, _units(corpus, [prefix], prefix=True), k=k)


def search_first(corpus: Corpus, term: str, k: int = 10) -> DataFrame:
    """Documents which begin with the term."""
    return search_units(corpus, _units(corpus, [term], first=True), k=k)


def _marked(word: int):
    return lambda p: F.struct(F.lit(word).alias("word"), p.alias("pos"))


def search_near(corpus: Corpus, terms, n: int = 10, k: int = 10) -> DataFrame:
    """Documents where all terms lie in any order with at most n tokens between
    the outer two.

    Each term is scored with its document frequency in the whole corpus and with
    the occurrences that take part in such a group.
    """
    units = _units(corpus, terms)
    if any(len(u.terms) != 1 for u in units):
        raise ValueError("search_near takes single words")
    words = [u.terms[0] for u in units]
    if not words:
        return no_results(corpus)
    # The same word twice asks for nothing more, but it is scored twice.
    distinct = list(dict.fromkeys(words))
    found = corpus.places(distinct)
    marked = F.concat(*[F.transform(pos_name(i), _marked(i)) for i in range(len(distinct))])
    places = found.frame.select("doc_id", "doc_len", F.explode(marked).alias("p")).select(
        "doc_id", "doc_len", "p.*")

    # Walk the occurrences of a document backwards for the next place of every
    # term, which tells the starts of a group; then forwards for the last start.
    backwards = (Window.partitionBy("doc_id").orderBy(F.desc("pos"))
                 .rowsBetween(Window.unboundedPreceding, 0))
    forwards = (Window.partitionBy("doc_id").orderBy(F.asc("pos"))
                .rowsBetween(Window.unboundedPreceding, 0))
    ends = [F.min(F.when(F.col("word") == i, F.col("pos"))).over(backwards)
            for i in range(len(distinct))]
    is_start = all_of([F.coalesce(e <= F.col("pos") + n + 1, F.lit(False)) for e in ends])
    places = places.withColumn("start", F.when(is_start, F.col("pos")))
    places = places.withColumn("start", F.max("start").over(forwards))
    near = places.where(F.col("pos") - F.col("start") <= n + 1)
    counted = near.groupBy("doc_id").agg(
        F.max("doc_len").alias("doc_len"),
        *[F.count_if(F.col("word") == i).alias(tf_name(i)) for i in range(len(distinct))])
    score = F.lit(0.0)
    for w in words:
        i = distinct.index(w)
        score = score + bm25.part(F.col(tf_name(i)), F.col("doc_len"),
                                  bm25.idf(found.n_docs, found.dfs[i]), found.avg_len)
    return top_k(counted.select("doc_id", score.alias("score")), k)


def search(corpus: Corpus, query: str | None, k: int = 10) -> DataFrame:
    """Search for a query as a user types it; malformed or blank gives no rows.

    Quoted queries that mix AND, OR and NOT raise ValueError: write them with
    ``search_units``.
    """
    parsed = classify_query(query, corpus.stem)
    if parsed.mode == "complex":
        raise ValueError(f"combine this query from the search operators: {query}")
    if parsed.mode in ("empty", "invalid"):
        return no_results(corpus)
    return search_units(corpus, parsed.units, "any" if parsed.mode == "any" else "all",
                        parsed.excluded, k)


def with_rank(results: DataFrame) -> DataFrame:
    """Add ``rank`` 1..n to the few rows of one result list."""
    return results.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("doc_id"))))


def format_results(results: DataFrame, query: str, path_col: str = "path") -> DataFrame:
    """One row ``report``: the ranked result rows of one query as text."""
    line = F.format_string("%d. %s\n   Score: %.2f\n   Modified: %s\n   Snippet: %s\n\n",
                           "rank", path_col, "score", "last_modified", "snippet")
    lines = results.agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    body = F.concat_ws("", F.transform("l", lambda x: x["line"]))
    head = F.format_string("Found %d results for '%s':\n\n", F.size("l"), F.lit(query))
    return lines.select(F.when(F.size("l") == 0, F.lit(f"No results found for: {query}"))
                        .otherwise(F.concat(head, body)).alias("report"))

"""Ranked search for a whole table of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bm25
from ..plans.workdir import materialize
from .classify import classify_queries, stemmed_items
from .corpus import Corpus


def _query_units(corpus: Corpus, queries: DataFrame, id_col: str, query_col: str) -> DataFrame:
    """``query_id, mode, item_no, unit_id, terms, first, required``, a row per unit."""
    parsed = stemmed_items(classify_queries(queries, query_col), corpus.stem)
    rows = parsed.select(F.col(id_col).alias("query_id"), "mode", "items")
    # Queries that match nothing have no items. The array is not exploded as a
    # plain column, as Spark would then add a filter on its size and push the
    # whole classification into it, to be evaluated twice.
    items = F.filter("items", lambda x: x.isNotNull())
    rows = rows.select("query_id", "mode", F.posexplode(items).alias("item_no", "item"))
    key = F.concat_ws(" ", F.when(F.col("item.first"), "^"), F.col("item.terms"))
    return rows.select("query_id", "mode", "item_no", key.alias("unit_id"),
                       "item.terms", "item.first", "item.required")


def rejected_queries(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """The rows that a batch search gives no results for, with ``mode``.

    ``invalid``: malformed. ``complex``: to be combined from the search operators.
    """
    return classify_queries(queries, query_col).where("mode in ('invalid', 'complex')").drop("items")


def _unit_hits(corpus: Corpus, units: DataFrame) -> DataFrame:
    """``unit_id, doc_id, doc_len, tf`` for every distinct unit of all queries."""
    distinct = units.select("unit_id", "terms", "first").dropDuplicates(["unit_id"])
    words = distinct.select("unit_id", "first", F.size("terms").alias("n_terms"),
                            F.posexplode("terms").alias("offset", "term"))
    plain = words.where((F.col("n_terms") == 1) & ~F.col("first")).select("unit_id", "term")
    single = corpus.postings_of(plain).select("unit_id", "doc_id", "doc_len", "tf")

    if units.where((F.size("terms") > 1) | F.col("first")).isEmpty():
        return single

    # Phrases: the places where a phrase could start according to each of its
    # words; it does start where all of them agree.
    in_phrase = words.where((F.col("n_terms") > 1) | F.col("first"))
    offset = F.col("offset")
    rows = corpus.postings_of(in_phrase).select(
        "unit_id", "first", "n_terms", "doc_id", "doc_len",
        F.transform("positions", lambda p: p - offset).alias("starts"))
    grouped = rows.groupBy("unit_id", "doc_id").agg(
        F.max("first").alias("first"), F.max("n_terms").alias("n_terms"),
        F.max("doc_len").alias("doc_len"), F.collect_list("starts").alias("lists"))
    common = F.aggregate(F.slice("lists", 2, F.col("n_terms")), F.get("lists", F.lit(0)),
                         lambda a, b: F.array_intersect(a, b))
    tf = (F.when(F.size("lists") < F.col("n_terms"), 0)
          .when(F.col("first"), F.array_contains(common, 0).cast("int"))
          .otherwise(F.size(common)))
    phrases = grouped.select("unit_id", "doc_id", "doc_len", tf.alias("tf")).where("tf > 0")
    return single.unionByName(phrases)


def search_batch(corpus: Corpus, queries: DataFrame, k: int = 10, id_col: str = "query_id",
                 query_col: str = "query") -> DataFrame:
    """``query_id, rank, doc_id, score``: the best k documents of each query.

    Queries are classified like single ones. A unit used by many queries is
    looked up once. A query that needs all its units starts from the documents
    of its rarest one and looks up the others by (unit, document), so the
    frequent words of queries neither multiply rows nor form hot groups. Equal
    queries are answered once, and their few result rows are joined back.
    """
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(query_col).alias("query"))
    distinct = asked.select("query").distinct()
    best = _best_of_each(corpus, distinct.withColumn("id", F.col("query")), k)
    best = best.withColumnRenamed("query_id", "query")
    return asked.join(best, "query").select("query_id", "rank", "doc_id", "score")


def _best_of_each(corpus: Corpus, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, doc_id, score`` for ``id, query`` rows."""
    units = materialize(_query_units(corpus, queries, "id", "query"), "units")
    hits = materialize(_unit_hits(corpus, units), "hits")
    n_docs, total_len = corpus.totals()
    avg_len = total_len / n_docs if n_docs and total_len else 1.0
    dfs = hits.groupBy("unit_id").agg(F.count("*").alias("df"))
    units = units.drop("terms", "first").join(dfs, "unit_id", "left").withColumn(
        "idf", bm25.idf(n_docs, F.coalesce("df", F.lit(0))))
    part = bm25.part(F.col("tf"), F.col("doc_len"), F.col("idf"), avg_len)

    some = units.where("mode = 'any'").join(hits, "unit_id").select(
        "query_id", "doc_id", F.struct("item_no", part.alias("part")).alias("p"))
    some = some.groupBy("query_id", "doc_id").agg(F.collect_list("p").alias("parts"))

    # All units needed: one candidate row per document of the rarest unit.
    needs = units.where("mode <> 'any'")
    items = F.collect_list(F.struct("item_no", "unit_id", "required", "idf"))
    rarity = F.struct(F.coalesce("df", F.lit(0)), "item_no")
    rarest = F.min_by(F.col("unit_id"), F.when(F.col("required"), rarity))
    plans = needs.groupBy("query_id").agg(items.alias("items"), rarest.alias("unit_id"))
    candidates = plans.join(hits.select("unit_id", "doc_id"), "unit_id").select(
        "query_id", "doc_id", F.size("items").alias("n_items"), F.explode("items").alias("i"))
    candidates = candidates.select("query_id", "doc_id", "n_items", "i.*")
    looked_up = candidates.join(hits, ["unit_id", "doc_id"], "left")
    fits = F.col("required") == F.col("tf").isNotNull()
    value = F.when(F.col("required"), part)
    every = looked_up.where(fits).groupBy("query_id", "doc_id").agg(
        F.max("n_items").alias("n_items"), F.count("*").alias("n"),
        F.collect_list(F.when(F.col("required"), F.struct("item_no", value.alias("part"))))
        .alias("parts"))
    every = every.where("n = n_items").select("query_id", "doc_id", "parts")

    # Parts are added in the order of the units, as for a single query.
    score = F.aggregate(F.transform(F.sort_array("parts"), lambda p: p["part"]),
                        F.lit(0.0), lambda a, b: a + b)
    scored = some.unionByName(every).select("query_id", "doc_id", score.alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = scored.withColumn("rank", F.row_number().over(best))
    return (ranked if k < 0 else ranked.where(F.col("rank") <= k)).select(
        "query_id", "rank", "doc_id", "score")

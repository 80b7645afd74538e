
from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import filetypes as ft
from textloom.functions.porter import STEP2, STEP3, STEP4
from textloom.operators import changes as ch
from textloom.operators import postings as po
from textloom.operators import search as se
from textloom.operators import stats as st
from textloom.operators.batch import search_batch
from textloom.operators.classify import Unit, classify_queries
from textloom.operators.corpus import Corpus, DocumentCorpus
from textloom.operators.pathsearch import search_by_path
from textloom.operators.snippets import snippets_for_query, with_batch_snippets
from textloom.plans.index import Index, apply_changes, build_index, open_index
from textloom.plans.refresh import refresh, refresh_file
from textloom.plans.results import search_results
from textloom.plans.workdir import materialize, new_path, ship_package
from textloom.sources.files import filter_files, read_text, write_tree
from textloom.sources.tables import read_table
from textloom.streaming.feed import stream_index

try:
    from textloom.llm.queries import QUERIES as LLM_QUERIES
    from textloom.llm.queries import SQL as LLM_SQL
except ModuleNotFoundError as error:
    # The subpackage and its pipeline may be left out of an installation, and so may the
    # libraries that only they use.
    if (error.name or "").startswith(("textloom.", "pyspark")) and not error.name.startswith("textloom.llm"):
        raise
    LLM_QUERIES, LLM_SQL = {}, {}

SMALL = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    """The ten best documents for a term, straight from the documents table."""
    return queries()["q_bm25_term"](spark, SMALL)


# ---------------------------------------------------------------- inputs

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents seen as a file tree: doc_id, path, size, mtime, content."""
    docs = _table(spark, sf_dir, "documents")
    digit = F.col("doc_id") % 10
    ext = (F.when(digit < 5, ".txt").when(digit < 7, ".md").when(digit == 7, ".py")
           .when(digit == 8, ".LOG").otherwise(".bin"))
    return docs.select(
        "doc_id", F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/"),
                           F.col("doc_id").cast("string"), ext).alias("path"),
        F.octet_length("text").cast("long").alias("size"),
        (F.lit(1704067200) + F.col("doc_id") * 60).cast("double").alias("mtime"),
        F.col("text").alias("content"))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored snapshot: files as they were, so that every action occurs."""
    doc_id = F.col("doc_id")
    known = _files(spark, sf_dir).where(doc_id % 7 != 0).select(
        "path", (F.col("size") + (doc_id % 11 == 0).cast("long")).alias("size"),
        (F.col("mtime") - (doc_id % 13 == 0).cast("double")).alias("mtime"))
    gone = _table(spark, sf_dir, "pages").select(
        F.concat(F.lit("/corpus/pages/"), F.col("page_id").cast("string"), F.lit(".html"))
        .alias("path"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("mtime"))
    return known.unionByName(gone)


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_id = F.col("doc_id")
    failed = doc_id % 19 == 0
    return _files(spark, sf_dir).select(
        "path", "size", "mtime",
        (F.col("mtime") + F.when(doc_id % 17 == 0, -5).otherwise(5)).alias("last_indexed"),
        F.when(~failed, "utf-8").alias("encoding"),
        F.when(failed, "Failed to read file").alias("error"))


def _stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(F.col("doc_id") % 19 != 0).select(
        "path", "content", F.col("mtime").cast("long").cast("string").alias("last_modified"))


_indexes: dict[tuple, Index] = {}


def _index(spark: SparkSession, sf_dir: str, stem: bool = False) -> Index:
    """An index over all documents, built once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, stem)
    if key not in _indexes:
        _indexes[key] = build_index(_table(spark, sf_dir, "documents"), new_path(spark, "index"),
                                    stem=stem, doc_buckets=8, term_buckets=8)
    return _indexes[key]


def _scan(spark: SparkSession, sf_dir: str, stem: bool = False) -> Corpus:
    return DocumentCorpus(_table(spark, sf_dir, "documents"), stem=stem)


def _stored(spark: SparkSession, sf_dir: str, stem: bool = False) -> Corpus:
    return _index(spark, sf_dir, stem).corpus()


def _word_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of the first three words of each benchmark item."""
    words = F.slice(F.split("text", " "), 1, 3)
    return _table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.regexp_replace(F.array_join(words, " "), r"[^\p{L}\p{N} ]", "").alias("query"))


def _typed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query strings of every kind, made of the first words of each document."""
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    a, b = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    a, b = F.coalesce(a, F.lit("x")), F.coalesce(b, F.lit("y"))
    kind = F.col("doc_id") % 22

    def say(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    shapes = [
        say(a, " ", b), say('"', a, " ", b, '"'), say(a, " AND ", b), say(a, "*"), say(a, "'s"),
        say('"', a, '" OR "', b, '"'), say('"', a, '" AND "', b, '"'), say('"', a, '" NOT "', b, '"'),
        say('"', a, '" "', b, '"'), say(a, "++"), say(a, ",", b), say(a, "?"), F.lit('"'),
        say(a, "_", b), say("^", a), say(a, " + ", b), F.lit("   "), F.lit(None).cast("string"),
        F.lit('"---"'), say(a, "@", b, ".c"), say(a, " near ", b), say("and ", a, " + "),
    ]
    query = F.lit(None).cast("string")
    for number, shape in enumerate(shapes):
        query = F.when(kind == number, shape).otherwise(query)
    return _table(spark, sf_dir, "documents").select("doc_id", query.alias("query"))


def _raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with raw bytes: some with binary prefixes, BOM, NUL or a stray last byte, or both."""
    kind = F.col("doc_id") % 8
    text = F.encode(F.col("content"), "UTF-8")

    def raw(value: bytes) -> Column:
        return F.lit(bytearray(value))

    content = (F.when(F.col("doc_id") % 16 == 10, F.concat(raw(b"\xef\xbb\xbf"), text, raw(b"\xff")))
               .when(kind == 1, F.concat(raw(b"\xef\xbb\xbf"), text))
               .when(kind == 2, F.concat(text, raw(b"\xff")))
               .when(kind == 3, F.concat(raw(b"PK\x03\x04"), text))
               .when(kind == 4, F.concat(raw(b"%PDF-1.4"), text))
               .when(kind == 5, F.concat(text, raw(b"\x00")))
               .when(kind == 6, F.encode(F.regexp_replace("content", "\n", "\r\n"), "UTF-8"))
               .otherwise(text))
    return _files(spark, sf_dir).withColumn("content", content)


# --------------------------------------------------------------- queries

def _rounded(results: DataFrame, digits: int = 6) -> DataFrame:
    return results.withColumn("score", F.round("score", digits))


_SEARCHES: dict[str, Callable[[Corpus], DataFrame]] = {
    "term": lambda c: _rounded(se.search_terms(c, ["tion"])),
    "all_terms": lambda c: _rounded(se.search_terms(c, ["tion", "with", "an"])),
    "any_terms": lambda c: _rounded(se.search_terms(c, ["tion", "leaux", "sch"], mode="any")),
    "not": lambda c: _rounded(se.search_terms(c, ["tion", "an"], exclude=["with"])),
    "clipped_idf": lambda c: _rounded(se.search_terms(c, ["the"], k=25), 12),
    "phrase": lambda c: _rounded(se.search_phrase(c, "of the", k=50)),
    "initial_token": lambda c: _rounded(se.search_first(c, "the", k=50)),
    "prefix": lambda c: _rounded(se.search_prefix(c, "thr", k=50)),
    "near": lambda c: _rounded(se.search_near(c, ["with", "tion"], n=3, k=50)),
    "typed_or": lambda c: _rounded(se.search(c, '"of the" OR "leaux"', k=30)),
    "typed_not": lambda c: _rounded(se.search(c, '"tion" NOT "the"', k=30)),
    "typed_words": lambda c: _rounded(se.search(c, "^the of", k=30)),
    "no_limit": lambda c: _rounded(se.search_terms(c, ["tion"], k=-1)),
}


def _search(kind: str, corpus: Callable, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _SEARCHES[kind](corpus(spark, sf_dir))


def q_batch(corpus: Callable, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search_batch(corpus(spark, sf_dir), _word_queries(spark, sf_dir), k=5))


def q_batch_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR, NOT and phrase queries in one table."""
    a = F.get(F.split("query", " "), F.lit(0))
    b = F.get(F.split("query", " "), F.lit(1))
    kind = F.col("query_id") % 3
    typed = _word_queries(spark, sf_dir).withColumn(
        "query", F.when(kind == 0, F.concat(F.lit('"'), a, F.lit('" OR "'), b, F.lit('"')))
        .when(kind == 1, F.concat(F.lit('"'), a, F.lit('" NOT "'), b, F.lit('"')))
        .otherwise(F.concat(F.lit('"'), a, F.lit(" "), b, F.lit('"'))))
    return _rounded(search_batch(_stored(spark, sf_dir), typed, k=5))


def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.token_table(_table(spark, sf_dir, "documents"), stem=False)


def q_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = po.build_postings(_table(spark, sf_dir, "documents"), stem=False)
    return found.withColumn("positions", F.array_join("positions", ","))


def q_index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _index(spark, sf_dir).postings().select("term", "doc_id", "tf", "doc_len", "positions")
    return found.withColumn("positions", F.array_join("positions", ","))


def q_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.term_stats(_table(spark, sf_dir, "documents"), stem=False)


def q_stemmed_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.stemmed_vocabulary(_table(spark, sf_dir, "documents"))


def q_doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.doc_lengths(_table(spark, sf_dir, "documents"))


def q_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.corpus_stats(po.doc_lengths(_table(spark, sf_dir, "documents")))


def q_search_stemmed(corpus: Callable, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(se.search(corpus(spark, sf_dir, True), "tions withs", k=20))


def q_snippet_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _stored(spark, sf_dir, True)
    docs = _table(spark, sf_dir, "documents")
    best = se.search(corpus, "tion with", k=20)
    return _rounded(snippets_for_query(corpus, best, docs, "tion with"))


def q_search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search of a stored index shows: path, snippet, score, last_modified."""
    return _rounded(search_results(_index(spark, sf_dir, True), "tion with", k=20))


def q_stored_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a stored index; its size in bytes depends on the writer, so only its sign is shown."""
    return _index(spark, sf_dir, True).stats().select(
        "indexed_files", "last_scan", "total_documents", "errors_encountered",
        (F.col("index_size_mb") > 0).alias("has_size"))


def q_batch_snippets(spark:SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries_ = _stored(spark, sf_dir, True), _word_queries(spark, sf_dir)
    best = search_batch(corpus, queries_, k=3)
    return _rounded(with_batch_snippets(corpus, best, queries_, _table(spark, sf_dir, "documents")))


def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text a user sees for a search: rank, path, score, snippet."""
    docs = _files(spark, sf_dir).select(
        "doc_id", "path", F.col("mtime").cast("long").cast("string").alias("last_modified"))
    best = se.with_rank(se.search_terms(_stored(spark, sf_dir), ["tion"], k=5))
    rows = best.join(docs, "doc_id").withColumn("snippet", F.lit("-"))
    return se.format_results(rows, "tion")


def q_classify_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify_queries(_typed_queries(spark, sf_dir))
    units = F.transform("items", lambda x: F.concat(
        F.when(x["first"], "^").otherwise(""), F.when(x["required"], "").otherwise("-"),
        F.array_join(x["terms"], " ")))
    return found.select("doc_id", "query", "mode", F.array_join(units, "|").alias("units"))


def q_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = _table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    paths = _files(spark, sf_dir).select("path").unionByName(urls)
    return paths.select("path", ft.extension("path").alias("ext"))


def q_scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filter_files(_files(spark, sf_dir).drop("content"), include=(".txt", ".md", ".log"),
                        exclude=(".md",), max_mb=0.004, index_dir="/corpus/src1")
    return kept.select("path", "ext", "size", "mtime")


def q_is_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = ft.extension("path")
    return _raw_files(spark, sf_dir).select(
        "path", ft.is_text(ext).alias("by_name"), ft.is_text(ext, "content").alias("by_content"))


def q_detect_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_files(spark, sf_dir).select("path", ft.detect_encoding("content").alias("encoding"))


def q_read_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_text(_raw_files(spark, sf_dir)).select(
        "path", "status", "encoding", F.length("content").alias("n_chars"),
        F.when(F.col("encoding") != "latin-1", F.md5("content")).alias("digest"),
        "error", "last_modified")


def q_path_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(
        F.col("url").alias("path"), F.col("html").alias("content"),
        F.col("page_id").cast("string").alias("last_modified"))
    return search_by_path(pages, "HTTPS://%/e_/%", k=40)


def q_path_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_by_path(_stored_documents(spark, sf_dir), "/corpus/SRC1_/%.md", k=-1)


def q_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = _files(spark, sf_dir).select("path", "size", "mtime")
    return ch.changed_files(current, _snapshot(spark, sf_dir))


def q_deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.deleted_files(_files(spark, sf_dir), _snapshot(spark, sf_dir))


def q_moved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of which some stood elsewhere before; one with copies is not known to have moved."""
    now = _files(spark, sf_dir).select("path", "doc_id", F.md5(F.coalesce("content", F.lit(""))).alias("digest"))
    before = now.withColumn("path", F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("/old"), "path"))
                            .otherwise(F.col("path")))
    return ch.moved_files(now.join(before.select("path"), "path", "left_anti"),
                          before.join(now.select("path"), "path", "left_anti"))


def q_classify_changes(force: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.classify_changes(_files(spark, sf_dir), _snapshot(spark, sf_dir), force)


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = materialize(read_text(_raw_files(spark, sf_dir)).select("path", "status"), "read")
    return q_classify_changes(False, spark, sf_dir).join(status, "path", "left")


def q_refresh_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.refresh_summary(_outcomes(spark, sf_dir))


def q_refresh_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.refresh_errors(_outcomes(spark, sf_dir))


def q_latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("path"), F.col("role").alias("op"),
        F.col("text").alias("content"), F.col("turn").cast("double").alias("mtime"))
    return ch.latest_versions(feed)


def _refreshed(spark: SparkSession, sf_dir: str) -> Index:
    """An index of the even documents, then a change of every kind."""
    location = new_path(spark, "index")
    files = _files(spark, sf_dir)
    build_index(files.where("doc_id % 2 = 0"), location, text_col="content", path_col="path",
                stem=False, doc_buckets=8, term_buckets=4, run_time=1000.0)
    kind = F.col("doc_id") % 12
    status = (F.when(kind == 0, "deleted").when(kind == 2, "error").when(kind == 4, "skipped")
              .otherwise("ok"))
    changed = files.where(kind.isin(0, 2, 4, 6) | (F.col("doc_id") % 2 == 1))
    ok = F.col("status") == "ok"
    changes = changed.withColumn("status", status).select(
        "doc_id", "path", "status", "size", "mtime", F.lit("utf-8").alias("encoding"),
        F.when(ok, F.concat("content", F.lit(" Refreshed"))).alias("content"),
        F.when(F.col("status") == "error", "Failed to read file").alias("error"),
        F.when(ok, "later").alias("last_modified"))
    return apply_changes(spark, location, changes, 2000.0)


def q_apply_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir).files().select(
        "doc_id", "path", "last_indexed", "encoding", "error", F.md5("content").alias("digest"))


def q_apply_refresh_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings after the refresh, counted by term."""
    return _refreshed(spark, sf_dir).postings().groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("cf"), F.sum("doc_len").alias("lens"))


def q_index_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary after the refresh: sums of what each segment added and took away."""
    return _refreshed(spark, sf_dir).terms()


def q_stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a change feed, streamed into an index."""
    feed_dir, location, offsets = (new_path(spark, n) for n in ("feed", "index", "offsets"))
    last = F.col("turn") % 5 == 3
    rows = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("path"),
        F.when(last, "delete").otherwise("upsert").alias("op"),
        F.col("text").alias("content"), F.col("turn").cast("double").alias("mtime"))
    # Two micro-batches, each with turns that are older than some of the other.
    half = F.pmod(F.xxhash64("path", "mtime"), F.lit(2))
    for number in (0, 1):
        rows.where(half == number).write.mode("append").parquet(feed_dir)
        feed = spark.readStream.schema("path string, op string, content string, mtime double").parquet(
            feed_dir)
        stream_index(feed, location, offsets, stem=False, doc_buckets=4,
                     term_buckets=2).awaitTermination()
    index = open_index(spark, location)
    return index.documents().select("path", F.md5("content").alias("digest"), "last_modified")


def q_refresh_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory tree of the documents, scanned, decoded and indexed."""
    root = new_path(spark, "tree").removeprefix("file:")
    write_tree(_raw_files(spark, sf_dir), root)
    report = refresh(spark, root, new_path(spark, "index"),
                     include=(".txt", ".md", ".py", ".log", ".bin"), stem=False)
    return _below(report.index, root)


def _below(index: Index, root: str) -> DataFrame:
    return index.files().select(
        F.substring("path", len(root) + 1, 1000).alias("path"), "size", "encoding", "error",
        F.length("content").alias("n_chars"))


def q_refresh_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree's text files indexed, then one file that the list of extensions leaves out."""
    root, location = new_path(spark, "tree").removeprefix("file:"), new_path(spark, "index")
    write_tree(_raw_files(spark, sf_dir), root)
    refresh(spark, root, location, include=(".txt",), stem=False)
    one = (_files(spark, sf_dir).where(F.col("path").endswith(".md") & (F.col("doc_id") % 8 == 0))
           .agg(F.min_by("path", "doc_id")).first()[0])
    return _below(refresh_file(spark, root, location, one.lstrip("/")).index, root)


def q_indexed_files_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.indexed_files(_metadata(spark, sf_dir), _stored_documents(spark, sf_dir))


def q_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.index_stats(_stored_documents(spark, sf_dir), _metadata(spark, sf_dir), 3 << 19)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every callable takes (spark, sf_dir)."""
    searches = {f"q_bm25_{k}" if k in _BM25 else f"q_{k}_search": partial(_search, k, _scan)
                for k in _SEARCHES}
    stored = {f"q_index_{k}": partial(_search, k, _stored) for k in _SEARCHES}
    return {
        **searches, **stored,
        "q_batch_search": partial(q_batch, _stored),
        "q_batch_search_documents": partial(q_batch, _scan),
        "q_batch_typed": q_batch_typed,
        "q_tokens": q_tokens,
        "q_postings": q_postings,
        "q_index_postings": q_index_postings,
        "q_token_stats": q_token_stats,
        "q_stemmed_vocabulary": q_stemmed_vocabulary,
        "q_doc_lengths": q_doc_lengths,
        "q_corpus_stats": q_corpus_stats,
        "q_search_stemmed": partial(q_search_stemmed, _stored),
        "q_search_stemmed_documents": partial(q_search_stemmed, _scan),
        "q_snippet_topk": q_snippet_topk,
        "q_search_results": q_search_results,
        "q_stored_stats": q_stored_stats,
        "q_batch_snippets": q_batch_snippets,
        "q_report": q_report,
        "q_classify_queries": q_classify_queries,
        "q_extensions": q_extensions,
        "q_scan_filter": q_scan_filter,
        "q_is_text": q_is_text,
        "q_detect_encoding": q_detect_encoding,
        "q_read_text": q_read_text,
        "q_path_like": q_path_like,
        "q_path_snippet": q_path_snippet,
        "q_changed_files": q_changed_files,
        "q_deleted_files": q_deleted_files,
        "q_moved_files": q_moved_files,
        "q_classify_changes": partial(q_classify_changes, False),
        "q_force_refresh": partial(q_classify_changes, True),
        "q_refresh_summary": q_refresh_summary,
        "q_refresh_errors": q_refresh_errors,
        "q_latest_versions": q_latest_versions,
        "q_apply_refresh": q_apply_refresh,
        "q_apply_refresh_terms": q_apply_refresh_terms,
        "q_index_dictionary": q_index_dictionary,
        "q_stream_index": q_stream_index,
        "q_refresh_tree": q_refresh_tree,
        "q_refresh_file": q_refresh_file,
        "q_indexed_files_view": q_indexed_files_view,
        "q_indexed_ok": lambda s, d: st.indexed_ok(_metadata(s, d)),
        "q_with_errors": lambda s, d: st.with_errors(_metadata(s, d)),
        "q_needs_reindex": lambda s, d: st.needs_reindex(_metadata(s, d)),
        "q_document_count": lambda s, d: st.document_count(_stored_documents(s, d)),
        "q_index_stats": q_index_stats,
        **LLM_QUERIES,
    }


_BM25 = ("term", "all_terms", "any_terms", "not", "clipped_idf")


# ------------------------------------------------------------ SQL twins

def _toks(text: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({text})), '[\p{{L}}\p{{N}}]+')"


_DOCS = f"d as (select doc_id, {_toks('text')} as t from documents)"
_FILES = """files as (
    select doc_id, '/corpus/' || source || '/' || lang || '/' || cast(doc_id as varchar) || ext as path,
           ext, cast(octet_length(encode(text)) as bigint) as size,
           cast(1704067200 + doc_id * 60 as double) as mtime, text as content
    from (select *, case when doc_id % 10 < 5 then '.txt' when doc_id % 10 < 7 then '.md'
                         when doc_id % 10 = 7 then '.py' when doc_id % 10 = 8 then '.LOG'
                         else '.bin' end as ext from documents))"""
_PREV = f"""{_FILES}, prev as (
    select path, size + case when doc_id % 11 = 0 then 1 else 0 end as size,
           mtime - case when doc_id % 13 = 0 then 1 else 0 end as mtime
    from files where doc_id % 7 <> 0
    union all
    select '/corpus/pages/' || cast(page_id as varchar) || '.html', 0, 0.0 from pages)"""
_META = f"""{_FILES}, metadata as (
    select path, size, mtime, mtime + case when doc_id % 17 = 0 then -5 else 5 end as last_indexed,
           case when doc_id % 19 <> 0 then 'utf-8' end as encoding,
           case when doc_id % 19 = 0 then 'Failed to read file' end as error
    from files), stored as (
    select path, content, cast(cast(mtime as bigint) as varchar) as last_modified
    from files where doc_id % 19 <> 0)"""
_ISO = "strftime(make_timestamp(cast(mtime * 1000000 as bigint)), '%Y-%m-%dT%H:%M:%S')"


def _term(word: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{word}'))"


def _phrase(*words: str) -> str:
    same = " and ".join(f"t[i + {j}] = '{w}'" for j, w in enumerate(words))
    return f"len(list_filter(range(1, len(t) - {len(words) - 2}), lambda i: {same}))"


def _ranked(units: list[str], where: str, k: int | None = 10, digits: int = 6,
            excluded: list[str] = ()) -> str:
    """BM25 over the documents table; ``where`` speaks of f0, f1, ..., then e0, ..."""
    tf = [f"{u} as f{i}" for i, u in enumerate(units)]
    tf += [f"{u} as e{i}" for i, u in enumerate(excluded)]
    dfs = ", ".join(f"count(*) filter (f{i} > 0) as df{i}" for i in range(len(units)))
    idfs = ", ".join(
        f"case when df{i} < n / 2.0 then ln((n - df{i} + 0.5) / (df{i} + 0.5)) else 0.000001 end as w{i}"
        for i in range(len(units)))
    score = " + ".join(
        f"case when f{i} > 0 then w{i} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) else 0 end"
        for i in range(len(units)))
    limit = "" if k is None else f"order by raw desc, doc_id limit {k}"
    return f"""with {_DOCS}, s as (select doc_id, len(t) as dl, {', '.join(tf)} from d),
    g as (select count(*) as n, sum(dl) / count(*) as avgdl, {dfs} from s),
    w as (select *, {idfs} from g),
    r as (select doc_id, {score} as raw from s, w where {where})
    select doc_id, round(raw, {digits}) as score from (select * from r {limit})"""


_NEAR = f"""with {_DOCS}, p as (select doc_id, len(t) as dl,
        list_filter(range(1, len(t) + 1), lambda i: t[i] = 'with') as a,
        list_filter(range(1, len(t) + 1), lambda i: t[i] = 'tion') as b from d),
    s as (select doc_id, dl, len(a) as na, len(b) as nb,
        len(list_filter(a, lambda x: len(list_filter(b, lambda y: abs(x - y) <= 4)) > 0)) as f0,
        len(list_filter(b, lambda x: len(list_filter(a, lambda y: abs(x - y) <= 4)) > 0)) as f1 from p),
    g as (select count(*) as n, sum(dl) / count(*) as avgdl, count(*) filter (na > 0) as df0,
                 count(*) filter (nb > 0) as df1 from s),
    r as (select doc_id,
        greatest(ln((n - df0 + 0.5) / (df0 + 0.5)), 0.000001) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / avgdl))
        + greatest(ln((n - df1 + 0.5) / (df1 + 0.5)), 0.000001) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) as raw
        from s, g where f0 > 0 and f1 > 0)
    select doc_id, round(raw, 6) as score from (select * from r order by raw desc, doc_id limit 50)"""

_SEARCH_SQL = {
    "term": _ranked([_term("tion")], "f0 > 0"),
    "all_terms": _ranked([_term("tion"), _term("with"), _term("an")], "f0 > 0 and f1 > 0 and f2 > 0"),
    "any_terms": _ranked([_term("tion"), _term("leaux"), _term("sch")], "f0 + f1 + f2 > 0"),
    "not": _ranked([_term("tion"), _term("an")], "f0 > 0 and f1 > 0 and e0 = 0",
                   excluded=[_term("with")]),
    "clipped_idf": _ranked([_term("the")], "f0 > 0", 25, 12),
    "phrase": _ranked([_phrase("of", "the")], "f0 > 0", 50),
    "initial_token": _ranked(["case when t[1] = 'the' then 1 else 0 end"], "f0 > 0", 50),
    "prefix": _ranked(["len(list_filter(t, lambda x: starts_with(x, 'thr')))"], "f0 > 0", 50),
    "near": _NEAR,
    "typed_or": _ranked([_phrase("of", "the"), _term("leaux")], "f0 + f1 > 0", 30),
    "typed_not": _ranked([_term("tion")], "f0 > 0 and e0 = 0", 30, excluded=[_term("the")]),
    "typed_words": _ranked(["case when t[1] = 'the' then 1 else 0 end", _term("of")],
                           "f0 > 0 and f1 > 0", 30),
    "no_limit": _ranked([_term("tion")], "f0 > 0", None),
}

_WORD_QUERIES = r"""q as (select item_id as query_id,
        regexp_replace(array_to_string(string_split(text, ' ')[1:3], ' '), '[^\p{L}\p{N} ]', '', 'g') as query
        from benchmark)"""
_POSTINGS = f"""{_DOCS}, x as (select doc_id, len(t) as dl, unnest(t) as term from d),
    p as (select term, doc_id, dl, count(*) as tf from x group by all),
    df as (select term, count(*) as df from p group by term),
    g as (select count(*) as n, sum(len(t)) / count(*) as avgdl from d)"""
_BATCH = f"""with {_POSTINGS}, {_WORD_QUERIES},
    u as (select query_id, unnest({_toks('query')}) as term from q),
    need as (select query_id, count(*) as m from u group by query_id),
    h as (select query_id, doc_id, count(*) as m,
            sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as raw
          from u join p using (term) join df using (term), g group by query_id, doc_id),
    r as (select query_id, doc_id, raw, row_number() over (partition by query_id order by round(raw, 12) desc, doc_id) as rank
          from h join need using (query_id, m))
    select query_id, cast(rank as integer) as rank, doc_id, round(raw, 6) as score from r where rank <= 5"""
_BATCH_TYPED = f"""with {_POSTINGS}, {_WORD_QUERIES},
    ab as (select query_id, query_id % 3 as kind, {_toks("string_split(query, ' ')[1]")}[1] as a,
                  {_toks("string_split(query, ' ')[2]")}[1] as b from q),
    two as (select query_id, doc_id, tf, dl, 1 as part, a as unit from ab join p on a = term where kind < 2
            union all
            select query_id, doc_id, tf, dl, 2, b from ab join p on b = term where kind = 0),
    pairs as (select doc_id, len(t) as dl, unnest(t[:-2]) as a, unnest(t[2:]) as b from d),
    phrase as (select a, b, doc_id, dl, count(*) as tf from pairs group by all),
    pdf as (select a, b, count(*) as df from phrase group by all),
    hits as (
        select query_id, doc_id, tf, dl, part, df from two join df on df.term = two.unit
        where not exists (select 1 from ab join p on p.term = ab.b where ab.kind = 1
                          and ab.query_id = two.query_id and p.doc_id = two.doc_id)
        union all
        select query_id, doc_id, tf, dl, 1, df from ab join phrase using (a, b) join pdf using (a, b)
        where kind = 2),
    h as (select query_id, doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2
                 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as raw from hits, g group by query_id, doc_id),
    r as (select *, row_number() over (partition by query_id order by round(raw, 12) desc, doc_id) as rank from h)
    select query_id, cast(rank as integer) as rank, doc_id, round(raw, 6) as score from r where rank <= 5"""

_POSITIONS = f"""with {_DOCS}, x as (select doc_id, len(t) as doc_len, unnest(t) as term,
        unnest(range(0, len(t))) as pos from d)
    select term, doc_id, count(*) as tf, doc_len, string_agg(cast(pos as varchar), ',' order by pos) as positions
    from x group by term, doc_id, doc_len"""

_TYPED = r"""w as (select doc_id, doc_id % 22 as kind, regexp_extract_all(text, '[\p{L}\p{N}]+') as t from documents),
    ab as (select doc_id, kind, coalesce(t[1], 'x') as a, coalesce(t[2], 'y') as b from w)"""
_FOLD_A, _FOLD_B = "strip_accents(lower(a))", "strip_accents(lower(b))"
_CLASSIFY = f"""with {_TYPED}, f as (select *, {_FOLD_A} as x, {_FOLD_B} as y,
        (a || b) similar to '.*(AND|OR|NOT).*' or a similar to '.*(AND|OR|NOT).*' as shout from ab)
    select doc_id,
      case kind when 0 then a || ' ' || b when 1 then '"' || a || ' ' || b || '"'
        when 2 then a || ' AND ' || b when 3 then a || '*' when 4 then a || '''s'
        when 5 then '"' || a || '" OR "' || b || '"' when 6 then '"' || a || '" AND "' || b || '"'
        when 7 then '"' || a || '" NOT "' || b || '"' when 8 then '"' || a || '" "' || b || '"'
        when 9 then a || '++' when 10 then a || ',' || b when 11 then a || '?' when 12 then '"'
        when 13 then a || '_' || b when 14 then '^' || a when 15 then a || ' + ' || b
        when 16 then '   ' when 18 then '"---"' when 19 then a || '@' || b || '.c'
        when 20 then a || ' near ' || b when 21 then 'and ' || a || ' + ' end as query,
      case when kind in (9, 10, 11, 21) then case when a similar to '.*(AND|OR|NOT).*'
             or (kind = 10 and b similar to '.*(AND|OR|NOT).*') then 'all' else 'invalid' end
        when kind = 12 then 'invalid' when kind in (16, 17, 18) then 'empty'
        when kind = 5 then 'any' when kind = 7 then 'not' else 'all' end as mode,
      case when kind in (0, 6, 8) then case when kind = 0 and (a || ' ' || b) similar to '.*(AND|OR|NOT).*'
             then x || ' ' || y else x || '|' || y end
        when kind in (1, 13, 15) then x || ' ' || y when kind = 2 then x || ' and ' || y
        when kind = 3 then x when kind = 4 then x || ' s' when kind = 5 then x || '|' || y
        when kind = 7 then x || '|-' || y
        when kind in (9, 11) and a similar to '.*(AND|OR|NOT).*' then x
        when kind = 10 and (a || ',' || b) similar to '.*(AND|OR|NOT).*' then x || ' ' || y
        when kind = 14 then case when a similar to '.*(AND|OR|NOT).*' then x else '^' || x end
        when kind = 19 then x || ' ' || y || ' c'
        when kind = 20 then case when (a || ' ' || b) similar to '.*(AND|OR|NOT).*'
             then x || ' near ' || y else x || '|near|' || y end
        when kind = 21 and a similar to '.*(AND|OR|NOT).*' then 'and ' || x
        else '' end as units
    from f"""

_RAW = f"""{_FILES}, raw as (
    select *, doc_id % 8 as kind, lower(ext) in ('.txt', '.md', '.py', '.log') as named,
           case doc_id % 8 when 1 then size + 3 when 2 then size + case when doc_id % 16 = 10 then 4 else 1 end when 3 then size + 4
             when 4 then size + 8 when 5 then size + 1
             when 6 then size + length(content) - length(replace(content, chr(10), '')) else size end as bytes
    from files), typed as (
    select *, named and kind not in (3, 4, 5) as is_text,
           case when kind = 1 or doc_id % 16 = 10 then 'utf-8-sig' when kind = 2 then 'latin-1'
                else 'utf-8' end as encoding from raw), outcome as (
    select *, case when not is_text then 'skipped' when doc_id % 16 = 10 then 'error'
                   else 'ok' end as status from typed)"""
_READ = """select path, bytes as size,
    case when status = 'ok' then encoding end as encoding,
    case when status = 'error' then 'Failed to read file: not valid utf-8-sig' end as error,
    case when status <> 'ok' then null when encoding = 'latin-1' then bytes
         when kind = 5 then length(content) + 1 else length(content) end as n_chars
    from outcome"""
_OUTCOMES = f"""{_RAW}, {_PREV.split(', prev as')[1].join(['prev as', ''])}, acts as (
    select coalesce(f.path, p.path) as path, status,
           case when p.path is null then 'added' when f.path is null then 'removed'
                when f.size = p.size and f.mtime = p.mtime then 'unchanged' else 'updated' end as action
    from outcome f full outer join prev p on f.path = p.path)"""

def _shape(word: str) -> str:
    """Vowels as v and all else as c; y is a vowel after a consonant."""
    marked = f"regexp_replace({word}, '(^|[aeiou])y', '\\1Y', 'g')"
    return f"regexp_replace(regexp_replace({marked}, '[^aeiouy]', 'c', 'g'), '[aeiouy]', 'v', 'g')"


def _short_end(stem: str) -> str:
    return f"(regexp_matches({_shape(stem)}, 'cvc$') and regexp_matches({stem}, '[^wxy]$'))"


def _split(step: str, source: str, suffixes) -> str:
    """A step's words cut into stem s and longest suffix e that leaves a character."""
    pattern = f"'^(.+?)({'|'.join(suffixes)})$'"
    return (f"{step} as (select term, w, regexp_extract(w, {pattern}, 1) as s, "
            f"regexp_extract(w, {pattern}, 2) as e from {source})")


def _cases(rules: dict[str, str]) -> str:
    return "case e " + " ".join(f"when '{a}' then '{b}'" for a, b in rules.items()) + " end"


def _porter_sql(terms: str) -> str:
    """CTEs that end in stems(term, stem) for the rows of ``terms(term)``."""
    m0, m1 = f"regexp_matches({_shape('s')}, 'vc')", f"regexp_matches({_shape('s')}, 'vc.*vc')"
    vowel = f"contains({_shape('s')}, 'v')"
    return f"""{terms}, a0 as materialized (select term, term as w from terms
        where octet_length(encode(term)) between 3 and 64),
    a as materialized (select term, case when w like '_%sses' or w like '_%ies' then w[:-3] when w like '_%ss' then w
        when w like '_%s' then w[:-2] else w end as w from a0),
    {_split('b0', 'a', ('eed', 'ed', 'ing'))},
    b as materialized (select term, case when e = 'eed' then case when {m0} then s || 'ee' else w end
        when e <> '' and {vowel} then
          case when regexp_matches(s, '.(at|bl|iz)$') then s || 'e'
               when len(s) > 1 and s[-1] = s[-2] and regexp_matches(s, '[^aeioulsz]$') then s[:-2]
               when {m0} and not {m1} and {_short_end('s')} then s || 'e' else s end
        else w end as w from b0),
    c as materialized (select term, case when w like '%y' and contains({_shape('w[:-2]')}, 'v')
        then w[:-2] || 'i' else w end as w from b),
    {_split('d0', 'c', STEP2)},
    dd as materialized (select term, case when e <> '' and {m0} then s || {_cases(STEP2)} else w end as w from d0),
    {_split('e0', 'dd', STEP3)},
    f as materialized (select term, case when e <> '' and {m0} then s || {_cases(STEP3)} else w end as w from e0),
    {_split('g0', 'f', STEP4)},
    g as materialized (select term, case when e <> '' and {m1} and (e <> 'ion' or regexp_matches(s, '[st]$'))
        then s else w end as w from g0),
    h0 as materialized (select term, w, w[:-2] as s from g),
    h as materialized (select term, case when w like '%e' and ({m1} or ({m0} and not {_short_end('s')}))
        then s else w end as w from h0),
    i0 as materialized (select term, w, w[:-2] as s from h),
    stemmed as materialized (select term, case when w like '%ll' and {m1} then s else w end as stem from i0),
    stems as (select term, coalesce(stem, term) as stem from terms left join stemmed using (term))"""


_VOCABULARY = f"""{_DOCS}, terms as (select distinct unnest(t) as term from d)"""
_SEARCH_STEMMED = f"""with {_porter_sql(_VOCABULARY)},
    x as (select doc_id, unnest(t) as term from d),
    y as (select doc_id, stem, count(*) as tf from x join stems using (term) group by all),
    z as (select doc_id, len(t) as dl,
        coalesce((select tf from y where y.doc_id = d.doc_id and stem = 'tion'), 0) as f0,
        coalesce((select tf from y where y.doc_id = d.doc_id and stem = 'with'), 0) as f1 from d),
    figures as (select count(*) as n, sum(dl) / count(*) as avgdl, count(*) filter (f0 > 0) as df0,
                 count(*) filter (f1 > 0) as df1 from z),
    r as (select doc_id,
        greatest(ln((n - df0 + 0.5) / (df0 + 0.5)), 0.000001) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / avgdl))
        + greatest(ln((n - df1 + 0.5) / (df1 + 0.5)), 0.000001) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) as raw
        from z, figures where f0 > 0 and f1 > 0)
    select doc_id, round(raw, 6) as score from (select * from r order by raw desc, doc_id limit 20)"""

# The cut of each row of tx(doc_id, toks, gaps) around its wanted(doc_id, item, stem).
_SHOWN = r"""tk as (select doc_id, len(toks) as n, gaps, unnest(toks) as tok, unnest(range(0, len(toks))) as pos from tx),
    hits as (select doc_id, n, pos, item from tk join stems on strip_accents(lower(tok)) = term
             join wanted using (doc_id, stem)),
    sent as (select doc_id, pos from tk where pos = 0 or regexp_matches(gaps[pos + 1], '[.:][ \t\n\r]+$')),
    cand as (select doc_id, n, pos as seq, 0 as sub, pos as p, 0 as bonus from hits
             union all
             select doc_id, n, seq, 1, p, case when p = 0 then 120 else 100 end from (
                 select h.doc_id, h.n, h.pos as seq, max(s.pos) as p from hits h join sent s
                 on s.doc_id = h.doc_id and s.pos <= h.pos where h.n > 32 group by all) where p < seq),
    weighed as (select c.doc_id, c.n, seq, sub, p, bonus + 999 * count(distinct h.item) + count(*) as weight,
                       min(h.pos) as head, max(h.pos) + 1 as tail
                from cand c join hits h on h.doc_id = c.doc_id and h.pos between c.p and c.p + 31 group by c.doc_id, c.n, seq, sub, p, bonus),
    chosen as (select doc_id, case when sub = 1 then p else
                   greatest(least(head - trunc((32 - (tail - head)) / 2.0), n - 32), 0) end as st
               from weighed qualify row_number() over (partition by doc_id order by weight desc, seq, sub) = 1),
    shown as (select tk.doc_id, string_agg(case when pos > st then gaps[pos + 1] else '' end
                  || case when exists (select 1 from hits h where h.doc_id = tk.doc_id and h.pos = tk.pos)
                     then '<mark>' || tok || '</mark>' else tok end, '' order by pos) as body,
                  any_value(case when st > 0 then '...' else gaps[1] end) as head,
                  any_value(case when st + 31 >= n - 1 then gaps[n + 1] else '...' end) as tail
              from tk join chosen using (doc_id) where pos between st and st + 31 group by tk.doc_id)"""
_SPLIT_TEXT = r"""regexp_extract_all(text, '[\p{L}\p{N}]+') as toks, string_split_regex(text, '[\p{L}\p{N}]+') as gaps"""
_SNIPPETS = f"""{_SEARCH_STEMMED.replace('select doc_id, round(raw, 6)', ', best as (select doc_id, round(raw, 6)')}),
    tx as (select doc_id, score, {_SPLIT_TEXT} from best join documents using (doc_id)),
    wanted as (select doc_id, stem as item, stem from best, (values ('tion'), ('with')) as v(stem)),
    {_SHOWN}
    select doc_id, score, head || body || tail as snippet from tx join shown using (doc_id)"""
# A result row of a query is named by both ids where the cut needs one name.
_ALL_WORDS = f"""{_DOCS}, {_WORD_QUERIES}, terms as (
    select unnest(t) as term from d union select unnest({_toks('query')}) from q)"""
_BATCH_SNIPPETS = f"""with {_porter_sql(_ALL_WORDS)},
    asked as (select query_id, unnest(t) as term, unnest(range(0, len(t))) as item
          from (select query_id, {_toks('query')} as t from q)),
    need as (select query_id, count(*) as m from asked group by query_id),
    units as (select query_id, item, stem from asked join stems using (term)),
    x as (select doc_id, len(t) as dl, unnest(t) as term from d),
    found as (select doc_id, stem, dl, count(*) as tf from x join stems using (term)
          where stem in (select stem from units) group by all),
    dfs as (select stem, count(*) as df from found group by stem),
    totals as (select count(*) as n, sum(len(t)) / count(*) as avgdl from d),
    scored as (select query_id, doc_id, count(*) as m,
            sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as raw
          from units join found using (stem) join dfs using (stem), totals group by query_id, doc_id),
    placed as (select query_id, doc_id as doc, raw, query_id || ':' || doc_id as doc_id,
            row_number() over (partition by query_id order by round(raw, 12) desc, doc) as rank
          from scored join need using (query_id, m)),
    best as (select *, round(raw, 6) as score from placed where rank <= 3),
    tx as (select best.*, {_SPLIT_TEXT} from best join documents on documents.doc_id = best.doc),
    wanted as (select doc_id, item, stem from best join units using (query_id)),
    {_SHOWN}
    select query_id, cast(rank as integer) as rank, doc as doc_id, score, head || body || tail as snippet
    from tx join shown using (doc_id)"""

_CHANGED_DOCS = f"""{_FILES}, k as (select *, doc_id % 12 as kind, doc_id % 2 = 1 as odd from files)
    , stored as (
    select doc_id, path, case when odd or kind = 6 then content || ' Refreshed' else content end as content,
           case when odd or kind in (2, 6) then 2000.0 else 1000.0 end as last_indexed,
           case when not odd and kind = 2 then 'Failed to read file' end as error
    from k where odd or kind <> 0)"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for every query that SQL can express."""
    sql = {(f"q_bm25_{k}" if k in _BM25 else f"q_{k}_search"): s for k, s in _SEARCH_SQL.items()}
    sql |= {f"q_index_{k}": s for k, s in _SEARCH_SQL.items()}
    sql |= {
        "q_batch_search": _BATCH,
        "q_batch_search_documents": _BATCH,
        "q_batch_typed": _BATCH_TYPED,
        "q_tokens": f"""with {_DOCS} select doc_id, cast(unnest(range(0, len(t))) as integer) as pos,
            unnest(t) as term from d""",
        "q_postings": _POSITIONS,
        "q_index_postings": _POSITIONS,
        "q_token_stats": f"""with {_DOCS}, x as (select doc_id, unnest(t) as term from d)
            select term, count(distinct doc_id) as df, count(*) as cf from x group by term""",
        "q_stemmed_vocabulary": f"with {_porter_sql(_VOCABULARY)} select term, stem from stems",
        "q_search_stemmed": _SEARCH_STEMMED,
        "q_search_stemmed_documents": _SEARCH_STEMMED,
        "q_snippet_topk": _SNIPPETS,
        "q_batch_snippets": _BATCH_SNIPPETS,
        "q_search_results": f"""select cast(doc_id as varchar) as path, snippet, score,
            '1970-01-01T00:00:00' as last_modified from ({_SNIPPETS})""",
        "q_stored_stats": """select count(*) as indexed_files, '1970-01-01T00:00:00' as last_scan,
            count(*) as total_documents, 0 as errors_encountered, true as has_size from documents""",
        "q_doc_lengths": f"with {_DOCS} select doc_id, cast(len(t) as integer) as doc_len from d",
        "q_corpus_stats": f"""with {_DOCS} select count(*) as n_docs,
            cast(sum(len(t)) as bigint) as total_len from d""",
        "q_report": f"""with {_FILES}, best as ({_ranked([_term("tion")], "f0 > 0", 5, 9)}),
            r as (select *, row_number() over (order by score desc, doc_id) as rank
                  from best join files using (doc_id))
            select 'Found ' || count(*) || ' results for ''tion'':' || chr(10) || chr(10)
              || string_agg(rank || '. ' || path || chr(10) || '   Score: ' || printf('%.2f', score)
                 || chr(10) || '   Modified: ' || cast(mtime as bigint) || chr(10)
                 || '   Snippet: -' || chr(10) || chr(10), '' order by rank) as report from r""",
        "q_classify_queries": _CLASSIFY,
        "q_extensions": rf"""with {_FILES}, x as (select path from files union all select url from pages)
            select path, lower(regexp_extract(string_split(path, '/')[-1], '^.+(\.[^.]+)$', 1)) as ext from x""",
        "q_scan_filter": f"""with {_FILES} select path, lower(ext) as ext, size, mtime from files
            where lower(ext) in ('.txt', '.log') and size <= 4194 and not starts_with(path, '/corpus/src1/')""",
        "q_is_text": f"with {_RAW} select path, named as by_name, is_text as by_content from typed",
        "q_detect_encoding": f"with {_RAW} select path, encoding from typed",
        "q_read_text": f"""with {_RAW} select path, status,
            case when status = 'ok' then encoding end as encoding,
            case when status <> 'ok' then null when encoding = 'latin-1' then bytes
                 when kind = 5 then length(content) + 1 else length(content) end as n_chars,
            case when status = 'ok' and encoding <> 'latin-1'
                 then md5(replace(content, chr(13), chr(10)) || case when kind = 5 then chr(0) else '' end)
                 end as digest,
            case when status = 'error' then 'Failed to read file: not valid utf-8-sig' end as error,
            case when status = 'ok' then {_ISO} end as last_modified from outcome""",
        "q_path_like": """select url as path, left(html, 200) || case when length(left(html, 200)) = 200
            then '...' else '' end as snippet, 0.0::double as score, cast(page_id as varchar) as last_modified
            from pages where lower(url) like 'https://%/e_/%' order by url limit 40""",
        "q_path_snippet": f"""with {_META} select path, left(content, 200) || case
            when length(left(content, 200)) = 200 then '...' else '' end as snippet,
            0.0::double as score, last_modified from stored where path like '/corpus/src1_/%.md'""",
        "q_changed_files": f"""with {_PREV} select f.path, f.size, f.mtime from files f
            left join prev p using (path)
            where p.path is null or p.size <> f.size or p.mtime <> f.mtime""",
        "q_deleted_files": f"with {_PREV} select path from prev except select path from files",
        "q_moved_files": f"""with {_FILES}, m as (
            select md5(coalesce(content, '')) as digest, path from files where doc_id % 17 = 0)
            select min(path) as path, '/old' || min(path) as moved_from from m group by digest having count(*) = 1""",
        "q_classify_changes": f"""with {_PREV} select coalesce(f.path, p.path) as path,
            case when p.path is null then 'added' when f.path is null then 'removed'
                 when f.size = p.size and f.mtime = p.mtime then 'unchanged' else 'updated' end as action
            from files f full outer join prev p on f.path = p.path""",
        "q_force_refresh": f"""with {_PREV} select coalesce(f.path, p.path) as path,
            case when p.path is null then 'added' when f.path is null then 'removed' else 'updated' end as action
            from files f full outer join prev p on f.path = p.path""",
        "q_refresh_summary": f"""with {_OUTCOMES} select
            count(*) filter (action in ('added', 'updated') and status <> 'ok') = 0 as success,
            count(*) filter (action in ('added', 'updated') and status = 'ok') as files_processed,
            count(*) filter (action = 'added' and status = 'ok') as files_added,
            count(*) filter (action = 'updated' and status = 'ok') as files_updated,
            count(*) filter (action = 'removed') as files_removed,
            count(*) filter (action in ('added', 'updated') and status <> 'ok') as errors,
            0.0::double as duration_seconds from acts""",
        "q_refresh_errors": f"""with {_OUTCOMES} select path, 'Failed to index ' || path as message
            from acts where action in ('added', 'updated') and status <> 'ok'""",
        "q_latest_versions": """select cast(conv_id as varchar) as path, role as op, text as content,
            cast(turn as double) as mtime from conversations
            qualify row_number() over (partition by conv_id order by turn desc, role) = 1""",
        "q_apply_refresh": f"""with {_CHANGED_DOCS} select doc_id, path, last_indexed,
            case when error is null then 'utf-8' end as encoding, error, md5(content) as digest from stored""",
        "q_apply_refresh_terms": f"""with {_CHANGED_DOCS}, d as (
            select doc_id, {_toks('content')} as t from stored),
            x as (select doc_id, len(t) as dl, unnest(t) as term from d),
            p as (select term, doc_id, dl, count(*) as tf from x group by all)
            select term, count(*) as df, cast(sum(tf) as bigint) as cf, cast(sum(dl) as bigint) as lens
            from p group by term""",
        "q_index_dictionary": f"""with {_CHANGED_DOCS}, d as (
            select doc_id, {_toks('content')} as t from stored),
            x as (select doc_id, unnest(t) as term from d)
            select term, count(distinct doc_id) as df, count(*) as cf from x group by term""",
        "q_stream_index": """with last as (select * from conversations
            qualify row_number() over (partition by conv_id order by turn desc, turn % 5 = 3 desc) = 1)
            select cast(conv_id as varchar) as path, md5(text) as digest,
            strftime(make_timestamp(turn * 1000000), '%Y-%m-%dT%H:%M:%S') as last_modified
            from last where turn % 5 <> 3""",
        "q_refresh_tree": f"""with {_RAW} {_READ}
            where status <> 'skipped'""",
        "q_refresh_file": f"""with {_RAW} {_READ}
            where lower(ext) = '.txt' and status <> 'skipped' or doc_id = (
                select min(doc_id) from outcome where ext = '.md' and kind = 0)""",
        "q_indexed_files_view": f"""with {_META} select m.*, s.last_modified from metadata m
            left join stored s using (path)""",
        "q_indexed_ok": f"with {_META} select path, size, encoding from metadata where error is null",
        "q_with_errors": f"with {_META} select path, error from metadata where error is not null",
        "q_needs_reindex": f"with {_META} select path from metadata where mtime > last_indexed",
        "q_document_count": f"with {_META} select count(*) as n_documents from stored",
        "q_index_stats": f"""with {_META} select (select count(*) from stored) as indexed_files,
            (select strftime(make_timestamp(cast(max(last_indexed) * 1000000 as bigint)), '%Y-%m-%dT%H:%M:%S')
             from metadata) as last_scan, 1.5::double as index_size_mb,
            (select count(*) from stored) as total_documents, count(error) as errors_encountered from metadata""",
    }
    return sql | LLM_SQL

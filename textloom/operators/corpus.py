"""What a search runs on: a table of documents, or its postings.

Both give the same thing to the search operators: for a few units (words,
phrases, prefixes) a frame ``doc_id, doc_len, tf_0, tf_1, ...`` of the documents
which hold at least one of them, with the corpus figures that BM25 needs.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bm25
from ..plans.workdir import materialize
from . import postings as ops
from .classify import Unit

# Bytes one document id takes in a broadcast relation, counted generously.
_BYTES_PER_ID = 64
MOST_TERMS = 64        # terms of a prefix that are looked up one by one; more lie in all buckets
MOST_BLOCKS = 256      # blocks that are named in a filter
FEW_ROWS = 1 << 20     # postings that are read as they are, as bounds take further jobs


@dataclass(frozen=True)
class Hits:
    """Documents with at least one unit, and the figures to score them."""

    frame: DataFrame
    n_docs: int
    total_len: int
    dfs: tuple[int, ...]

    @property
    def avg_len(self) -> float:
        return self.total_len / self.n_docs if self.n_docs and self.total_len else 1.0


def tf_name(i: int) -> str:
    return f"tf_{i}"


def pos_name(i: int) -> str:
    return f"pos_{i}"


def _joined(conditions: list[Column], join) -> Column:
    """In halves, so that many conditions make no deep expression."""
    if len(conditions) == 1:
        return conditions[0]
    middle = len(conditions) // 2
    return join(_joined(conditions[:middle], join), _joined(conditions[middle:], join))


def any_of(conditions: list[Column]) -> Column:
    return _joined(conditions, lambda a, b: a | b)


def all_of(conditions: list[Column]) -> Column:
    return _joined(conditions, lambda a, b: a & b)


class Corpus(ABC):
    spark: SparkSession
    stem: bool

    @abstractmethod
    def hits(self, units: list[Unit], required: list[Unit] = ()) -> Hits:
        """``required`` units must all be present; it only serves to save work."""

    def best_of_any(self, units: list[Unit], k: int) -> Hits | None:
        """``hits`` reduced to documents that can be among the best k; None if it can't tell."""
        return None

    @abstractmethod
    def places(self, words: list[str]) -> Hits:
        """Documents that hold all words, with their positions ``pos_0, pos_1, ...``."""

    @abstractmethod
    def postings(self) -> DataFrame:
        """Postings of all terms."""

    def postings_of(self, words: DataFrame) -> DataFrame:
        """Postings joined with rows that have a ``term``."""
        return self.postings().join(words, "term")

    @abstractmethod
    def totals(self) -> tuple[int, int]:
        """Number of documents, number of tokens."""


class DocumentCorpus(Corpus):
    """Searches documents directly: each search reads and tokenises them once."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 stem: bool = True):
        self.spark = docs.sparkSession
        self.docs, self.id_col, self.text_col, self.stem = docs, id_col, text_col, stem
        self._totals = None

    def totals(self):
        if self._totals is None:
            row = ops.corpus_stats(ops.doc_lengths(self.docs, self.id_col, self.text_col)).first()
            self._totals = (row["n_docs"], row["total_len"])
        return self._totals

    def postings(self):
        return ops.build_postings(self.docs, self.id_col, self.text_col, self.stem)

    def _tokens(self) -> DataFrame:
        return ops.with_tokens(self.docs, self.text_col, self.stem, (self.id_col,))

    def _kept(self, rows: DataFrame, found: list[Column], present: list[Column]):
        """One narrow row per document, and the figures of the corpus.

        It is stored, so that text is tokenised once although the scores need
        the whole corpus first.
        """
        narrow = materialize(rows.select(F.col(self.id_col).alias("doc_id"),
                                         F.size("tokens").alias("doc_len"), *found), "hits")
        row = narrow.agg(
            F.count("*").alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len"),
            *[F.count_if(p).alias(f"df_{i}") for i, p in enumerate(present)]).first()
        self._totals = (row["n_docs"], row["total_len"])
        return narrow, tuple(row[f"df_{i}"] for i in range(len(present)))

    def places(self, words):
        tokens = F.col("tokens")
        found = [F.when(F.array_contains(tokens, w), F.filter(
            F.sequence(F.lit(0), F.size(tokens) - 1), _is_word_at(tokens, w))).alias(pos_name(i))
            for i, w in enumerate(words)]
        present = [F.col(pos_name(i)).isNotNull() for i in range(len(words))]
        narrow, dfs = self._kept(self._tokens(), found, present)
        return Hits(narrow.where(all_of(present)), *self._totals, dfs)

    def hits(self, units, required=()):
        counts = [_count_in_tokens(F.col("tokens"), u).alias(tf_name(i))
                  for i, u in enumerate(units)]
        present = [F.col(tf_name(i)) > 0 for i in range(len(units))]
        narrow, dfs = self._kept(self._tokens(), counts, present)
        return Hits(narrow.where(any_of(present)), *self._totals, dfs)


def _is_word_at(tokens: Column, word: str):
    return lambda i: F.get(tokens, i) == word


def _count_in_tokens(tokens: Column, unit: Unit) -> Column:
    """How often a unit occurs in an array of tokens."""
    terms, last = unit.terms, len(unit.terms) - 1
    if not unit.first and not unit.prefix and last == 0:
        return F.size(tokens) - F.size(F.array_remove(tokens, terms[0]))

    def starts_at(i: Column | int) -> Column:
        def holds(j: int) -> Column:
            token = F.get(tokens, i + j if isinstance(i, Column) else F.lit(i + j))
            if unit.prefix and j == last:
                return F.startswith(token, F.lit(terms[j]))
            return token == terms[j]
        return F.coalesce(all_of([holds(j) for j in range(len(terms))]), F.lit(False))

    if unit.first:
        return starts_at(0).cast("int")
    whole = terms[:-1] if unit.prefix else terms
    possible = all_of([F.size(tokens) > last, *[F.array_contains(tokens, t) for t in set(whole)]])
    places = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1 - last), starts_at)
    return F.when(possible, F.size(places)).otherwise(0)


@dataclass(frozen=True)
class Term:
    """What the dictionary says of a word; the bounds are None if it is not known."""

    df: int
    max_tf: int | None
    min_len: int | None
    blocked: bool


class PostingsCorpus(Corpus):
    """Searches postings ``term, doc_id, tf, doc_len, positions``.

    ``bucket`` maps a term to its ``term_bucket``, so that a stored layout can be
    pruned. ``terms`` is the dictionary of the postings in parts (term, df, cf, max_tf,
    min_len, blocked), ``blocks`` the bounds of the blocks of those terms that are blocked in
    a part: (term, block, max_tf, min_len), a block being ids without their last
    ``block_bits`` bits. Without a dictionary the postings are counted instead.
    """

    def __init__(self, table: DataFrame, n_docs: int, total_len: int, stem: bool = True,
                 bucket=None, terms: DataFrame | None = None, blocks: DataFrame | None = None,
                 block_bits: int = 0):
        self.spark = table.sparkSession
        self.table, self.n_docs, self.total_len, self.stem = table, n_docs, total_len, stem
        self.bucket, self.parts, self.blocks, self.block_bits = bucket, terms, blocks, block_bits
        self._known: dict[str, Term] = {}  # of the words asked for so far
        self._started: dict[str, list[str] | None] = {}

    def totals(self):
        return self.n_docs, self.total_len

    def postings(self):
        return self.table

    def postings_of(self, words):
        """The buckets of the words prune the partitions of the postings when the job runs."""
        if self.bucket is None:
            return super().postings_of(words)
        wanted = words.withColumn("term_bucket", self.bucket("term")).where("term_bucket >= 0")
        return self.table.join(wanted, ["term_bucket", "term"])

    def dictionary(self, wanted: Column | None = None) -> DataFrame:
        """(term, df, cf, max_tf, min_len, blocked) of the terms that some document holds."""
        parts = self.parts if wanted is None else self.parts.where(wanted)
        return parts.groupBy("term").agg(
            F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("max_tf").alias("max_tf"),
            F.min("min_len").alias("min_len"), F.min("blocked").alias("blocked")).where("df > 0")

    def places(self, words):
        dfs = self._term_dfs(words)
        rows = self._rarest([Unit((w,)) for w in words], self.table.where(self._with_terms(words)))
        grouped = rows.groupBy("doc_id").agg(
            F.max("doc_len").alias("doc_len"),
            *[F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True)
              .alias(pos_name(i)) for i, w in enumerate(words)])
        present = [F.col(pos_name(i)).isNotNull() for i in range(len(words))]
        return Hits(grouped.where(all_of(present)), self.n_docs, self.total_len,
                    tuple(dfs[w] for w in words))

    def _with_terms(self, terms) -> Column:
        """Rows of whole terms, pruned by bucket."""
        terms = sorted(set(terms))
        if not terms:
            return F.lit(False)
        wanted = F.col("term").isin(*terms)
        if self.bucket is None:
            return wanted
        return F.col("term_bucket").isin(*[self.bucket(F.lit(t)) for t in terms]) & wanted

    def _terms_from(self, prefix: str) -> list[str] | None:
        """The terms that begin so, from the dictionary; None if there are very many."""
        if self.parts is None:
            return None
        if prefix not in self._started:
            found = self.dictionary(F.startswith(F.col("term"), F.lit(prefix))).limit(MOST_TERMS + 1).collect()
            self._note(found)
            self._started[prefix] = None if len(found) > MOST_TERMS else [r["term"] for r in found]
        return self._started[prefix]

    def _rows_of(self, units) -> DataFrame:
        whole = {t for u in units for t in (u.terms[:-1] if u.prefix else u.terms)}
        wanted = []
        for prefix in sorted({u.terms[-1] for u in units if u.prefix}):
            terms = self._terms_from(prefix)
            if terms is None:
                wanted.append(F.startswith(F.col("term"), F.lit(prefix)))
            else:
                whole.update(terms)
        return self.table.where(any_of([self._with_terms(whole), *wanted]))

    def _note(self, rows) -> None:
        self._known |= {r["term"]: Term(r["df"], r["max_tf"], r["min_len"], bool(r["blocked"])) for r in rows}

    def _term_dfs(self, terms) -> dict[str, int]:
        """Document frequency of a few words, from the dictionary if there is one."""
        unknown = [t for t in terms if t not in self._known]
        if unknown and self.parts is not None:
            found = self.dictionary(self._with_terms(unknown)).collect()
        elif unknown:
            none = F.lit(None).cast("int")
            found = (self.table.where(self._with_terms(unknown)).groupBy("term").agg(F.count("*").alias("df"))
                     .select("*", none.alias("max_tf"), none.alias("min_len"), none.alias("blocked")).collect())
        if unknown:
            self._known |= {t: Term(0, None, None, False) for t in unknown}
            self._note(found)
        return {t: self._known[t].df for t in terms}

    def best_of_any(self, units: list[Unit], k: int) -> Hits | None:
        """``hits`` of those documents only which can be among the best k that hold any unit.

        The words that can add most give a score that the k-th document reaches at least.
        Words which together stay below it can't bring a document in by themselves: their
        postings are only read in the blocks where they can still make a difference to a
        document that the others found. None if all rows are to be read, as when they are few.
        """
        if self.parts is None or k < 1 or any(u.prefix or u.first or len(u.terms) != 1 for u in units):
            return None
        words = [u.terms[0] for u in units]
        self._term_dfs(words)
        avg = self.total_len / self.n_docs if self.n_docs and self.total_len else 1.0
        found = [w for w in dict.fromkeys(words) if self._known[w].df]
        if sum(self._known[w].df for w in found) <= FEW_ROWS:
            return None
        times = {w: words.count(w) for w in found}
        idf = {w: bm25.idf_value(self.n_docs, self._known[w].df) for w in found}
        bound = {w: times[w] * bm25.part_value(self._known[w].max_tf, self._known[w].min_len, idf[w], avg) for w in found}
        order = sorted(found, key=lambda w: (-bound[w], w))
        first, held = [], 0
        while order[len(first):] and held < k:
            first.append(order[len(first)])
            held += self._known[first[-1]].df
        if held < k or len(first) == len(order):
            return None

        def parts(tf: Column, length: Column, chosen) -> Column:
            term = F.col("term")
            return reduce(lambda a, w: a.when(term == w, times[w] * bm25.part(tf, length, F.lit(idf[w]), avg)),
                          chosen, F.when(F.lit(False), 0.0))

        def summed(chosen) -> DataFrame:
            rows = self.table.where(self._with_terms(chosen))
            return rows.groupBy("doc_id").agg(F.sum(parts(F.col("tf"), F.col("doc_len"), chosen)).alias("partial"))

        least = summed(first).orderBy(F.desc("partial")).limit(k).agg(F.min("partial"), F.count("*")).first()
        if least[1] < k:
            return None
        # A sum in another order may differ in its last bits.
        least = least[0] * (1 - 1e-9)
        rest, spare = [], 0.0
        for w in reversed(order):
            if spare + bound[w] >= least:
                break
            rest.append(w)
            spare += bound[w]
        if not rest:
            return None
        needed = [w for w in order if w not in rest]
        candidates = materialize(summed(needed).where(F.col("partial") + spare >= least), "candidates")
        candidates = self._within_reach(candidates, rest, bound, parts, least)
        rows = self.table.where(self._with_terms(needed)).join(candidates.select("doc_id"), "doc_id", "left_semi")
        more = self.table.where(self._with_terms(rest) & self._in_blocks(candidates))
        rows = rows.unionByName(more.join(candidates.select("doc_id"), "doc_id", "left_semi"))
        return Hits(self._by_document(rows, units), self.n_docs, self.total_len,
                    tuple(self._known[w].df for w in words))

    def _within_reach(self, candidates: DataFrame, rest, bound, parts, least: float) -> DataFrame:
        """Candidates that still reach ``least`` by what the rest can add in their blocks."""
        blocked = [w for w in rest if self._known[w].blocked]
        if not blocked or self.blocks is None:
            return candidates
        spare = sum(bound[w] for w in rest if w not in blocked)
        most = parts(F.col("max_tf"), F.col("min_len"), blocked)
        bounds = self.blocks.where(self._with_terms(blocked)).groupBy("term", "block").agg(
            F.max(most).alias("most")).groupBy("block").agg(F.sum("most").alias("most"))
        near = candidates.withColumn("block", F.shiftright("doc_id", self.block_bits)).join(bounds, "block", "left")
        reach = F.col("partial") + F.coalesce("most", F.lit(0.0)) + spare
        return materialize(near.where(reach >= least).select("doc_id", "partial"), "candidates")

    def _in_blocks(self, candidates: DataFrame) -> Column:
        """The blocks of the candidates as ranges of ids, which prune row groups; all if they are many."""
        found = (candidates.select(F.shiftright("doc_id", self.block_bits).alias("b")).distinct()
                 .limit(MOST_BLOCKS + 1).collect())
        if len(found) > MOST_BLOCKS:
            return F.lit(True)
        ranges: list[list[int]] = []
        for b in sorted(r["b"] for r in found):
            if ranges and b == ranges[-1][1] + 1:
                ranges[-1][1] = b
            else:
                ranges.append([b, b])
        size = 1 << self.block_bits
        return any_of([F.lit(False), *[F.col("doc_id").between(a * size, (b + 1) * size - 1) for a, b in ranges]])

    def _rarest(self, required, rows: DataFrame) -> DataFrame:
        """Keep rows of documents with the rarest required word.

        Its ids are broadcast only while their number, counted before, keeps
        them below the session's broadcast limit; else nothing is pruned here
        and the aggregation by document does all the work.
        """
        words = {t for u in required for t in (u.terms[:-1] if u.prefix else u.terms)}
        if len(words) < 2:
            return rows
        dfs = self._term_dfs(words)
        rare = min(words, key=lambda t: (dfs[t], t))
        limit = self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        if dfs[rare] * _BYTES_PER_ID > limit:
            return rows
        ids = self.table.where(self._with_terms({rare})).select("doc_id")
        return rows.join(F.broadcast(ids), "doc_id", "left_semi")

    def hits(self, units, required=()):
        simple = [not u.prefix and not u.first and len(u.terms) == 1 for u in units]
        rows = self._rows_of(units)
        if all(simple):
            words = [u.terms[0] for u in units]
            dfs = self._term_dfs(words)
            if len(units) == 1:
                frame = rows.select("doc_id", "doc_len", F.col("tf").alias("tf_0"))
            else:
                frame = self._by_document(self._rarest(required, rows), units)
            return Hits(frame, self.n_docs, self.total_len, tuple(dfs[w] for w in words))
        # Frequencies of phrases and prefixes are not stored. They count every
        # document of the corpus, so the rarest word may only prune the units
        # that hold it; with one unit that is all there is.
        if len(units) == 1:
            rows = self._rarest(units, rows)
        frame = materialize(self._by_document(rows, units), "hits")
        row = frame.agg(*[F.count_if(F.col(tf_name(i)) > 0).alias(f"df_{i}")
                          for i in range(len(units))]).first()
        return Hits(frame.where(any_of([F.col(tf_name(i)) > 0 for i in range(len(units))])),
                    self.n_docs, self.total_len, tuple(row[f"df_{i}"] for i in range(len(units))))

    def _by_document(self, rows: DataFrame, units) -> DataFrame:
        """One shuffle on the document brings all units of it together."""
        aggs, counts = [], []
        for i, unit in enumerate(units):
            found, count = _count_in_postings(i, unit)
            aggs += found
            counts.append(F.coalesce(count, F.lit(0)).alias(tf_name(i)))
        grouped = rows.groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"), *aggs)
        return grouped.select("doc_id", "doc_len", *counts)


def _count_in_postings(i: int, unit: Unit) -> tuple[list[Column], Column]:
    """Aggregates over a document's postings, and the count they lead to."""
    last = len(unit.terms) - 1

    def matches(j: int) -> Column:
        if unit.prefix and j == last:
            return F.startswith(F.col("term"), F.lit(unit.terms[j]))
        return F.col("term") == unit.terms[j]

    if last == 0:
        value = F.col("tf")
        if unit.first:
            value = F.when(F.get("positions", F.lit(0)) == 0, 1)
        return [F.sum(F.when(matches(0), value)).alias(f"n_{i}")], F.col(f"n_{i}").cast("int")
    names = [f"p_{i}_{j}" for j in range(last + 1)]
    # A whole word has one posting per document; a prefix may have several.
    aggs = [F.flatten(F.collect_list(F.when(matches(j), F.col("positions")))).alias(name)
            for j, name in enumerate(names)]

    def shifted(j: int) -> Column:
        return F.transform(names[j], lambda p: p - j)

    starts = reduce(F.array_intersect, [shifted(j) for j in range(1, last + 1)], shifted(0))
    if unit.first:
        return aggs, F.array_contains(starts, 0).cast("int")
    return aggs, F.size(starts)

"""A stored index: immutable segments, and commits that tell which of them are live.

    files/segment=S/doc_bucket=D/        documents and their metadata
    postings/segment=S/term_bucket=T/    term, doc_id, tf, doc_len, positions, born
    terms/segment=S/term_bucket=T/       dictionary: df, cf and the bounds of each term
    blocks/segment=S/term_bucket=T/      the same bounds for blocks of documents of a term
    gone/segment=S/                      rows of earlier segments that this one replaces
    deletions/segment=S/                 paths that were deleted, and when
    commits/N.json                       the live segments and their figures

A change of n files writes one segment of O(n) rows. It never rewrites others: rows it
replaces are listed in ``gone`` by what names them for good, the number of the change that
wrote them with the path, or with the document. The dictionary has differences: what a
change removes counts below zero, so that frequencies are sums over segments.

``merge_segments`` brings together segments of like size, and leaves out what is gone; it
reads and writes these segments only, and each row is merged a logarithmic number of times.

A commit is created once (``commits``). A writer that finds its number taken looks at what
the others did: if they touched other paths its segment is added to theirs, else it
starts anew from their state. Numbers of changes and documents are reserved by a commit
as well. Readers keep the commit they opened.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

from ..functions.times import iso_time
from ..operators import postings as ops
from ..operators.changes import classify_changes, moved_files
from ..operators.corpus import PostingsCorpus
from ..operators.stats import index_stats
from .commits import drop_commits, read_commit, try_commit
from .workdir import delete_tables, materialize

DOC_BUCKETS = 16
TERM_BUCKETS = 16
FAN = 4                # segments of like size that are merged
BLOCK_BITS = 7         # documents of a block have ids that differ in so many bits only
BLOCKED_DF = 512       # documents from which on a term has bounds for blocks,
BLOCK_FILL = 4         # if it has so many for each block: bounds of fewer take the room of the postings


def _schema(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields])


_SEGMENT, _TERM_BUCKET = ("segment", StringType()), ("term_bucket", IntegerType())
SCHEMAS = {
    "files": _schema(
        ("doc_id", LongType()), ("path", StringType()), ("size", LongType()), ("mtime", DoubleType()),
        ("last_indexed", DoubleType()), ("encoding", StringType()), ("error", StringType()),
        ("content", StringType()), ("last_modified", StringType()), ("born", IntegerType()),
        ("written", IntegerType()), _SEGMENT, ("doc_bucket", IntegerType())),
    "postings": _schema(
        ("term", StringType()), ("doc_id", LongType()), ("tf", IntegerType()), ("doc_len", IntegerType()),
        ("positions", ArrayType(IntegerType())), ("born", IntegerType()), _SEGMENT, _TERM_BUCKET),
    "terms": _schema(
        ("term", StringType()), ("df", LongType()), ("cf", LongType()), ("max_tf", IntegerType()),
        ("min_len", IntegerType()), ("blocked", BooleanType()), _SEGMENT, _TERM_BUCKET),
    "blocks": _schema(
        ("term", StringType()), ("block", LongType()), ("max_tf", IntegerType()), ("min_len", IntegerType()),
        _SEGMENT, _TERM_BUCKET),
    "gone": _schema(
        ("path", StringType()), ("written", IntegerType()), ("doc_id", LongType()), ("born", IntegerType()),
        _SEGMENT),
    "deletions": _schema(("path", StringType()), ("mtime", DoubleType()), _SEGMENT),
}
_FILE_COLUMNS = [f.name for f in SCHEMAS["files"] if f.name not in ("segment", "doc_bucket")]
_POSTING_COLUMNS = [f.name for f in SCHEMAS["postings"] if f.name not in ("segment", "term_bucket")]


@dataclass(frozen=True)
class Segment:
    """An entry of a commit. ``n_docs`` and ``total_len`` are differences; ``rows`` of each table."""

    name: str
    numbers: list[list[int]]     # ranges of the changes whose rows it holds
    n_docs: int
    total_len: int
    rows: dict[str, int] = field(hash=False)

    def holds(self, number: int) -> bool:
        return any(a <= number <= b for a, b in self.numbers)


def doc_bucket_of(path: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def term_bucket_of(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Index:
    """An opened commit."""

    spark: SparkSession
    location: str
    commit: int
    generation: int            # changes and merges committed, from 0
    doc_buckets: int
    term_buckets: int
    stem: bool
    next_doc_id: int
    next_number: int
    streams: dict[str, int]    # the last micro-batch applied of each stream
    segments: list[Segment]

    @property
    def n_docs(self) -> int:
        return sum(s.n_docs for s in self.segments)

    @property
    def total_len(self) -> int:
        return sum(s.total_len for s in self.segments)

    def table(self, name: str, segments: list[Segment] | None = None) -> DataFrame:
        """The rows of a table in these segments, or all, as they were written."""
        held = [s for s in (self.segments if segments is None else segments) if s.rows.get(name)]
        if not held:
            return self.spark.createDataFrame([], SCHEMAS[name])
        root = f"{self.location}/{name}"
        return self.spark.read.schema(SCHEMAS[name]).option("basePath", root).parquet(
            *[f"{root}/segment={s.name}" for s in held])

    def _has(self, name: str) -> bool:
        return any(s.rows.get(name) for s in self.segments)

    def live_files(self, segments: list[Segment] | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        rows = self.table("files", segments)
        if buckets is not None:
            rows = rows.where(F.col("doc_bucket").isin(*buckets))
        if self._has("gone"):
            rows = rows.join(self.table("gone").select("path", "written"), ["path", "written"], "left_anti")
        return rows

    def live_postings(self, segments: list[Segment] | None = None) -> DataFrame:
        rows = self.table("postings", segments)
        if self._has("gone"):
            gone = self.table("gone").where("doc_id is not null").select("doc_id", "born")
            rows = rows.join(gone, ["doc_id", "born"], "left_anti")
        return rows

    def files(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """Every known file: metadata, and content if it could be read once."""
        return self.live_files(buckets=buckets)

    def postings(self) -> DataFrame:
        return self.live_postings()

    def documents(self) -> DataFrame:
        return self.files().where(F.col("content").isNotNull()).select(
            "doc_id", "path", "content", "last_modified")

    def metadata(self, buckets: Iterable[int] | None = None) -> DataFrame:
        return self.files(buckets).select("path", "size", "mtime", "last_indexed", "encoding", "error")

    def deletions(self) -> DataFrame:
        """(path, deleted_at): the newest deletion of each path that had a time."""
        return self.table("deletions").groupBy("path").agg(F.max("mtime").alias("deleted_at"))

    def terms(self) -> DataFrame:
        """The dictionary: ``term, df, cf``."""
        return self.corpus().dictionary().select("term", "df", "cf")

    def corpus(self) -> PostingsCorpus:
        buckets = self.term_buckets
        return PostingsCorpus(self.postings(), self.n_docs, self.total_len, self.stem,
                              lambda term: term_bucket_of(term, buckets),
                              self.table("terms"), self.table("blocks"), BLOCK_BITS)

    def _folders(self) -> list[str]:
        return [f"{self.location}/{name}/segment={s.name}" for s in self.segments
                for name in SCHEMAS if s.rows.get(name)]

    def size_bytes(self) -> int:
        """Bytes of the data files that this commit reads."""
        if not (folders := self._folders()):
            return 0
        listing = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
        return listing.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]

    def stats(self) -> DataFrame:
        """One row: ``indexed_files, last_scan, index_size_mb, total_documents, errors_encountered``."""
        return index_stats(self.documents(), self.metadata(), self.size_bytes())

    def content(self, **changed) -> dict:
        """What a commit says of this state, with some of it changed."""
        said = {name: getattr(self, name) for name in
                ("generation", "doc_buckets", "term_buckets", "stem", "next_doc_id", "next_number", "streams", "segments")}
        said |= changed
        return said | {"segments": [vars(s) for s in said["segments"]]}


def _open(spark: SparkSession, location: str) -> Index | None:
    """The newest commit, one that only reserves numbers for a first change too."""
    found = read_commit(spark, location)
    if found is None:
        return None
    number, said = found
    return Index(spark, location, number, **said | {"segments": [Segment(**s) for s in said["segments"]]})


def open_index(spark: SparkSession, location: str) -> Index | None:
    """The newest complete state, or None where there is no index yet."""
    index = _open(spark, location)
    return None if index is None or index.generation < 0 else index


def _write(rows: DataFrame, location: str, table: str, segment: str, order: list[str],
           made: dict[str, Column] | None = None) -> str:
    """Rows by bucket, sorted; oversized buckets are split, tiny ones merged.

    ``made`` are columns that follow from the others, so that they need not be shuffled.
    """
    path, made = f"{location}/{table}/segment={segment}", made or {}
    bucket = "doc_bucket" if table == "files" else "term_bucket"
    columns = [f.name for f in SCHEMAS[table] if f.name != "segment"]
    moved = rows.select(*[c for c in columns if c not in made]).hint("rebalance", F.col(bucket))
    (moved.withColumns(made).select(*columns).sortWithinPartitions(bucket, *order)
     .write.partitionBy(bucket).parquet(path))
    return path


def _write_postings(rows: DataFrame, location: str, segment: str, term_buckets: int, **made: Column) -> DataFrame:
    rows = rows.withColumn("term_bucket", term_bucket_of("term", term_buckets))
    path = _write(rows, location, "postings", segment, ["term", "doc_id"], made | {"tf": F.size("positions")})
    return _stored(rows.sparkSession, path, "postings")


def _stored(spark: SparkSession, path: str, table: str) -> DataFrame:
    schema = StructType([f for f in SCHEMAS[table] if f.name != "segment"])
    return spark.read.schema(schema).parquet(path)


def _new_rows(changes: DataFrame, run_time: float, number: int, offsets: DataFrame | None,
              buckets: int) -> DataFrame:
    """Rows of documents to store, numbered without gaps by the partitions they are in."""
    rows = changes.where("status = 'ok'")
    if offsets is not None:
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        rows = rows.select("*", F.spark_partition_id().alias("part"), place.alias("place"))
        rows = rows.join(F.broadcast(offsets), "part").withColumn("doc_id", F.col("offset") + F.col("place"))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), "path", F.col("size").cast("long").alias("size"),
        "mtime", F.lit(float(run_time)).alias("last_indexed"), "encoding",
        F.lit(None).cast("string").alias("error"), "content", "last_modified",
        F.lit(number).alias("born"), F.lit(number).alias("written"), doc_bucket_of("path", buckets).alias("doc_bucket"))


def _error_rows(changes: DataFrame, before: DataFrame, run_time: float, number: int, buckets: int) -> DataFrame:
    """Metadata of files that failed; content indexed earlier stays."""
    rows = changes.where("status = 'error'").select("path", "size", "mtime", "error")
    rows = rows.join(before.select("path", "doc_id", "content", "last_modified", "born"), "path", "left")
    return rows.select(
        "doc_id", "path", F.col("size").cast("long").alias("size"), "mtime",
        F.lit(float(run_time)).alias("last_indexed"), F.lit(None).cast("string").alias("encoding"),
        "error", "content", "last_modified", "born", F.lit(number).alias("written"),
        doc_bucket_of("path", buckets).alias("doc_bucket"))


def _moves(changes: DataFrame, before: DataFrame) -> DataFrame:
    """(path, moved_from): new paths whose content is that of one path which the change deletes."""
    digest = F.sha2("content", 256).alias("digest")
    added = changes.where("status = 'ok'").join(before.select("path"), "path", "left_anti")
    removed = before.where("new_status = 'deleted' and doc_id is not null")
    return moved_files(added.select("path", digest), removed.select("path", digest))


def _moved_rows(changes: DataFrame, before: DataFrame, moves: DataFrame, run_time: float, number: int,
                buckets: int) -> DataFrame:
    """A document that only moved keeps its number, and so its postings."""
    old = before.select(F.col("path").alias("moved_from"), "doc_id", "born")
    rows = changes.select("path", "size", "mtime", "encoding", "content", "last_modified").join(moves, "path")
    return rows.join(old, "moved_from").select(
        "doc_id", "path", F.col("size").cast("long").alias("size"), "mtime",
        F.lit(float(run_time)).alias("last_indexed"), "encoding", F.lit(None).cast("string").alias("error"),
        "content", "last_modified", "born", F.lit(number).alias("written"),
        doc_bucket_of("path", buckets).alias("doc_bucket"))


def _block() -> Column:
    return F.shiftright("doc_id", BLOCK_BITS).alias("block")


def _dictionary(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"), F.max("tf").alias("max_tf"),
        F.min("doc_len").alias("min_len"))


def _write_bounds(spark: SparkSession, location: str, name: str, files: DataFrame, postings: DataFrame,
                  removed: DataFrame | None, extra: DataFrame | None, term_buckets: int) -> tuple[DataFrame, int]:
    """Write the dictionary of a segment and the bounds of its frequent terms' blocks.

    ``removed`` are (term, tf) of documents that the segment replaces; ``extra`` are differences
    of merged segments that already are in a dictionary.
    """
    held = files.where("content is not null").select(_block()).distinct().count()
    own = _dictionary(postings).withColumn("blocked", F.col("df") >= max(BLOCKED_DF, BLOCK_FILL * held))
    if extra is not None:
        # The sums come from the merged dictionaries, the bounds from the rows that are left.
        own = extra.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).join(
            own.drop("df", "cf"), "term", "left")
    nothing = [F.lit(None).cast("int").alias("max_tf"), F.lit(None).cast("int").alias("min_len"),
               F.lit(None).cast("boolean").alias("blocked")]
    if removed is not None:
        less = removed.groupBy("term").agg((-F.count("*")).alias("df"), (-F.sum("tf")).cast("long").alias("cf"))
        own = own.unionByName(less.select("*", *nothing)).groupBy("term").agg(
            F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("max_tf").alias("max_tf"),
            F.min("min_len").alias("min_len"), F.min("blocked").alias("blocked"))
    own = own.where("df <> 0 or max_tf is not null")
    bucket = term_bucket_of("term", term_buckets).alias("term_bucket")
    terms = _stored(spark, _write(own.select("*", bucket), location, "terms", name, ["term"]), "terms")
    # At most BLOCK_FILL-th of a block's documents times the terms of an average one: postings stay where they are.
    frequent = F.broadcast(terms.where("blocked").select("term"))
    blocks = postings.join(frequent, "term", "left_semi").groupBy("term", _block()).agg(
        F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"))
    path = _write(blocks.select("*", bucket), location, "blocks", name, ["term", "block"])
    return terms, _stored(spark, path, "blocks").count()


def _write_segment(index: Index, number: int, changes: DataFrame, run_time: float,
                   offsets: DataFrame | None, n_ok: int | None) -> tuple[Segment, int]:
    """Write what a change comes to; the segment and the largest id of its documents."""
    spark, location = index.spark, index.location
    name = f"{number:08d}-{uuid.uuid4().hex[:8]}"
    if index.segments:
        touched = [r[0] for r in changes.select(doc_bucket_of("path", index.doc_buckets)).distinct().collect()]
        before = index.files(touched).join(changes.select("path"), "path", "left_semi")
    else:
        before = spark.createDataFrame([], SCHEMAS["files"])
    # The rows that the change replaces: as many as it has, at most.
    before = materialize(before.join(changes.select("path", F.col("status").alias("new_status")), "path"),
                         "before") if index.segments else before.withColumn("new_status", F.lit(""))

    files = _new_rows(changes, run_time, number, offsets, index.doc_buckets).unionByName(
        _error_rows(changes, before, run_time, number, index.doc_buckets))
    n_moved = 0
    if offsets is not None and index.segments and not before.where("new_status = 'deleted'").isEmpty():
        moves = materialize(_moves(changes, before), "moves")
        if n_moved := moves.count():
            files = files.join(moves.select("path"), "path", "left_anti").unionByName(
                _moved_rows(changes, before, moves, run_time, number, index.doc_buckets))
            before = before.join(moves.select(F.col("moved_from").alias("path"), F.lit("moved").alias("now")),
                                 "path", "left")
            before = before.withColumn("new_status", F.coalesce("now", "new_status")).drop("now")
    written = _stored(spark, _write(files, location, "files", name, ["doc_id"]), "files")
    fresh = written.where(F.col("content").isNotNull() & (F.col("born") == number))
    postings = _write_postings(ops.build_postings(fresh, "doc_id", "content", index.stem), location, name,
                               index.term_buckets, born=F.lit(number))

    removed, n_gone, n_removed, n_deletions = None, 0, 0, 0
    if index.segments:
        drops = F.col("new_status").isin("ok", "deleted") & F.col("doc_id").isNotNull()
        n_gone, n_removed = before.agg(F.count("*"), F.count_if(drops)).first()
        before.select("path", "written", F.when(drops, F.col("doc_id")).alias("doc_id"),
                      F.when(drops, F.col("born")).alias("born")).write.parquet(f"{location}/gone/segment={name}")
        if n_removed:
            removed = ops.build_postings(before.where(drops), "doc_id", "content", index.stem, positions=False)
    gone_at = changes.where("status = 'deleted'").select("path", F.col("mtime").cast("double").alias("mtime"))
    if not gone_at.isEmpty():
        gone_at.write.parquet(f"{location}/deletions/segment={name}")
        n_deletions = gone_at.count()
    terms, n_blocks = _write_bounds(spark, location, name, written, postings, removed, None, index.term_buckets)
    n_terms, total_len = terms.agg(F.count("*"), F.coalesce(F.sum("cf"), F.lit(0))).first()
    is_new = F.col("error").isNull() & (F.col("born") == number)
    n_files, n_new, n_docs, last_id = written.agg(
        F.count("*"), F.count_if(is_new), F.count_if(F.col("content").isNotNull() & is_new),
        F.coalesce(F.max("doc_id"), F.lit(-1))).first()
    if n_ok is not None and n_new + n_moved != n_ok:
        raise RuntimeError("the changes were read twice with different partitions: store them as a table first")
    rows = {"files": n_files, "postings": postings.count(), "terms": n_terms, "blocks": n_blocks, "gone": n_gone,
            "deletions": n_deletions}
    return Segment(name, [[number, number]], n_docs - n_removed, total_len, rows), last_id


def _reserve(spark: SparkSession, location: str, n_ids: int, options: dict) -> tuple[Index, int, int]:
    """(state, number of the change, its first document id): nobody else gets these."""
    while True:
        index = _open(spark, location)
        if index is None or index.generation < 0:
            first = 0 if index is None else index.next_doc_id
            number = 0 if index is None else index.next_number
            commit = 0 if index is None else index.commit + 1
            index = Index(spark, location, commit - 1, -1, options["doc_buckets"], options["term_buckets"],
                          options["stem"], first, number, {}, [])
        said = index.content(next_doc_id=index.next_doc_id + n_ids, next_number=index.next_number + 1)
        if try_commit(spark, location, index.commit + 1, said):
            return index, index.next_number, index.next_doc_id


def _in_the_way(base: Index, now: Index, changes: DataFrame) -> bool:
    """If others changed the same paths since ``base`` was opened."""
    known = {tuple(r) for s in base.segments for r in s.numbers}
    others = [s for s in now.segments if s.name not in {b.name for b in base.segments}
              and not all(any(a <= x and y <= b for a, b in known) for x, y in s.numbers)]
    if not others:
        return False
    theirs = now.table("files", others).select("path").unionByName(now.table("gone", others).select("path")).unionByName(
        now.table("deletions", others).select("path"))
    return not changes.select("path").join(theirs, "path", "left_semi").isEmpty()


def apply_changes(spark: SparkSession, location: str, changes: DataFrame, run_time: float,
                  stem: bool = True, doc_buckets: int = DOC_BUCKETS,
                  term_buckets: int = TERM_BUCKETS, stream: str | None = None,
                  batch_id: int | None = None) -> Index:
    """Upsert and delete by path, as a new segment.

    ``changes``: ``path, status, size, mtime, encoding, content, error,
    last_modified`` with one row per path, and ``doc_id`` if the caller numbers
    the documents. It is read more than once, so it should be a stored table.
    Status ``ok`` replaces a document, ``error`` records a failure, ``deleted``
    removes the path, ``skipped`` changes nothing. Content that goes from one deleted path
    to one new path moves: the document keeps its number and its postings, unless the
    caller numbers documents. Bucket counts and stemming are
    fixed by the first change. Writers may run at the same time.
    """
    options = {"stem": stem, "doc_buckets": doc_buckets, "term_buckets": term_buckets}
    changes = changes.where("status <> 'skipped'")
    numbered = "doc_id" in changes.columns
    counts = [] if numbered else [tuple(r) for r in changes.where("status = 'ok'").groupBy(
        F.spark_partition_id().alias("part")).count().orderBy("part").collect()]  # a row per partition
    while True:
        base, number, first_id = _reserve(spark, location, sum(n for _, n in counts), options)
        offsets = None
        if not numbered:
            ends = [first_id]
            for _, n in counts:
                ends.append(ends[-1] + n)
            offsets = spark.createDataFrame([(p, e) for (p, _), e in zip(counts, ends)], "part int, offset long")
        segment, last_id = _write_segment(base, number, changes, run_time, offsets,
                                          None if numbered else sum(n for _, n in counts))
        while True:
            now = _open(spark, location)
            if stream is not None and now.streams.get(stream, -1) >= batch_id:
                return open_index(spark, location)  # applied by another run of the same stream
            if _in_the_way(base, now, changes):
                break
            said = now.content(
                generation=now.generation + 1, segments=[*now.segments, segment],
                next_doc_id=max(now.next_doc_id, last_id + 1),
                streams=now.streams if stream is None else {**now.streams, stream: batch_id})
            if try_commit(spark, location, now.commit + 1, said):
                return open_index(spark, location)


def _tier(segment: Segment, fan: int) -> int:
    return int(math.log(max(1, segment.rows.get("postings", 0) + segment.rows.get("gone", 0)), fan))


def _merged(index: Index, chosen: list[Segment]) -> Segment:
    """Write the rows of some segments that are live, and what still holds of their differences."""
    spark, location = index.spark, index.location
    ranges: list[list[int]] = []
    for a, b in sorted(r for s in chosen for r in s.numbers):
        if ranges and a <= ranges[-1][1] + 1:
            ranges[-1][1] = max(b, ranges[-1][1])
        else:
            ranges.append([a, b])
    name = f"{ranges[-1][1]:08d}-{uuid.uuid4().hex[:8]}"
    files = _stored(spark, _write(index.live_files(chosen), location, "files", name, ["doc_id"]), "files")
    postings = _write_postings(index.live_postings(chosen), location, name, index.term_buckets)
    # Rows to leave out are only needed as long as they can be in another segment.
    inside = lambda c: F.coalesce(F.lit(False) | _any([F.col(c).between(a, b) for a, b in ranges]), F.lit(True))
    gone = materialize(index.table("gone", chosen).where(~(inside("written") & inside("born"))).drop("segment"), "gone")
    n_gone, n_deletions = gone.count(), 0
    if n_gone:
        gone.write.parquet(f"{location}/gone/segment={name}")
    if any(s.rows.get("deletions") for s in chosen):
        deletions = index.table("deletions", chosen).groupBy("path").agg(F.max("mtime").alias("mtime"))
        deletions.write.parquet(f"{location}/deletions/segment={name}")
        n_deletions = sum(s.rows.get("deletions", 0) for s in chosen)
    terms, n_blocks = _write_bounds(spark, location, name, files, postings, None, index.table("terms", chosen),
                                    index.term_buckets)
    rows = {"files": files.count(), "postings": postings.count(), "terms": terms.count(), "blocks": n_blocks,
            "gone": n_gone, "deletions": n_deletions}
    return Segment(name, ranges, sum(s.n_docs for s in chosen), sum(s.total_len for s in chosen), rows)


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def merge_segments(spark: SparkSession, location: str, fan: int = FAN) -> Index | None:
    """Merge ``fan`` or more segments of like size until there are no such.

    Others may write at the same time. Segments of which another merge was faster are left.
    """
    while (index := open_index(spark, location)) is not None:
        tiers: dict[int, list[Segment]] = {}
        for s in index.segments:
            tiers.setdefault(_tier(s, fan), []).append(s)
        chosen = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= fan), None)
        if chosen is None:
            return index
        merged, names = _merged(index, chosen), {s.name for s in chosen}
        while True:
            now = open_index(spark, location)
            if not names <= {s.name for s in now.segments}:
                break
            segments = [merged if s.name == chosen[0].name else s for s in now.segments
                        if s.name == chosen[0].name or s.name not in names]
            if try_commit(spark, location, now.commit + 1, now.content(generation=now.generation + 1, segments=segments)):
                break
    return None


def remove_old(spark: SparkSession, location: str) -> list[str]:
    """Remove segments and commits that the newest state does not need; the names of the segments.

    Not while others write, and not while readers use an older state.
    """
    index = open_index(spark, location)
    if index is None:
        return []
    live = {s.name for s in index.segments}
    found = set()
    for table in SCHEMAS:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{location}/{table}")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(folder):
            names = [s.getPath().getName().removeprefix("segment=") for s in fs.listStatus(folder)]
            old = [n for n in names if n not in live]
            delete_tables(spark, [f"{location}/{table}/segment={n}" for n in old])
            found.update(old)
    drop_commits(spark, location, index.commit)
    return sorted(found)


def build_index(documents: DataFrame, location: str, id_col: str = "doc_id",
                text_col: str = "text", path_col: str | None = None, stem: bool = True,
                doc_buckets: int = DOC_BUCKETS, term_buckets: int = TERM_BUCKETS,
                run_time: float = 0.0) -> Index:
    """Index a table of documents whose ids are unique longs.

    ``path_col`` names the documents; without it the id does.
    """
    path = F.col(path_col) if path_col else F.col(id_col).cast("string")
    text = F.coalesce(F.col(text_col), F.lit(""))
    changes = documents.select(
        F.col(id_col).alias("doc_id"), path.alias("path"), F.lit("ok").alias("status"),
        F.octet_length(text).alias("size"), F.lit(float(run_time)).alias("mtime"),
        F.lit("utf-8").alias("encoding"), text.alias("content"),
        F.lit(None).cast("string").alias("error"),
        iso_time(F.lit(float(run_time))).alias("last_modified"))
    return apply_changes(documents.sparkSession, location, changes, run_time, stem,
                         doc_buckets, term_buckets)


def plan_refresh(index: Index | None, current: DataFrame, force: bool = False) -> DataFrame:
    """``path, action`` of the current listing against the stored metadata."""
    spark = current.sparkSession
    previous = (index.metadata() if index else
                spark.createDataFrame([], "path string, size long, mtime double"))
    return classify_changes(current, previous, force)

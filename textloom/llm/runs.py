"""Periodic runs of words, by tiles for each octave of periods.

A run is a maximal stretch of words with smallest period q and at least ``LEAST`` words
and ``TIMES`` periods. For each octave of periods a document is cut into overlapping
tiles around boundaries that are two octave starts apart, so that every run holds one.
A tile is solved by itself: hashes of windows on either side of its boundary tell if
anything repeats there; if so, two Z-functions, one read forwards and one backwards from
the boundary, give for every period how far it holds. What leaves a tile is intervals,
cut off at its ends. They are shuffled by document and period, and those that overlap by
a period or more are stitched; only then their length counts.

Tiles of usual documents are solved where the document is read. A document of more than
``LONG`` words becomes rows of tiles, of ``CORE`` words or more, which are spread over
all tasks. The work is linear in the words for each octave, also where one word fills
the text.

Defined cases: null or empty texts and texts of white space have no words and no runs;
null ids are ids like others; rows with equal ids and different texts are looked at each
by its text; equal rows have equal results; an empty table gives an empty result.
Other columns are not carried over.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.columns import as_text
from textloom.plans.workdir import materialize, ship_package

LEAST = 24           # words of the shortest run
TIMES = 3            # periods that a run holds at least; the cuts below rely on both
LONG = 1 << 20       # words from which on the tiles of a document are rows
CORE = 1 << 17       # boundaries of such a tile lie in so many words
GROUP_BYTES = 4 << 20  # text that is looked at together
SCREEN = 1 << 19     # comparisons of one step of the screen
_BASE = 0x9E3779B97F4A7C15


def octaves(n: int) -> Iterator[tuple[int, int, int]]:
    """(low, high, reach) of the periods low..high-1 that a run among ``n`` words may have.

    Boundaries lie ``2 * reach`` words apart, a tile is ``2 * reach`` words before and
    ``4 * reach`` words from its boundary on. Runs of periods below 8 are as long as
    those of 8, so they share the tiles of the first octave.
    """
    low, high, reach = 1, 16, 8
    while max(LEAST, TIMES * low) <= n:
        yield low, high, reach
        low, high, reach = high, 2 * high, 2 * reach


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    return _all_powers(1 << max(n, 1 << 10).bit_length())


@lru_cache(maxsize=2)
def _all_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors)
    return powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window; equal windows have equal ones."""
    n = len(ids)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _powers(n)
    x = ids.astype(np.uint64) + np.uint64(1)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(x * up[:n], out=sums[1:])
    return (sums[size:] - sums[:-size]) * down[:n - size + 1]


def _repeating(ids: np.ndarray, low: int, high: int, reach: int, bounds: np.ndarray) -> np.ndarray:
    """The boundaries with a window beside them that is repeated one period further on."""
    values = window_hashes(ids, reach)
    last = len(values) - 1
    if last < 0:
        return bounds[:0]
    periods = np.arange(low, high)
    step = max(1, SCREEN // len(periods))
    found = []
    for start in range(0, len(bounds), step):
        part = bounds[start:start + step]
        hit = np.zeros(len(part), bool)
        for i in (part, part - reach):
            inside = np.flatnonzero((i >= 0) & (i <= last))
            j = i[inside, None] + periods
            same = values[np.minimum(j, last)] == values[i[inside], None]
            hit[inside] |= (same & (j <= last)).any(axis=1)
        found.append(part[hit])
    return np.concatenate(found) if found else bounds[:0]


def z_function(s: list[int]) -> list[int]:
    """For each place, how many values from there on are those of the beginning."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@lru_cache(maxsize=1 << 16)
def _prime_factors(n: int) -> tuple[int, ...]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return (*found, n) if n > 1 else tuple(found)


def _solve_tile(ids: np.ndarray, low: int, high: int, reach: int, c: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the intervals that hold the boundary ``c`` and a period."""
    left, right = max(0, c - 2 * reach), min(len(ids), c + 4 * reach)
    top = min(len(ids), c + 2 * reach)
    before = ids[left:c][::-1].tolist()
    n = min(high - 1, top - c)
    if n < low:
        return []
    forward = np.zeros(n + 1, np.int64)
    ahead = z_function(ids[c:right].tolist())[:n + 1]
    forward[:len(ahead)] = ahead
    around = z_function(before + [-1] + ids[left:top][::-1].tolist())[len(before) + 1:]
    # The word before c + q is the (top - c - q)th of those read backwards.
    backward = np.zeros(n + 1, np.int64)
    backward[1:] = np.array(around, np.int64)[top - c - np.arange(1, n + 1)]
    q = np.arange(low, n + 1)
    starts, ends = c - backward[low:], c + q + forward[low:]
    length = ends - starts
    cut = (starts == left) | (ends == right)
    out = []
    for k in np.flatnonzero((length >= np.maximum(LEAST, TIMES * q)) | (cut & (length >= 2 * q))).tolist():
        period, start, end = int(q[k]), int(starts[k]), int(ends[k])
        parts = (period // p for p in _prime_factors(period))
        # A smaller period of the interval divides this one and would hold in all of it.
        if not any(c - backward[d] <= start and c + d + forward[d] >= end for d in parts):
            out.append((period, start, end))
    return out


def fragments(ids: np.ndarray, low: int, high: int, reach: int, bounds: np.ndarray) -> np.ndarray:
    """Rows (period, start, end) found at the boundaries of one octave."""
    found = [f for c in _repeating(ids, low, high, reach, bounds).tolist()
             for f in _solve_tile(ids, low, high, reach, c)]
    return np.array(found, np.int64).reshape(-1, 3)


def _words(texts: pa.Array) -> pa.ListArray:
    """Words between ASCII white space of each text."""
    split = pc.ascii_split_whitespace(texts)
    words, rows = split.flatten(), pc.list_parent_indices(split)
    held = pc.not_equal(pc.binary_length(words), 0)
    words, rows = words.filter(held), rows.filter(held).to_numpy()
    offsets = np.searchsorted(rows, np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), words)


def _solve_group(words: pa.ListArray, alone: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Fragments of each document of a group; ``alone`` marks the ones to leave out.

    The documents stand one after the other with a word of its own after each, so that
    nothing repeats across them.
    """
    sizes = pc.list_value_length(words).to_numpy().astype(np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    codes = words.flatten().dictionary_encode()
    terms = len(codes.dictionary)
    ends = np.cumsum(sizes)
    begins = ends - sizes + np.arange(len(sizes))
    ids = np.insert(codes.indices.to_numpy().astype(np.int64), ends, terms + np.arange(len(sizes)))
    looked = np.where(alone, 0, sizes)
    for low, high, reach in octaves(int(looked.max(initial=0))):
        bounds = np.arange(0, len(ids), 2 * reach)
        owner = np.searchsorted(begins, bounds, "right") - 1
        bounds = bounds[looked[owner] >= max(LEAST, TIMES * low)]
        for period, start, end in fragments(ids, low, high, reach, bounds).tolist():
            doc = int(np.searchsorted(begins, start, "right") - 1)
            out[doc].append((period, start - int(begins[doc]), end - int(begins[doc])))
    return out


def tiles(n: int, core: int = CORE) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(low, high, reach, first, last, start, end): tiles start..end of a document of ``n``
    words, whose boundaries are those from first to last."""
    for low, high, reach in octaves(n):
        size = max(core, 8 * reach)
        for first in range(0, n, size):
            last = min(n, first + size)
            yield low, high, reach, first, last, max(0, first - 2 * reach), min(n, last + 4 * reach)


def _rows_of_tiles(key: bytes, codes: np.ndarray, core: int) -> Iterator[dict]:
    for low, high, reach, first, last, start, end in tiles(len(codes), core):
        yield {"key": key, "low": low, "high": high, "reach": reach, "first": first, "last": last, "start": start,
               "ids": codes[start:end].astype("<i4").tobytes()}


_FRAGMENT = pa.struct([("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_TILE = pa.struct([("key", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("reach", pa.int64()),
                   ("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
_READ = ("id {kind}, key binary, n_words long, text string, "
         "fragments array<struct<period:long,start:long,end:long>>, tile struct<key:binary,low:long,high:long,"
         "reach:long,first:long,last:long,start:long,ids:binary>")


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of a bounded size, or of one row."""
    sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + GROUP_BYTES, "right")))
        yield batch.slice(start, end - start)
        start = end


def _read(docs: DataFrame, long: int, core: int) -> DataFrame:
    """A row per document, with its words joined by spaces and its fragments; for a long one
    (fragments null) further rows with its tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _groups(batch):
                texts = part.column(1)
                words = _words(texts)
                sizes = pc.list_value_length(words).to_numpy()
                alone = sizes > long
                found = _solve_group(words, alone)
                keys = [xxhash.xxh3_128_digest(f"{d}\x00{t}".encode())
                        for d, t in zip(part.column(0).to_pylist(), texts.to_pylist())]
                joined = pc.binary_join(words, " ")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), joined,
                     pa.array([None if a else [dict(zip(("period", "start", "end"), f)) for f in row]
                               for a, row in zip(alone, found)], pa.list_(_FRAGMENT)),
                     pa.nulls(part.num_rows, _TILE)], ["id", "key", "n_words", "text", "fragments", "tile"])
                for i in np.flatnonzero(alone).tolist():
                    codes = words[i].values.dictionary_encode().indices.to_numpy()
                    for tile in _rows_of_tiles(keys[i], codes, core):
                        yield pa.RecordBatch.from_arrays(
                            [pa.nulls(1, part.schema.field(0).type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()),
                             pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(_FRAGMENT)), pa.array([tile], _TILE)],
                            ["id", "key", "n_words", "text", "fragments", "tile"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, _READ.format(kind=kind))


def _solved(tile_rows: DataFrame) -> DataFrame:
    """(key, period, start, end) of tiles in rows, in words of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                reach, start = t["reach"], t["start"]
                bounds = np.arange(-(-t["first"] // (2 * reach)) * 2 * reach, t["last"], 2 * reach) - start
                found = fragments(np.frombuffer(t["ids"], "<i4").astype(np.int64), t["low"], t["high"], reach, bounds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t["key"]] * len(found), pa.binary()), pa.array(found[:, 0]),
                     pa.array(found[:, 1] + start), pa.array(found[:, 2] + start)], ["key", "period", "start", "end"])

    spread = tile_rows.select("tile.*").repartition("key", "low", "first")
    return spread.mapInArrow(run, "key binary, period long, start long, end long")


def stitched(found: DataFrame) -> DataFrame:
    """(key, period, start, length) of the runs that fragments of one key and period make up."""
    order = Window.partitionBy("key", "period").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before >= F.col("start") + F.col("period"), 0).otherwise(1)
    part = F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = found.distinct().withColumn("begins", begins).withColumn("part", part)
    joined = rows.groupBy("key", "period", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start")
    return (joined.select("key", "period", "start", length.alias("length"))
            .where((F.col("length") >= LEAST) & (F.col("length") >= TIMES * F.col("period"))))


def _collapsed(rows: DataFrame) -> DataFrame:
    """Add kept_text: the words but for those of a run after its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, runs in zip(batch.column("text"), batch.column("runs")):
                words = text.as_py().split(" ")
                depth = np.zeros(len(words) + 1, np.int64)
                for r in runs.as_py():
                    depth[r["start"] + r["period"]] += 1
                    depth[r["start"] + r["length"]] -= 1
                kept.append(" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kept, pa.string())],
                                             ["id", "n_words", "runs", "kept_text"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "n_words", "runs", "text").mapInArrow(
        run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string")


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long: int = LONG,
              core: int = CORE) -> DataFrame:
    """(id, n_words, runs, kept_text) of every row.

    ``runs`` are (start, length, period) in words from 0, by start and then period.
    ``kept_text`` is the words joined by one space, without what a run repeats.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), as_text(text_col).alias("text"))
    read = materialize(_read(texts, long, core), "run-documents")
    own = read.where("size(fragments) > 0").select("key", F.explode("fragments").alias("f")).select("key", "f.*")
    found = own.unionByName(_solved(read.where("tile is not null")))
    runs = stitched(found).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    rows = read.where("tile is null")
    # Only documents with a fragment move; the others are done.
    may = F.col("fragments").isNull() | (F.size("fragments") > 0)
    none = F.array().cast("array<struct<start:long,length:long,period:long>>")
    plain = rows.where(~may).select("id", "n_words", none.alias("runs"), F.col("text").alias("kept_text"))
    some = (rows.where(may).select("id", "key", "n_words", "text").join(runs, "key", "left")
            .select("id", "n_words", "text", F.coalesce("runs", none).alias("runs")))
    return plain.unionByName(_collapsed(some)).withColumnRenamed("id", id_col)

"""Hard negatives from candidate blocks in Hilbert order, chosen by zone maps.

Candidates are sorted along a Hilbert curve over the ``AXES`` components that vary most
and written as Parquet blocks of ``BLOCK`` rows; ``SPAN`` blocks in a row are a stretch.
Each block keeps the smallest and the largest value of each component, and its labels.
From these, interval arithmetic bounds every inner product of an anchor with a row of the
block. A block is read for an anchor only if the bounds meet one of the anchor's windows
of scores and a label there counts.

An anchor reads the blocks of its own stretch first. That gives a score that its best
positives reach at least, so that other stretches are only read where the bounds reach
it. The positives set the windows of the negatives, which are searched the same way.
Anchors travel in packs of ``PACK``, once to the zone maps of each stretch and once to each
block that they have to read; a pack meets one block at a time, so no task holds more
than a stretch's zone maps, a pack and a block.

Defined cases: rows with a null id, label or vector, or with a null or non-finite
component take no part; shorter vectors are filled up with zeros; equal rows count once,
and of rows with equal ids the one with the smallest label and vector counts; ties in
score go to the smaller id; fewer rows than asked for give fewer; integer components of
2^31 or more raise an error; an empty table gives an empty result. Other columns are not
carried over.
The curve's axes and cuts are fitted on ``SAMPLE`` rows; they only decide which rows share
a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.plans.workdir import materialize, ship_package

AXES, BITS = 8, 8
BLOCK = 256          # rows of a block
SPAN = 64            # blocks of a stretch, about: a stretch is what one task sorts
PACK = 256           # anchors that travel together
SAMPLE = 8192        # rows that the curve is fitted on
POSITIVES, NEGATIVES = 5, 3
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of cells (rows by axes, each below 2^bits), as longs.

    Gray decoding of the transposed index, bit by bit from the largest cube down.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swapped = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swapped)
            if i:
                x[i] ^= swapped
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> b) & 1).astype(np.uint64)
    # As signed longs in the same order.
    return (key ^ np.uint64(1 << 63)).view(np.int64) if n * bits == 64 else key.view(np.int64)


def integer_rows(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 label: Column | None = None, scale: int = 256) -> DataFrame:
    """(id, label, vector): usable rows with components floor(scale * x)."""
    rows = rows.select(F.col(id_col).cast("long").alias("id"), (F.col("label") if label is None else label)
                       .cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~odd)
    return rows.select("id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("vector"))


def _once(rows: DataFrame) -> DataFrame:
    """One row per id; vectors only move if some id is there twice."""
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.*")


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.values.to_numpy(zero_copy_only=False)[vectors.offsets[0].as_py():vectors.offsets[-1].as_py()]
    if (sizes == dims).all():
        return values.reshape(-1, dims).astype(np.float64)
    out = np.zeros((len(sizes), dims))
    for i, part in enumerate(np.split(values, np.cumsum(sizes)[:-1])):
        out[i, :len(part)] = part
    return out


def _curve(rows: DataFrame, dims: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """The axes that vary most, and cuts of equal width on each, by a sample of at most ``sample`` rows.

    Cuts of equal depth would spread the noise of a cluster over most of the cells.
    """
    drawn = rows.orderBy(F.xxhash64("id")).limit(sample).select("vector").toArrow()["vector"].combine_chunks()
    x = _matrix(drawn, dims) if len(drawn) else np.zeros((1, dims))
    axes = np.argsort(-x.var(axis=0), kind="stable")[:AXES]
    return axes, np.linspace(x[:, axes].min(axis=0), x[:, axes].max(axis=0), (1 << BITS) + 1)[1:-1]


def _blocks(rows: DataFrame, dims: int, block: int, stretches: int, sample: int, asks: Column) -> DataFrame:
    """(stretch, block, ids, labels, asks, vectors, low, high, kinds), a row per block."""
    axes, cuts = _curve(rows, dims, sample)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), dims)[:, axes]
            cells = np.stack([np.searchsorted(cuts[:, a], x[:, a], "right") for a in range(len(axes))], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(cells))],
                                             [*batch.schema.names, "key"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, number, part = [], 0, 0, None

        def flush(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            x = _matrix(rows["vector"].combine_chunks(), dims)
            if np.abs(x).max(initial=0) >= 2**31:
                raise ValueError("components of 2^31 or more are not supported")
            x = x.astype("<i4")
            labels = rows["label"].to_numpy()
            number += 1
            row = {"stretch": part, "block": number, "ids": rows["id"].to_numpy().astype("<i8").tobytes(),
                   "labels": labels.astype("<i8").tobytes(), "asks": rows["asks"].to_numpy().astype(np.uint8).tobytes(),
                   "vectors": x.tobytes(), "low": x.min(axis=0).tobytes(), "high": x.max(axis=0).tobytes(),
                   "kinds": np.unique(labels).astype("<i8").tobytes()}
            return pa.RecordBatch.from_pylist([row], pa.schema(
                [("stretch", pa.int64()), ("block", pa.int32())] + [(c, pa.binary()) for c in list(row)[2:]]))

        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                held.append(batch)
                count += batch.num_rows
            while count >= block:
                table = pa.Table.from_batches(held)
                yield flush(table.slice(0, block))
                held, count = table.slice(block).to_batches(), count - block
        if count:
            yield flush(pa.Table.from_batches(held))

    along = rows.withColumn("asks", F.coalesce(asks, F.lit(False))).mapInArrow(
        keyed, "id long, label long, vector array<long>, asks boolean, key long")
    along = (along.repartitionByRange(stretches, "key", "id").sortWithinPartitions("key", "id")
             .withColumn("part", F.spark_partition_id().cast("long")))
    return materialize(along.mapInArrow(
        packed, "stretch long, block int, ids binary, labels binary, asks binary, vectors binary, low binary, "
                "high binary, kinds binary"), "negative-blocks")


def _long(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _ints(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, "<i4").reshape(-1, dims)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as longs."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise ValueError("scores of 2^63 or more are not supported")


def score_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest inner product that a row between ``low`` and ``high`` can have."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


def _anchors(blocks: DataFrame, dims: int) -> DataFrame:
    """(home, chunk, id, label, vector) of the rows that ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(r["asks"], np.uint8))
                x = _ints(r["vectors"], dims)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["stretch"]] * len(at), pa.int64()), pa.array(_long(r["ids"])[at]),
                     pa.array(_long(r["labels"])[at]), pa.array([v.tobytes() for v in x], pa.binary())],
                    ["home", "id", "label", "vector"])

    rows = blocks.select("stretch", "ids", "labels", "asks", "vectors").mapInArrow(
        run, "home long, id long, label long, vector binary")
    # At most the rows of a stretch are numbered together.
    place = F.row_number().over(Window.partitionBy("home").orderBy("id"))
    return rows.withColumn("chunk", F.floor((place - 1) / PACK).cast("int"))


def _packs(asks: DataFrame) -> DataFrame:
    """Packs of asks (id, label, vector, windows): windows are (name, low, high) of scores."""
    return asks.groupBy("home", "chunk").agg(F.collect_list(F.struct("id", "label", "vector", "windows")).alias("asks"))


_ASKS = "array<struct<id:long,label:long,vector:binary,windows:array<struct<name:long,low:long,high:long>>>>"
_WINDOW = pa.struct([("name", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
_ASK = pa.struct([("id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary()), ("windows", pa.list_(_WINDOW))])


def _chosen(packs: DataFrame, zones: DataFrame, dims: int, same: bool) -> DataFrame:
    """(stretch, block, asks): for each pack and block, the asks that have to read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                asks, zones = r["asks"], r["zones"]
                anchors = np.concatenate([_ints(a["vector"], dims) for a in asks])
                low, high = (np.concatenate([_ints(z[c], dims) for z in zones]) for c in ("low", "high"))
                least, most = score_bounds(anchors, low, high)
                kinds = [_long(z["kinds"]) for z in zones]
                starts = np.cumsum([0] + [len(k) for k in kinds[:-1]])
                equal = np.concatenate(kinds) == np.array([a["label"] for a in asks])[:, None]
                need = np.logical_or.reduceat(equal if same else ~equal, starts, axis=1)
                for i, a in enumerate(asks):
                    at_least = np.array([w["low"] for w in a["windows"]])[:, None]
                    at_most = np.array([w["high"] for w in a["windows"]])[:, None]
                    need[i] &= ((at_least <= most[i]) & (at_most >= least[i])).any(axis=0)
                rows = [{"stretch": r["stretch"], "block": z["block"], "asks": [a for a, n in zip(asks, need[:, j]) if n]}
                        for j, z in enumerate(zones) if need[:, j].any()]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(
                        [("stretch", pa.int64()), ("block", pa.int32()), ("asks", pa.list_(_ASK))]))

    return packs.join(zones, "stretch").select("stretch", "asks", "zones").mapInArrow(
        run, f"stretch long, block int, asks {_ASKS}")


def _best_read(chosen: DataFrame, blocks: DataFrame, dims: int, k: int, same: bool) -> DataFrame:
    """(anchor, name, id, score): the best k rows of each block in each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, labels = _long(r["ids"]), _long(r["labels"])
                asks = r["asks"]
                scores = product(np.concatenate([_ints(a["vector"], dims) for a in asks]), _ints(r["vectors"], dims))
                out = []
                for a, s in zip(asks, scores):
                    counts = (labels == a["label"]) & (ids != a["id"]) if same else labels != a["label"]
                    for w in a["windows"]:
                        at = np.flatnonzero(counts & (s >= w["low"]) & (s <= w["high"]))
                        at = at[np.lexsort((ids[at], -s[at]))[:k]]
                        out += [(a["id"], w["name"], i, v) for i, v in zip(ids[at].tolist(), s[at].tolist())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                     ["anchor", "name", "id", "score"])

    read = blocks.select("stretch", "block", "ids", "labels", "vectors")
    return chosen.join(read, ["stretch", "block"]).select("asks", "ids", "labels", "vectors").mapInArrow(
        run, "anchor long, name long, id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("anchor", "name").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _searched(asks: DataFrame, blocks: DataFrame, zones: DataFrame, stretches: int, dims: int, k: int,
              same: bool) -> DataFrame:
    """(anchor, name, id, score, rank): the best k rows in each window of each ask.

    Stretches are numbered from 0 to ``stretches`` - 1; some may be empty.
    """
    near = _packs(asks).withColumn("stretch", F.col("home"))
    first = materialize(_best_read(_chosen(near, zones, dims, same), blocks, dims, k, same), "negative-near")
    # The k-th score found so far: whatever else counts is as high.
    floor = (_first(first, k).where(F.col("rank") == k)
             .select(F.col("anchor").alias("id"), F.struct(F.col("name"), F.col("score")).alias("f"))
             .groupBy("id").agg(F.map_from_entries(F.collect_list("f")).alias("floors")))
    raised = F.transform("windows", lambda w: F.struct(
        w["name"].alias("name"), F.greatest(w["low"], F.try_element_at("floors", w["name"])).alias("low"),
        w["high"].alias("high")))
    asks = asks.join(floor, "id", "left").withColumn("windows", raised)
    far = _packs(asks).withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stretches - 1).cast("long"))))
    far = far.where("stretch <> home")
    rest = materialize(_best_read(_chosen(far, zones, dims, same), blocks, dims, k, same), "negative-far")
    return _first(first.unionByName(rest), k)


def _floor(x: Column, by: int) -> Column:
    by = F.lit(by).cast("long")
    return F.call_function("div", x - F.pmod(x, by), by)


def mine_negatives(rows: DataFrame, asks: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), block: int = BLOCK,
                   sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` are (id, label, vector) of integers, ``asks`` tells the anchors. The negatives of
    a positive are the best rows of other labels whose scores lie between the shares
    ``low`` and ``high`` of the positive's score.
    """
    ship_package(rows.sparkSession)
    rows = materialize(_once(rows.select("id", "label", "vector")), "negative-rows")
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    dims, stretches = max(1, dims or 1), max(1, -(-n // (block * SPAN)))
    blocks = _blocks(rows, dims, block, stretches, sample, asks)
    zones = materialize(blocks.groupBy("stretch").agg(
        F.sort_array(F.collect_list(F.struct("block", "low", "high", "kinds"))).alias("zones")), "negative-zones")
    anchors = materialize(_anchors(blocks, dims), "negative-anchors")

    def window(name, at_least, at_most) -> Column:
        return F.struct(F.lit(name).cast("long").alias("name"), at_least.cast("long").alias("low"),
                        at_most.cast("long").alias("high"))

    everything = anchors.withColumn("windows", F.array(window(0, F.lit(LOWEST), F.lit(HIGHEST))))
    best = materialize(_searched(everything, blocks, zones, stretches, dims, positives, True)
                       .select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
                       "negative-positives")
    # Whole scores between the two shares: rounded up, and rounded down.
    first = -_floor(-low[0] * F.col("positive_score"), low[1])
    last = _floor(high[0] * F.col("positive_score"), high[1])
    windows = best.select(F.col("anchor").alias("id"), window(F.col("positive_id"), first, last).alias("w")).where(
        "w.low <= w.high").groupBy("id").agg(F.collect_list("w").alias("windows"))
    found = _searched(anchors.join(windows, "id"), blocks, zones, stretches, dims, negatives, False)
    return found.join(best, (found["anchor"] == best["anchor"]) & (found["name"] == best["positive_id"])).select(
        found["anchor"].alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))

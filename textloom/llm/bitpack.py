"""Token ids in files of fixed bit width, with block offsets for random access.

A shard file is, little-endian: the magic, the bit width, the ids in a block, the number
of blocks and ids, one 64-bit offset for each block (from the file's start, and the end),
then the blocks. A block packs its ids with the lowest bit first and is padded to a
whole byte, so that block b and any id in it are found without reading the rest.

Documents are dealt out by ranges of their ids and written in ascending order, several
shards for each range; which documents a shard holds is in its row of the manifest, a
Parquet table that only lists shards of tasks that were committed.

Defined cases: null and empty texts hold the end id only; null ids come first; rows with
equal ids are ordered by a hash of their text, equal rows follow each other; an empty
table gives no shard and no row. Other columns are not carried over.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.columns import as_text
from textloom.llm.vocab import WordIds, chunks, library, packed
from textloom.plans.workdir import materialize, new_path, ship_package

MAGIC = b"TLBITS01"
BLOCK_IDS = 1 << 16
SHARD_IDS = 1 << 23
KEPT_PIECES = 200_000


def bits_for(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The lowest ``bits`` bits of each id, one after the other."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(planes[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype("<u4")
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, :bits] = planes
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").reshape(-1)


def file_bytes(ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> list[bytes]:
    """The parts of a shard file."""
    blocks = [pack(ids[i:i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    head = MAGIC + np.array([bits, block_ids, len(blocks), len(ids)], "<u8").tobytes()
    offsets = len(head) + 8 * (len(blocks) + 1) + np.cumsum([0, *map(len, blocks)])
    return [head, offsets.astype("<u8").tobytes(), *blocks]


class Shard:
    """Random access to the ids of a file."""

    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        head = self.file.read_at(40, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is not a shard of packed ids")
        self.bits, self.block_ids, blocks, self.n_ids = map(int, np.frombuffer(head, "<u8", 4, 8))
        self.offsets = np.frombuffer(self.file.read_at(8 * (blocks + 1), 40), "<u8").astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to before ``stop``; reads the blocks that hold them."""
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        base, parts = int(self.offsets[first]), []
        for b in range(first, last + 1):
            n = min(self.block_ids, self.n_ids - b * self.block_ids)
            parts.append(unpack(data[int(self.offsets[b]) - base:int(self.offsets[b + 1]) - base], n, self.bits))
        return np.concatenate(parts)[start - first * self.block_ids:stop - first * self.block_ids]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordIds:
    tokenize, known = library(path).model.tokenize, {}

    def ids(pieces: list[str]) -> bytes:
        if len(known) > KEPT_PIECES:
            known.clear()
        for p in pieces:
            if p not in known:
                known[p] = packed([t.id for t in tokenize(p)])
        return b"".join([known[p] for p in pieces])

    return WordIds(path, ids)


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = 1, id_col: str = "doc_id",
                 text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode and write all documents; the manifest (shard, part, number, ids, docs, lengths).

    ``folder`` is a URI that all executors reach. Names are new for each attempt, so a
    task that is run again never writes over another's file.
    """
    spark = docs.sparkSession
    ship_package(spark)
    bits = bits_for(library(path).get_vocab_size(with_added_tokens=True))
    end = np.array([end_id], "<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        ids, held, number = [], [], 0
        total = 0

        def flush():
            nonlocal ids, held, total, number
            name = f"{uuid.uuid4().hex}.bits"
            with system.open_output_stream(f"{base}/{name}") as out:
                for part in file_bytes(np.frombuffer(b"".join(ids), "<i4"), bits):
                    out.write(part)
            row = pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"]), pa.array([number], pa.int64()), pa.array([total], pa.int64()),
                 pa.array([[i for i, _ in held]], pa.list_(kind)),
                 pa.array([[n for _, n in held]], pa.list_(pa.int64()))],
                ["shard", "number", "ids", "docs", "lengths"])
            ids, held, total, number = [], [], 0, number + 1
            return row

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for start, stop in chunks(batch.column(1)):
                part = batch.slice(start, stop - start)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = words.of(text) + end
                    ids.append(own)
                    held.append((doc, len(own) // 4))
                    total += len(own) // 4
                    if total >= shard_ids:
                        yield flush()
        if held:
            yield flush()

    kind = docs.schema[id_col].dataType.simpleString()
    ordered = (docs.select(F.col(id_col).alias("id"), as_text(text_col).alias("text"))
               .withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie")
               .sortWithinPartitions("id", "tie").select("id", "text"))
    rows = ordered.mapInArrow(
        run, f"shard string, number long, ids long, docs array<{kind}>, lengths array<long>")
    return materialize(rows.withColumn("part", F.spark_partition_id()), "bitpack-manifest")


def read_shards(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of every document, read back from the files.

    Starts are running sums over parts, then over the shards of a part: one row for
    each part and each shard meet, never one for each document.
    """
    spark = manifest.sparkSession
    ship_package(spark)
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("part_ids"))
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(before().orderBy("part")), F.lit(0)).alias("p"))
    placed = manifest.join(parts, "part").withColumn(
        "first", F.col("p") + F.coalesce(F.sum("ids").over(before("part").orderBy("number")), F.lit(0)))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = placed.select("shard", "first", "docs", "lengths").repartition(tasks, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, docs, lengths in zip(*[c.to_pylist() for c in batch.columns]):
                data, offset = Shard(shard), 0
                for at in range(0, len(docs), 512):
                    own = np.array(lengths[at:at + 512], np.int64)
                    ends = np.cumsum(own)
                    ids = data.ids(offset, offset + int(ends[-1]))
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)),
                                                     pa.array(ids.astype("<i4")))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[at:at + 512], batch.schema.field(2).type.value_type),
                         pa.array(first + offset + ends - own), pa.array(own), lists],
                        ["id", "start", "n_tokens", "token_ids"])
                    offset += int(ends[-1])

    kind = manifest.schema["docs"].dataType.elementType.simpleString()
    return (placed.mapInArrow(run, f"id {kind}, start long, n_tokens long, token_ids array<int>")
            .withColumnRenamed("id", id_col))


def with_crc(read: DataFrame) -> DataFrame:
    """Add ids_crc32: of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat, offsets = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.asarray(ids.offsets)
            offsets = offsets - offsets[0]
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())],
                                             [*batch.schema.names[:3], "ids_crc32"])

    names = read.columns
    kind = read.schema[0].dataType.simpleString()
    return read.mapInArrow(run, f"{names[0]} {kind}, start long, n_tokens long, ids_crc32 long")


def write_documents(spark: SparkSession, docs: DataFrame, path: str, **options) -> DataFrame:
    """Write to a new folder of the shared work folder; the manifest."""
    folder = new_path(spark, "bitpack")
    return write_shards(docs, path, folder if "://" in folder or folder.startswith("file:") else f"file://{folder}",
                        **options)

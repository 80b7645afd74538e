"""BPE encoding by forced boundaries, and decoding.

Merges only ever make tokens of the vocabulary. Two neighbouring bytes that stand
together inside no token can thus never be merged over: the place between them is a
certain cut. White space cuts a text into words in that way, and the table of byte
pairs cuts normalised words into fragments; each distinct fragment is encoded on its
own and the ids are put one after the other. A fragment that ends a word carries the
end-of-word mark of the vocabulary, the others are encoded without it.

Defined cases: null and empty texts have no ids and decode to an empty text; equal
rows give equal ids; special tokens in a text are ids of their own, as in the library;
ids outside the vocabulary are left out when decoding; columns of the input other
than the id are not carried over, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.columns import as_text
from textloom.llm.vocab import WordIds, chunks, id_lists, library, packed, vocabulary
from textloom.plans.workdir import ship_package

KEPT_FRAGMENTS = 250_000


def byte_pairs_inside(tokens, suffix: str) -> set[str]:
    """All pairs of neighbouring byte characters inside any token, its end mark aside."""
    pairs = set()
    for token in tokens:
        token = token.removesuffix(suffix) if suffix else token
        pairs.update(map("".join, zip(token, token[1:])))
    return pairs


class ForcedBoundaryEncoder:
    """Ids of pre-tokens; both models have the file's merges, one of them its end-of-word mark."""

    def __init__(self, path: str):
        from tokenizers.models import BPE

        model = vocabulary(path)["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.pairs = byte_pairs_inside(model["vocab"], suffix)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.inner = BPE(model["vocab"], merges)
        self.last = BPE(model["vocab"], merges, end_of_word_suffix=suffix) if suffix else self.inner
        self.inner_ids: dict[str, bytes] = {}
        self.last_ids: dict[str, bytes] = {}

    def cut(self, piece: str) -> list[str]:
        """The fragments of a pre-token in byte characters."""
        pairs = self.pairs
        cuts = [i for i in range(1, len(piece)) if piece[i - 1:i + 1] not in pairs]
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)])] if cuts else [piece]

    @staticmethod
    def _ids(fragment: str, model, known: dict[str, bytes]) -> bytes:
        found = known.get(fragment)
        if found is None:
            if len(known) > KEPT_FRAGMENTS:
                known.clear()
            found = known[fragment] = packed([t.id for t in model.tokenize(fragment)])
        return found

    def ids(self, pieces: list[str]) -> bytes:
        out = []
        for piece in pieces:
            *inner, last = self.cut(piece)
            out += [self._ids(f, self.inner, self.inner_ids) for f in inner]
            out.append(self._ids(last, self.last, self.last_ids))
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordIds:
    return WordIds(path, ForcedBoundaryEncoder(path).ids)


@lru_cache(maxsize=2)
def token_table(path: str) -> np.ndarray:
    """Tokens by id; None where the vocabulary has none."""
    made = library(path)
    ids = made.get_vocab(with_added_tokens=True)
    table = np.full(max(ids.values()) + 1, None, dtype=object)
    for token, i in ids.items():
        table[i] = token
    return table


def _encoded(batch: pa.RecordBatch, path: str) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    words = encoder(path)
    for start, stop in chunks(batch.column(1)):
        part = batch.slice(start, stop - start)
        yield part.column(0), id_lists([words.of(t.as_py()) for t in part.column(1)])


def _decoded(ids: pa.ListArray, path: str) -> pa.Array:
    table, texts = token_table(path), []
    flat, offsets = ids.flatten().to_numpy(zero_copy_only=False), np.asarray(ids.offsets)
    offsets = offsets - offsets[0]
    for a, b in zip(offsets, offsets[1:]):
        own = flat[a:b]
        texts.append(" ".join([t for t in table[own[(own >= 0) & (own < len(table))]] if t is not None]))
    return pa.array(texts, pa.string())


def _check_decoder(path: str) -> None:
    if vocabulary(path)["decoder"] is not None:
        raise ValueError(f"{path} has a decoder of its own")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each whole text, an array of ints."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, ids in _encoded(batch, path):
                yield pa.RecordBatch.from_arrays([keys, ids], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), as_text(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded): tokens by id, joined as a vocabulary without a decoder joins them."""
    _check_decoder(path)
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(part.column(1), path)],
                                                 ["id", "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return (encoded.select(F.col(id_col).alias("id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
            .mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): ``decode`` of ``encode``, in one pass through Python."""
    _check_decoder(path)
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, ids in _encoded(batch, path):
                yield pa.RecordBatch.from_arrays([keys, ids, _decoded(ids, path)], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), as_text(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col))


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded texts."""
    return decoded.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))

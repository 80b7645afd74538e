"""Grouping the tokens of documents by term, a batch of documents at a time.

The function runs in Spark tasks over Arrow batches. It sees whole documents, so
it needs no shuffle; it works on arrays and has no loop over rows or tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .porter import stem_word

# Tokens that are grouped at once. A batch of long documents has many more, and the arrays
# take some 100 bytes for each.
MOST_TOKENS = 1 << 16


def _vocabulary(tokens: pa.Array, stem: bool) -> tuple[np.ndarray, pa.Array]:
    """A number for every token, and the terms these numbers stand for."""
    encoded = tokens.dictionary_encode()
    codes, terms = encoded.indices.to_numpy(), encoded.dictionary
    if stem:
        stems = pa.array([stem_word(t) for t in terms.to_pylist()], pa.string()).dictionary_encode()
        codes, terms = stems.indices.to_numpy()[codes], stems.dictionary
    return codes, terms


def group_tokens(batch: pa.RecordBatch, stem: bool, positions: bool) -> pa.RecordBatch:
    """``term, tf, doc_len, [positions]`` and the other columns of the batch."""
    tokens = batch.column("tokens")
    lengths = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    codes, terms = _vocabulary(tokens.flatten(), stem)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # Documents ascend already; a stable sort keeps the places of a term in order. Rows of a
    # term come together, as like rows are stored and shuffled in less space.
    key = codes.astype(np.int64) * max(len(lengths), 1) + doc
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    bounds = np.append(starts, len(key))
    heads = order[starts]
    columns = {
        "term": terms.take(pa.array(codes[heads])),
        "tf": pa.array(np.diff(bounds).astype(np.int32)),
        "doc_len": pa.array(lengths[doc[heads]].astype(np.int32)),
    }
    if positions:
        columns["positions"] = pa.ListArray.from_arrays(
            pa.array(bounds.astype(np.int32)), pa.array(place[order].astype(np.int32)))
    rows = pa.array(doc[heads])
    for name in batch.schema.names:
        if name != "tokens":
            columns[name] = batch.column(name).take(rows)
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def slices(batch: pa.RecordBatch, most: int = MOST_TOKENS) -> Iterator[pa.RecordBatch]:
    """The documents of a batch, so many at a time that they have ``most`` tokens, or one."""
    lengths = pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(lengths), 0
    while start < len(lengths):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def grouper(stem: bool, positions: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        while (batch := next(batches, None)) is not None:
            for part in slices(batch):
                yield group_tokens(part, stem, positions)
            # Freed before the next one is read: workers live on between tasks, with what they hold.
            batch = part = None
            pa.default_memory_pool().release_unused()
    return run

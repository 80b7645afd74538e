"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

A code is cut into segments. If two codes differ in at most r bits, then they differ in at most
r // m bits of one of the m segments. So a search looks up growing radii in one segment
after the other: when all segments were searched to radius s and the first j to s + 1,
every code within m * (s + 1) + j - 1 bits was seen, and the search ends as soon as
the k-th verified distance is no larger than that.

Rows are dealt by hash over shards of ``SHARD`` codes and queries over blocks of
``BLOCK``; each shard meets each block once, in a task of its own, and hands on k rows for a
query. Equal codes fall to different shards, so that a very common one makes no hot task.

Defined cases: codes of null or empty vectors are left out, as rows and as queries; null ids
are left out; ties in distance go to the smaller id; a row is its own neighbour;
repeated rows (id and code) count once; fewer than k rows give fewer neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.workdir import materialize, ship_package

SEGMENT_BITS = 16
SHARD = 1 << 14
BLOCK = 1 << 9


def sign_code(vector: str, bits: int = 64) -> Column:
    """64 signs of a vector as a long: bit i is set where component i is above 0."""
    one = F.lit(1).cast("long")
    parts = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.when(
        F.get(F.col(vector), i) > 0, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(parts, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vector) > 0, code)


class SegmentIndex:
    """The codes of a shard, by the value of each segment."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, bits: int = 64):
        self.ids, self.codes, self.m = ids, codes, bits // SEGMENT_BITS
        self.orders, self.starts = [], []
        for s in range(self.m):
            value = self.segment(codes, s)
            self.orders.append(np.argsort(value, kind="stable"))
            self.starts.append(np.r_[0, np.cumsum(np.bincount(value, minlength=1 << SEGMENT_BITS))])
        self.masks = [np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT_BITS), r)], np.int64)
                      for r in range(SEGMENT_BITS + 1)]

    @staticmethod
    def segment(codes, s: int):
        return ((codes >> np.uint64(SEGMENT_BITS * s)) & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.int64)

    def bucket(self, s: int, value: int, radius: int) -> np.ndarray:
        """Rows whose segment differs from ``value`` in exactly ``radius`` bits."""
        values = value ^ self.masks[radius]
        low, high = self.starts[s][values], self.starts[s][values + 1]
        full = high > low
        low, n = low[full], (high - low)[full]
        if not len(n):
            return np.zeros(0, np.int64)
        at = np.arange(n.sum()) + np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n)
        return self.orders[s][at]

    def search(self, code: np.uint64, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k nearest: rows, distances, and how many codes were verified."""
        seen = np.zeros(len(self.ids), bool)
        rows, distances = np.zeros(0, np.int64), np.zeros(0, np.int64)
        verified = 0
        for radius in range(SEGMENT_BITS + 1):
            for s in range(self.m):
                found = self.bucket(s, int(self.segment(code, s)), radius)
                found = found[~seen[found]]
                if len(found):
                    seen[found] = True
                    verified += len(found)
                    rows = np.r_[rows, found]
                    distances = np.r_[distances, np.bitwise_count(self.codes[found] ^ code).astype(np.int64)]
                    if len(rows) > k:
                        best = np.lexsort((self.ids[rows], distances))[:k]
                        rows, distances = rows[best], distances[best]
                covered = self.m * radius + s
                if len(rows) == min(k, len(self.ids)) and (not len(rows) or distances.max() <= covered):
                    best = np.lexsort((self.ids[rows], distances))
                    return rows[best], distances[best], verified
        best = np.lexsort((self.ids[rows], distances))
        return rows[best], distances[best], verified


def nearest_codes(rows: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD,
                  block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, distance) for ``queries`` (id, code) in ``rows`` (id, code), exactly."""
    ship_package(rows.sparkSession)
    usable = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("code").cast("long").alias("code")).where(
        "id is not null and code is not null").distinct()
    rows = materialize(usable(rows), "codes")
    queries = materialize(usable(queries), "query-codes")
    n_rows, n_queries = rows.count(), queries.count()
    shards, blocks = max(1, -(-n_rows // shard)), max(1, -(-n_queries // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n, salt: F.pmod(F.xxhash64("id", "code", F.lit(salt)), F.lit(n)).cast("int")
    # What each task gets: a shard and a block.
    held = rows.select("id", "code", part(shards, 1).alias("shard"), every(blocks).alias("block"))
    asked = queries.select("id", "code", every(shards).alias("shard"), part(blocks, 2).alias("block"))

    def run(stored: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(stored) or not len(wanted):
            return pd.DataFrame({"query_id": [], "id": [], "distance": [], "code": []}, dtype="int64")
        index = SegmentIndex(stored["id"].to_numpy(), stored["code"].to_numpy().view(np.uint64))
        out = []
        for q, c in zip(wanted["id"].to_numpy(), wanted["code"].to_numpy().view(np.uint64)):
            found, distances, _ = index.search(c, k)
            out.append(np.c_[np.full(len(found), q), index.ids[found], distances, np.full(len(found), c.view(np.int64))])
        return pd.DataFrame(np.concatenate(out), columns=["query_id", "id", "distance", "code"])

    found = (held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
             .applyInPandas(run, "query_id long, id long, distance long, code long"))
    best = Window.partitionBy("query_id", "code").orderBy("distance", "id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("long").alias("rank"), "id", "distance"))

import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import negatives as N

SCHEMA = "vec_id long, embedding array<double>, label int, extra string"


def brute(rows, anchors, positives=5, negatives=3):
    """``rows`` {id: (label, vector)} by all pairs."""
    out = []
    for a in anchors:
        score = lambda i: sum(x * y for x, y in zip(rows[a][1], rows[i][1]))
        order = sorted((i for i in rows if i != a), key=lambda i: (-score(i), i))
        for p in [i for i in order if rows[i][0] == rows[a][0]][:positives]:
            s = score(p)
            window = [i for i in order if rows[i][0] != rows[a][0] and 50 * s <= 100 * score(i) <= 95 * s]
            out += [(a, p, k + 1, i, s, score(i)) for k, i in enumerate(window[:negatives])]
    return sorted(out)


def clean(table):
    rows = {}
    for i, v, label, _ in table:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(256 * x) for x in v])
        rows[i] = min(rows.get(i, row), row)
    return rows


@pytest.mark.parametrize("seed, block", [(1, 4), (2, 16), (3, 256)])
def test_equals_all_pairs(spark, seed, block):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    table = []
    for i in range(500):
        c = centres[0] if rnd.random() < 0.4 else rnd.choice(centres)
        spread = rnd.choice([0.0, 0.1, 0.5])
        table.append((i - 50, [x + rnd.gauss(0, spread) for x in c], rnd.choice([0, 0, 1, 2]), "x"))
    table += [(1000, None, 1, "x"), (1001, [float("nan")] * 12, 1, "x"), (1050, [1.0, None] + [0.0] * 10, 0, "x"),
              (None, centres[1], 0, "x"), (1100, centres[2], None, "x"), (1150, [float("inf")] + [0.0] * 11, 0, "x"),
              table[3], (7, [5.0] * 12, 2, "x"), (1200, [0.5, -0.5], 1, "x"), (1250, [], 0, "x"), (1300, [0.0] * 12, 5, "x")]
    frame = spark.createDataFrame(table, SCHEMA)
    got = N.mine_negatives(N.integer_rows(frame), F.col("id") % 50 == 0, block=block)
    rows = clean(table)
    expected = brute(rows, [i for i in rows if i % 50 == 0])
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 50


def test_bounds_hold_and_keys_follow_the_curve():
    rng = np.random.default_rng(5)
    x, a = rng.integers(-300, 300, (64, 9)), rng.integers(-300, 300, (20, 9))
    low, high = N.score_bounds(a, x.min(axis=0)[None], x.max(axis=0)[None])
    scores = N.product(a, x)
    assert (low[:, 0] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= high[:, 0]).all()
    for axes, bits in ((2, 4), (3, 3)):
        cells = np.array(list(product(range(1 << bits), repeat=axes)))
        keys = N.hilbert_keys(cells, bits)
        assert len(set(keys.tolist())) == len(cells)
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
    large = np.array([[2**30, -2**30, 3]])
    assert N.product(large, large)[0, 0] == 2 * 2**60 + 9


def test_blocks_are_left_out(spark):
    """Anchors read the blocks that can matter to them only."""
    rnd = random.Random(9)
    table = [(i, [(1.0 if k == i % 8 else 0.0) + rnd.gauss(0, 0.01) for k in range(8)], i % 2, "x") for i in range(4000)]
    rows = N.materialize(N.integer_rows(spark.createDataFrame(table, SCHEMA)), "rows")
    blocks = N._blocks(rows, 8, 16, 4, 1000, F.col("id") % 50 == 0)
    zones = blocks.groupBy("stretch").agg(F.sort_array(F.collect_list(F.struct("block", "low", "high", "kinds"))).alias("zones"))
    anchors = N._anchors(blocks, 8)
    asks = anchors.withColumn("windows", F.array(F.struct(F.lit(0).cast("long").alias("name"), F.lit(40_000).cast("long").alias("low"),
                                                          F.lit(1 << 40).cast("long").alias("high"))))
    packs = N._packs(asks).withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    chosen = N._chosen(packs, zones, 8, True).select(F.sum(F.size("asks"))).first()[0]
    assert 0 < chosen < 0.3 * 80 * blocks.count()


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert N.mine_negatives(N.integer_rows(none), F.col("id") % 50 == 0).isEmpty()
    one = spark.createDataFrame([(50, [1.0], 1, "x")], SCHEMA)
    assert N.mine_negatives(N.integer_rows(one), F.col("id") % 50 == 0).isEmpty()

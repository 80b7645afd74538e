"""Connected components of a table of links, by alternating large and small stars.

Every round points the larger neighbours of each node at its smallest one, then the
smaller ones too. What moves is the links; the smallest neighbour of a node is summed
before its shuffle, so a node with very many links makes no large group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.workdir import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return (moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of every node in a link (u, v) of longs; the label is the smallest node.

    Ends when a round changes nothing; an error says so if ``rounds`` are not enough.
    """
    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .where("u <> v").distinct(), "links")
    mark = None
    for _ in range(rounds):
        edges = materialize(_small_star(_large_star(edges)), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return (edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
                    .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct())
        mark = now
    raise RuntimeError(f"the components are not found after {rounds} rounds")

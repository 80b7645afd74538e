"""Mixing sources to target weights by capped water-filling, native columns only.

``plan_mix`` reads all rows once and keeps sums for each (source, hash bucket); from
those come the targets and, for each source, how many whole repetitions its documents
get and which buckets get one more. ``mixed`` reads the rows again and applies that.
No row is shuffled: what moves is one sum for each source, bucket and task.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a
source of its own; rows that are equal in id and text share a bucket and so are
treated alike; an empty table gives an empty mix; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.columns import WORD, as_text
from textloom.plans.workdir import materialize

BUCKET_DIGITS = 3  # hex digits: 4,096 buckets, so a source's mix is off by 1/8,192 of it at most


def size_of(text_col: str = "text") -> Column:
    return F.regexp_count(as_text(text_col), F.lit(WORD)).cast("long")


def bucket_of(seed: int, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A row's place in the seeded order of its source, as hex digits."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                   F.lit(":"), as_text(text_col))
    return F.substring(F.md5(key), 1, BUCKET_DIGITS)


def cycled_weights(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """Weights dealt out by the sources' code-point order, null last; one row per source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), rank % len(weights) + 1)
    return sources.withColumn("weight", weight)


def water_fill(sources: DataFrame, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Add ``target`` to rows of (source, source_size, weight).

    All targets sum to ``share`` of all sizes where the caps allow it. A source that
    would exceed ``max_epochs`` of its size is clamped there and the excess goes to the
    others by weight, until none is above. In the order of cap / weight the clamped
    sources come first, so one running sum finds the level of the rest: the first
    source whose level, if it and all later ones share what the earlier ones leave,
    is no higher than its own cap / weight.
    """
    filled = sources.where("source_size > 0 and weight > 0").withColumn(
        "cap", F.col("source_size") * max_epochs)
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    wanted = F.sum("source_size").over(everything) * share
    level = ((wanted - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / F.sum("weight").over(onward))
    filled = filled.withColumn("level", level).withColumn("ratio", F.col("cap") / F.col("weight"))
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))
    filled = filled.withColumn("found", F.min(fits).over(everything)["level"])
    target = F.when(F.col("found").isNull(), F.col("cap")).otherwise(
        F.least("cap", F.col("weight") * F.col("found")))
    rest = sources.where("not (source_size > 0 and weight > 0)")
    return (filled.withColumn("target", target).drop("cap", "level", "ratio", "found")
            .unionByName(rest.withColumn("target", F.lit(0.0))))


def plan_mix(docs: DataFrame, weigh=cycled_weights, share: float = 1.5, max_epochs: float = 2.0,
             seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> DataFrame:
    """One row per source: source_size, weight, target, whole repetitions, last bucket of one more.

    ``weigh`` adds ``weight`` to rows of (source, source_size). The fractional
    repetition takes buckets in order until the sum is nearest to what is missing.
    """
    sums = (docs.select(F.col(source_col).alias("source"), bucket_of(seed, id_col, text_col).alias("bucket"),
                        size_of(text_col).alias("size"))
            .groupBy("source", "bucket").agg(F.sum("size").alias("size")))
    # A source has 4,096 rows at most: one file, not one of each task that sums.
    parts = materialize(sums.repartition("source"), "mix-parts")
    sources = parts.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(water_fill(weigh(sources), share, max_epochs), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("whole", whole.cast("long"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    t = targets.withColumnRenamed("source", "t_source")
    reached = parts.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
    missing = F.col("target") - F.col("whole") * F.col("source_size")
    cuts = (reached.join(t, F.col("source").eqNullSafe(F.col("t_source")))
            .where(F.col("before") + F.col("size") / 2 < missing)
            .groupBy("source").agg(F.max("bucket").alias("cut")))
    cuts = cuts.withColumnRenamed("source", "c_source")
    plan = targets.join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source")
    return materialize(plan, "mix-plan")


def mixed(docs: DataFrame, plan: DataFrame, seed: int = 17, id_col: str = "doc_id",
          text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every input row as ``row``, with its size, its source's size and target, and repetitions.

    The plan has one row per source; its measured size decides whether it is broadcast.
    """
    p = plan.select(F.col("source").alias("p_source"), "source_size", "target", "whole", "cut")
    sized = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("m_source"),
                        size_of(text_col).alias("size"), bucket_of(seed, id_col, text_col).alias("bucket"))
    more = F.when(F.col("bucket") <= F.col("cut"), 1).otherwise(0)
    times = F.when(F.col("size") > 0, F.col("whole") + more).otherwise(0).cast("long")
    return (sized.join(p, F.col("m_source").eqNullSafe(F.col("p_source")))
            .select("row", "size", "source_size", "target", times.alias("repetitions")))


def repeated(mix: DataFrame) -> DataFrame:
    """The rows of a mix, each as often as it is repeated."""
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("repetitions")))
    return mix.where("repetitions > 0").select("row", copies.alias("copy")).select("row.*")

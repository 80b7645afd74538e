"""Chat formatting of preferences: one prompt and two masked completions for a pair.

Chosen and rejected conversations come as rows of (pair, turn, role, text). The longest
common turn prefix is the prompt, rendered once; what follows it on each side is a
completion, with the spans of it that are trained on: text and end mark of the turns of
an assistant. All else is masked.

The prefix ends at the smallest turn number at which the sides differ. That is a minimum
over hashes of turns, so no text moves for it; texts are shuffled once, to the row
that they are rendered in. A row holds ``2 ** PART_BITS`` turn numbers of a pair: a
longer conversation has several rows, numbered by ``part``, and no task needs to hold it whole.

Defined cases: a null turn number comes before all others; null roles and texts are empty; several
different turns of one number follow each other by role and text, and are common if both
sides have the same ones; equal rows of a side count once; a conversation that
is missing on one side gives no prompt and an empty completion there; if both are
equal, all is prompt; null pairs are left out; other columns are not carried over.
Turns are compared by 96 bits of hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEAD, END = "<|im_start|>", "<|im_end|>\n"
PART_BITS = 10         # turn numbers of a row differ in so many bits only


def _turns(side: DataFrame, bit: int) -> DataFrame:
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63)))
    return side.where("pair_id is not null").select(
        "pair_id", turn.alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.lit(bit).alias("side"))


def _splits(turns: DataFrame, part: Column) -> DataFrame:
    """(pair_id, part, split): the first turn number at which the sides of a pair differ, or null."""
    content = F.struct(F.xxhash64("role", "text"), F.hash("text", "role")).alias("content")
    sides = turns.select("pair_id", "turn", content, "side").groupBy("pair_id", "turn", "content").agg(
        F.bit_or("side").alias("sides"))
    parts = sides.groupBy("pair_id", part.alias("part")).agg(
        F.min(F.when(F.col("sides") != 3, F.col("turn"))).alias("split"))
    return parts.withColumn("split", F.min("split").over(Window.partitionBy("pair_id")))


def _text(turns: str) -> Column:
    head = F.lit(HEAD)
    return F.array_join(F.transform(turns, lambda t: F.concat(
        head, t["role"], F.lit("\n"), t["text"], F.lit(END))), "")


def _spans(turns: str) -> Column:
    """[start, end) in characters of what is trained on."""
    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["role"]) + len(HEAD) + 1
        end = start + F.length(t["text"]) + len(END.strip())
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct((end + 1).cast("long").alias("at"), F.when(
            t["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    empty = F.struct(F.lit(0).cast("long").alias("at"),
                     F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    return F.aggregate(turns, empty, step)["spans"]


def format_preferences(chosen: DataFrame, rejected: DataFrame, part_bits: int = PART_BITS) -> DataFrame:
    """(pair_id, part, prompt, chosen, rejected, chosen_spans, rejected_spans), one row a pair.

    Of conversations beyond ``2 ** part_bits`` turns, one row for each part, whose spans
    are places in its own completions; the texts of parts follow each other by ``part``.
    """
    turns = _turns(chosen, 1).unionByName(_turns(rejected, 2))
    part = F.shiftright("turn", part_bits)
    told = turns.select("pair_id", part.alias("part"), F.struct("turn", "role", "text", "side").alias("t"),
                        F.lit(None).cast("long").alias("split"))
    rows = told.unionByName(_splits(turns, part).select("pair_id", "part", "split"), allowMissingColumns=True)
    # The first difference goes to each row as one more member of its group: no join moves the texts again.
    pairs = rows.groupBy("pair_id", "part").agg(F.array_sort(F.collect_list("t")).alias("turns"),
                                                F.min("split").alias("split"))

    def some(condition) -> Column:
        return F.array_distinct(F.transform(F.filter("turns", condition), lambda t: F.struct(
            t["role"].alias("role"), t["text"].alias("text"), t["turn"].alias("turn"))))

    split = F.col("split")
    lists = pairs.select(
        "pair_id", "part", some(lambda t: split.isNull() | (t["turn"] < split)).alias("prompt"),
        some(lambda t: (t["turn"] >= split) & (t["side"] == 1)).alias("chosen"),
        some(lambda t: (t["turn"] >= split) & (t["side"] == 2)).alias("rejected"))
    return lists.select("pair_id", "part", *[_text(p).alias(p) for p in ("prompt", "chosen", "rejected")],
                        *[_spans(p).alias(f"{p}_spans") for p in ("chosen", "rejected")])

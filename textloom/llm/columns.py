"""Columns that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.plans.workdir import materialize

# Words are what stands between the white space of ASCII.
WORD = r"[^\x20\x09-\x0D]+"

# Bits that tell which keys are wanted, by maps of as many as Spark's bitmaps have: 16 MB at most.
KEY_BITS, MAP_BITS = 27, 15


def as_text(column: str) -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; all other characters as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def row_key(*columns: str) -> Column:
    """A long that names a row by its content, null ids included."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns])


def marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``marked``: true for every ``key`` that is among ``keys``, and for few others.

    What is broadcast has a fixed bound, so that the plan is the same at all sizes and
    rows of other keys never need to move. ``key`` is a hash.
    """
    number = F.pmod("key", F.lit(1 << KEY_BITS))
    place, of_map = number.bitwiseAND(F.lit((1 << MAP_BITS) - 1)), F.shiftright(number, MAP_BITS)
    maps = keys.select(of_map.alias("m_map"), place.alias("place")).groupBy("m_map").agg(
        F.bitmap_construct_agg("place").alias("m_bits"))
    maps = F.broadcast(materialize(maps, "key-maps"))
    byte = F.conv(F.hex(F.col("m_bits").substr(F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    bit = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(7)).cast("int")))
    found = rows.join(maps, of_map == F.col("m_map"), "left")
    return found.withColumn("marked", F.coalesce(bit > 0, F.lit(False))).drop("m_map", "m_bits")

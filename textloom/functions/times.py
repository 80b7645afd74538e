"""Epoch seconds as ISO text, in UTC whatever the session time zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col


def iso_time(seconds: Column | str) -> Column:
    """``2024-01-01T00:00:00``, with six decimals only when they are not zero."""
    micros = F.round(_col(seconds) * 1000000).cast("long")
    fraction = F.pmod(micros, F.lit(1000000))
    whole = F.floor((micros - fraction) / 1000000).cast("long")
    days = F.floor(whole / 86400).cast("int")
    rest = F.pmod(whole, F.lit(86400)).cast("int")
    date = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")
    clock = F.format_string("%02d:%02d:%02d", (rest / 3600).cast("int"),
                            (rest % 3600 / 60).cast("int"), rest % 60)
    stamp = F.concat(date, F.lit("T"), clock)
    return F.when(fraction == 0, stamp).otherwise(
        F.concat(stamp, F.format_string(".%06d", fraction)))

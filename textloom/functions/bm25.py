"""BM25 as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The usual BM25 parameters, and the floor for terms in half of
# the rows or more, whose inverse document frequency would not be positive.
K1 = 1.2
B = 0.75
MIN_IDF = 1e-6


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def idf(n_docs, df) -> Column:
    """Inverse document frequency of one scoring unit (a term or a phrase)."""
    n_docs, df = _column(n_docs), _column(df)
    raw = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(MIN_IDF)


def part(tf: Column, doc_len: Column, unit_idf: Column, avg_len) -> Column:
    """What one unit adds to the score of a row that holds it ``tf`` times."""
    norm = K1 * (1 - B + B * doc_len / _column(avg_len))
    return unit_idf * tf * (K1 + 1) / (tf + norm)


def idf_value(n_docs: int, df: int) -> float:
    """``idf`` of plain numbers."""
    raw = math.log((n_docs - df + 0.5) / (df + 0.5)) if n_docs >= df else 0.0
    return raw if raw > 0 else MIN_IDF


def part_value(tf: int, doc_len: int, unit_idf: float, avg_len: float) -> float:
    """``part`` of plain numbers. It grows with ``tf`` and falls with ``doc_len``."""
    return unit_idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / avg_len))

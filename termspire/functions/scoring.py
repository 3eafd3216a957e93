"""The BM25 expression. Logarithms are base 10, and idf may be zero or negative: it is not clamped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1 = 1.5
B = 0.75


def inverse_document_frequency(num_docs: Column, df: Column) -> Column:
    return F.log10(num_docs / (F.lit(1) + df))


def term_score(
    idf: Column, tf: Column, length: Column, avgdl: Column, k1: float = K1, b: float = B
) -> Column:
    """Score one posting adds to its document."""
    saturation = tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * (length / avgdl))
    return idf * (tf * F.lit(k1 + 1.0)) / saturation

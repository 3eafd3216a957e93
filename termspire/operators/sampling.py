"""Draw sample queries from a query log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_queries(log: DataFrame, n: int, seed: int, text: str = "QueryText") -> DataFrame:
    """Exactly n distinct query texts (all, if fewer): those with the smallest digest of text and seed.

    The draw depends on the texts and the seed only, not on how the log is split, and each task
    keeps no more than n rows.
    """
    digest = F.md5(F.concat(F.col(text), F.lit(str(seed))).cast("binary"))
    return log.select(text).where(F.col(text).isNotNull()).distinct().orderBy(digest, text).limit(n)

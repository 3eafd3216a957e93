"""Query texts to query terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspire.functions.text import split_words, tokenize


def token_lists(queries: DataFrame, text: str = "QueryText") -> DataFrame:
    """(qt): the normalised terms of each query text, as an array."""
    return queries.select(tokenize(F.col(text)).alias("qt"))


def tokenize_queries(
    queries: DataFrame,
    mode: str = "normalised",
    qno: str = "qno",
    text: str = "QueryText",
    drop_apostrophes: bool = False,
) -> DataFrame:
    """(qno, qterm), one row per term in the text, repeats included.

    "normalised" cleans the text as the index build does; "whitespace" only splits it.
    """
    if mode == "normalised":
        words = tokenize(F.col(text))
    elif mode == "whitespace":
        words = split_words(F.col(text), drop_apostrophes)
    else:
        raise ValueError(f"unknown mode: {mode}")
    return queries.select(F.col(qno).cast("long").alias("qno"), F.explode(words).alias("qterm"))


def terms_of_query(query_terms: DataFrame, qno: int) -> DataFrame:
    """(qterm) of one query."""
    return query_terms.where(F.col("qno") == qno).select("qterm")

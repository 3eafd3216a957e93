"""Keys that group terms into ranges and buckets."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from termspire.functions.text import sql_tokenize


def crange(term: Column) -> Column:
    """Range key of a term: the code point of its first character, in steps of ten ('' gives 0)."""
    return F.floor(F.ascii(term) / 10).cast("int")


def shift_bucket(termid: Column, shift: int) -> Column:
    """Bucket that keeps the order of term ids, so neighbouring ids share a bucket."""
    return F.shiftright(termid, shift).cast("int")


def hash_bucket(termid: Column, buckets: int) -> Column:
    """Bucket that spreads term ids evenly."""
    return F.pmod(F.xxhash64(termid), F.lit(buckets)).cast("int")


def register_sql_functions(spark: SparkSession, shift: int = 17) -> None:
    """Offer `cr(term)`, `p(termid)` and `tokenize(text)` to SQL users, as temporary functions.

    `tokenize` gives the same terms as `functions.text.tokenize`, which builds the index.
    """
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cr(term STRING) RETURNS INT "
        "RETURN cast(ascii(term) div 10 AS INT)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION p(termid BIGINT) RETURNS INT "
        f"RETURN cast(shiftright(termid, {int(shift)}) AS INT)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION tokenize(text STRING) RETURNS ARRAY<STRING> "
        f"RETURN {sql_tokenize()}"
    )

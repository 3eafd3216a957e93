"""Physical layouts: buckets for postings, the range key of the dictionary, and the choice of a shift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspire.functions.keys import crange
from termspire.model import Index, Layout

POSTING_BYTES = 16
BUCKET_BYTES = 100 << 20
# A term id is a long, so no shift beyond this moves anything.
MAX_SHIFT = 63


def with_bucket(postings: DataFrame, layout: Layout) -> DataFrame:
    """Add (or replace) the bucket column `thash`. One expression over all rows, no chunked update."""
    key = layout.bucket(F.col("termid"))
    return postings.drop("thash") if key is None else postings.withColumn("thash", key)


def layout_hash(postings: DataFrame, buckets: int = 100) -> DataFrame:
    return with_bucket(postings, Layout("hash", buckets))


def layout_shift(postings: DataFrame, shift: int = 17) -> DataFrame:
    return with_bucket(postings, Layout("shift", shift))


def layout_dict(terms: DataFrame) -> DataFrame:
    """Dictionary with the range key of the first character; the sink sorts it by (crange, termid)."""
    return terms.select("term", "termid", "df", crange(F.col("term")).alias("crange"))


def choose_shift(
    postings: DataFrame,
    bytes_per_row: int = POSTING_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    max_buckets: int | None = None,
    max_shift: int = MAX_SHIFT,
) -> DataFrame:
    """One row, one column `shift`: the smallest m < max_shift with 2^m > max(termid) div buckets.

    The wanted number of buckets is the size of the postings over `bucket_bytes`; a table under that
    size gets one. `max_buckets` bounds the number of folders on very large tables, where files
    inside a bucket are sorted and prune further. NULL for an empty table, or when a smaller
    `max_shift` leaves no m that is large enough.
    """
    size = postings.agg(F.count(F.lit(1)).alias("rows"), F.max("termid").alias("top"))
    return _shift_for(size, bytes_per_row, bucket_bytes, max_buckets, max_shift)


def choose_shift_by_dict(
    terms: DataFrame,
    bytes_per_row: int = POSTING_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    max_buckets: int | None = None,
    max_shift: int = MAX_SHIFT,
) -> DataFrame:
    """The same from the dictionary alone: its frequencies add up to the number of postings, so the
    largest table need not be read."""
    size = terms.agg(
        F.coalesce(F.sum("df"), F.lit(0)).alias("rows"), F.max("termid").alias("top")
    )
    return _shift_for(size, bytes_per_row, bucket_bytes, max_buckets, max_shift)


def _shift_for(
    size: DataFrame,
    bytes_per_row: int,
    bucket_bytes: int,
    max_buckets: int | None,
    max_shift: int,
) -> DataFrame:
    wanted = F.expr(f"rows * {int(bytes_per_row)} div {int(bucket_bytes)}")
    if max_buckets is not None:
        wanted = F.least(wanted, F.lit(max_buckets).cast("long"))
    width = size.select("top", F.greatest(wanted, F.lit(1).cast("long")).alias("wanted")).select(
        F.expr("top div wanted").alias("width")
    )
    fits = F.filter(
        F.sequence(F.lit(0), F.lit(max_shift - 1)),
        lambda m: F.call_function("shiftleft", F.lit(1).cast("long"), m) > F.col("width"),
    )
    return width.select(F.array_min(fits).cast("int").alias("shift"))


def with_lengths(index: Index) -> Index:
    """Carry the document length beside each posting, so that ranking needs no join with `docs`.

    Only for an index with one row per document; otherwise the join must repeat rows.
    """
    if index.has_lengths or not index.unique_docs:
        return index
    lengths = index.docs.select("docid", "len")
    postings = index.postings.join(lengths, "docid")
    return Index(
        postings.select("termid", "docid", "tf", "len", *[c for c in postings.columns if c == "thash"]),
        index.dict,
        index.docs,
        index.stats,
        index.layout,
        index.unique_docs,
    )

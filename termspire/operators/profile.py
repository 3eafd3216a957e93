"""Row counts, sample rows and file layout of an index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspire.model import Index


def row_counts(index: Index) -> DataFrame:
    """(table_name, row_count) for the four tables."""
    counts = [
        table.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, table in index.tables().items()
    ]
    return reduce(DataFrame.union, counts)


def sample_rows(table: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by the given columns, or any n without them."""
    return (table.orderBy(*order) if order else table).limit(n)


def file_layout(table: DataFrame, *keys: str) -> DataFrame:
    """Files, bytes and rows of a table that is read from files, per value of the given key columns."""
    per_file = (
        table.select(*keys, "_metadata.file_path", "_metadata.file_size")
        .groupBy(*keys, "file_path", "file_size")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return per_file.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("file_size").alias("bytes"),
        F.sum("rows").alias("rows"),
    )

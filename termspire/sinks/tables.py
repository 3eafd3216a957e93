"""Plain table writers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, *keys: str, mode: str = "overwrite") -> None:
    """Write a table, in folders named key=value when keys are given.

    With keys, "overwrite" replaces the folders that get rows and leaves the others alone.
    """
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)

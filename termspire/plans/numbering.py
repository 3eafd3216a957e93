"""Dense numbers in sort order, without sending all rows through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termspire.plans.staging import stage

# `monotonically_increasing_id` keeps the row number within a partition in its low 33 bits.
_ROW_BITS = (1 << 33) - 1


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add `name` = 0, 1, 2, … in the order of the columns `order`, which must identify a row.

    Rows are range-partitioned and sorted, each knows its place within its partition, and the start
    of a partition is the sum of the counts before it. The rows are staged in between, because a
    second run of the range partitioning could draw other borders. The one window without a key sees
    one row per partition.
    """
    placed = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))),
        "numbered",
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    return (
        placed.join(F.broadcast(starts), "_range")
        .withColumn(name, F.col("_start") + F.col("_place"))
        .drop("_range", "_place", "_start")
    )

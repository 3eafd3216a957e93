"""Join a large frame to a lookup with one row per key, when some keys own much of the large frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termspire.plans import staging

# At most this many keys can each hold more than a SLOTS-th of all rows, so the list of such keys
# has a bound that does not grow with the data.
SLOTS = 4096
# Keys that are broadcast so that their rows need no shuffle, at most.
HEAD_ROWS = 500_000


def frequent_keys(counts: DataFrame, key: str, rows: str, total) -> DataFrame:
    """(key, ways): the keys with more than 1/SLOTS of `total` rows, and in how many parts to cut each.

    `counts` has one row per key. The result has fewer than SLOTS rows, and the ways add up to less
    than 2 * SLOTS.
    """
    share = F.col(rows) * F.lit(SLOTS)
    total = total if isinstance(total, Column) else F.lit(total)
    return counts.where(share > total).select(
        key, F.ceil(share / total).cast("int").alias("ways")
    )


def frequent_pairs(counts: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, left_ways, right_ways): how to cut the keys that make more than 1/SLOTS of all pairs.

    `counts` has one row per key, with its rows on the left and on the right. The larger side is cut
    first, and the other only if the larger has too few rows.
    """
    pairs = F.col(left).cast("double") * F.col(right)
    total = counts.agg(F.sum(pairs)).first()[0] or 0.0
    share = pairs * F.lit(float(SLOTS)) / F.lit(max(total, 1.0))
    ways = F.ceil(share)
    of_left = F.least(ways, F.when(F.col(left) >= F.col(right), F.col(left)).otherwise(F.ceil(ways / F.col(right))))
    return counts.where(share > 1).select(
        key,
        of_left.cast("int").alias("left_ways"),
        F.ceil(ways / of_left).cast("int").alias("right_ways"),
    )


def head_keys(counts: DataFrame, key: str, rows: str, *text_columns: str) -> DataFrame | None:
    """The keys with the most rows, as many as may be broadcast; None if all may be.

    `counts` has one row per key. A histogram of rows on a log scale, of bounded size, tells from which
    number on the keys are few enough, and their strings short enough. A key outside the head has
    fewer rows than any inside, so few rows are left to shuffle where some keys own most of them.
    """
    step = F.floor(F.log2(F.greatest(F.col(rows), F.lit(1))) * 8).cast("int")
    bytes_of = [F.sum(F.coalesce(F.octet_length(c), F.lit(0))) for c in text_columns]
    size = sum(bytes_of, F.lit(0)).alias("bytes")
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("keys"), size).collect()
    keys, room = min(HEAD_ROWS, staging.MAX_BROADCAST_ROWS), staging.MAX_BROADCAST_BYTES
    for row in sorted(steps, key=lambda r: -r.step):
        keys, room = keys - row.keys, room - row.bytes
        if keys < 0 or room < 0:
            return counts.where(step > row.step)
    return None


def grid_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    frequent: DataFrame,
    left_spread: list[str],
    right_spread: list[str],
) -> DataFrame:
    """Inner join on `key` of two sides that may both have many rows of a key.

    The pairs of a frequent key form a grid of `left_ways` by `right_ways` parts. A row goes to a
    row or a column of the grid, so each pair is made once, in one part.
    """
    frequent = F.broadcast(frequent)

    def placed(side: DataFrame, spread: list[str], own: str, other: str) -> DataFrame:
        ways = F.coalesce(F.col(f"{own}_ways"), F.lit(1))
        others = F.coalesce(F.col(f"{other}_ways"), F.lit(1))
        part = F.pmod(F.xxhash64(*spread, F.spark_partition_id()), ways).cast("int")
        return (
            side.join(frequent, key, "left")
            .withColumn(f"{own}_part", part)
            .withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), others - F.lit(1))))
            .drop("left_ways", "right_ways")
        )

    on = [key, "left_part", "right_part"]
    joined = placed(left, left_spread, "left", "right").join(
        placed(right, right_spread, "right", "left"), on
    )
    return joined.drop("left_part", "right_part")


def spread_join(
    big: DataFrame, lookup: DataFrame, key: str, frequent: DataFrame, spread: list[str]
) -> DataFrame:
    """Inner join on `key`; the rows of each frequent key are spread over its `ways` parts.

    The part of a row comes from the `spread` columns and the number of the task that read it, so a
    repeated task gives the same answer and even rows that are copies of one another spread out.
    The lookup row of a frequent key is repeated once per part. No row is dropped or capped.
    """
    frequent = F.broadcast(frequent)
    ways = F.coalesce(F.col("ways"), F.lit(1))
    part = F.pmod(F.xxhash64(*spread, F.spark_partition_id()), ways).cast("int")
    parts = F.explode(F.sequence(F.lit(0), ways - F.lit(1)))
    left = big.join(frequent, key, "left").withColumn("part", part).drop("ways")
    right = lookup.join(frequent, key, "left").withColumn("part", parts).drop("ways")
    return left.join(right, [key, "part"]).drop("part")


def head_join(
    big: DataFrame, lookup: DataFrame, key: str, head: DataFrame | None, frequent: DataFrame, spread: list[str]
) -> DataFrame:
    """The rows of `spread_join`, but those of the `head_keys` meet the lookup by broadcast, unshuffled."""
    if head is None:
        return big.join(F.broadcast(lookup), key)
    keys = F.broadcast(head.select(key))
    met = big.join(F.broadcast(lookup.join(keys, key, "left_semi")), key)
    rest = spread_join(big.join(keys, key, "left_anti"), lookup.join(keys, key, "left_anti"), key, frequent, spread)
    return met.unionByName(rest)

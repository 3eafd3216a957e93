"""Run a batch of queries and report what was asked, answered and skipped."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspire.model import Index
from termspire.operators.lookup import lookup_terms
from termspire.operators.rank import bm25
from termspire.plans.staging import stage


def run_batch(index: Index, queries: DataFrame, k: int = 1, **options) -> DataFrame:
    """The k best documents of every query that has a known term."""
    return bm25(index, queries, k=k, **options)


def batch_report(index: Index, queries: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """One row: queries asked, answered and skipped for want of any known term.

    `asked` (qno) may list the queries themselves, so that those without a single term count too.
    """
    asked = (queries if asked is None else asked).select("qno").distinct()
    answered = lookup_terms(index, queries).select("qno").distinct().withColumn("found", F.lit(1))
    return (
        asked.join(answered, "qno", "left")
        .agg(F.count(F.lit(1)).alias("asked"), F.count("found").alias("answered"))
        .withColumn("skipped", F.col("asked") - F.col("answered"))
    )


def timed_batch(
    index: Index, queries: DataFrame, k: int = 1, asked: DataFrame | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """The k best documents of a batch, staged, and one row of totals and means of the run.

    The row has `asked`, `answered`, `skipped`, `hits`, and over the answered queries `mean_hits` and
    `mean_best` (of their best scores); `seconds` of the job that ranks and writes, and
    `seconds_per_answered`, its share for each answered query. Means are null if none was answered. A
    batch is one job, so a query has no time of its own.
    """
    start = time.monotonic()
    results = stage(run_batch(index, queries, k, **options), "batch")
    seconds = time.monotonic() - start
    each = results.groupBy("qno").agg(F.count(F.lit(1)).alias("hits"), F.max("bm25score").alias("best"))
    sums = each.agg(
        F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.avg("hits").alias("mean_hits"), F.avg("best").alias("mean_best")
    )
    report = batch_report(index, queries, asked)
    # Both have one row.
    means = [sums.select(c).scalar().alias(c) for c in ("hits", "mean_hits", "mean_best")]
    per = F.lit(seconds) / F.nullif(F.col("answered"), F.lit(0))
    return results, report.select(
        "asked", "answered", "skipped", *means, F.lit(seconds).alias("seconds"), per.alias("seconds_per_answered")
    )

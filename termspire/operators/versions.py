"""Compare two versions of an index whose term ids differ: by term, with gained and lost ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termspire.model import Index
from termspire.plans.skew import frequent_keys, head_join, head_keys
from termspire.plans.staging import is_small, stage


def _change(before: Column, after: Column) -> Column:
    return (
        F.when(before.isNull(), "gained").when(after.isNull(), "lost").when(before == after, "same").otherwise("changed")
    )


def _both_dicts(before: Index, after: Index) -> DataFrame:
    """(term, before_id, after_id, df_before, df_after): every term of either version once."""
    old = before.dict.select("term", F.col("termid").alias("before_id"), F.col("df").alias("df_before"))
    new = after.dict.select("term", F.col("termid").alias("after_id"), F.col("df").alias("df_after"))
    return old.join(new, "term", "full_outer")


def changed_terms(before: Index, after: Index) -> DataFrame:
    """(term, df_before, df_after, change): terms that are gained, lost, or in another number of documents.

    Terms are the join key, and a version has each once, so no key is large.
    """
    change = _change(F.col("df_before"), F.col("df_after"))
    found = _both_dicts(before, after).select("term", "df_before", "df_after", change.alias("change"))
    return found.where(F.col("change") != "same")


def _renumbered(index: Index, ids: DataFrame) -> DataFrame:
    """(common, docid, tf) of the postings of a version, under ids that both versions share.

    The few terms that hold many postings are known from the dictionary, and spread over tasks. Copies
    of a posting are added up within tasks.
    """
    postings = index.postings.select("termid", "docid", "tf")
    counts = index.dict.select("termid", "df")
    if is_small(ids):
        joined = postings.join(F.broadcast(ids), "termid")
    else:
        total = index.dict.agg(F.sum("df")).first()[0] or 0
        frequent = frequent_keys(counts, "termid", "df", total)
        joined = head_join(postings, ids, "termid", head_keys(counts, "termid", "df"), frequent, ["docid"])
    return joined.groupBy("common", "docid").agg(F.sum("tf").cast("long").alias("tf"))


def compared_postings(before: Index, after: Index) -> DataFrame:
    """(term, docid, tf_before, tf_after, change) of every posting of either version.

    Ids of the two versions are matched by term once; then postings meet by numbers. The join is by
    term and document, of which a version has one row each, so a term in most documents is no hot key.
    Copies of a posting are one, with the sum of their frequencies.
    """
    both = _both_dicts(before, after).select("term", "before_id", "after_id")
    # A term that only the later version has is numbered below zero, where the earlier has no ids.
    both = both.withColumn("common", F.coalesce("before_id", F.lit(-1) - F.col("after_id")))
    both = stage(both, "both-dicts")
    sides = []
    for index, own, name in ((before, "before_id", "tf_before"), (after, "after_id", "tf_after")):
        ids = both.where(F.col(own).isNotNull()).select(F.col(own).alias("termid"), "common")
        sides.append(_renumbered(index, ids).select("common", "docid", F.col("tf").alias(name)))
    met = sides[0].join(sides[1], ["common", "docid"], "full_outer")
    change = _change(F.col("tf_before"), F.col("tf_after"))
    met = met.withColumn("change", change)
    names = both.select("common", "term")
    if is_small(names, "term"):
        named = met.join(F.broadcast(names), "common")
    else:
        met = stage(met, "compared")
        counts = met.groupBy("common").agg(F.count(F.lit(1)).alias("rows"))
        frequent = frequent_keys(counts, "common", "rows", met.count())
        named = head_join(met, names, "common", head_keys(counts, "common", "rows"), frequent, ["docid"])
    return named.select("term", "docid", "tf_before", "tf_after", "change")


def change_report(before: Index, after: Index) -> DataFrame:
    """(table_name, change, rows): how many terms and postings were gained, lost, changed or stayed."""
    terms = _both_dicts(before, after).select(
        F.lit("dict").alias("table_name"), _change(F.col("df_before"), F.col("df_after")).alias("change")
    )
    postings = compared_postings(before, after).select(F.lit("postings").alias("table_name"), "change")
    return terms.union(postings).groupBy("table_name", "change").agg(F.count(F.lit(1)).alias("rows"))

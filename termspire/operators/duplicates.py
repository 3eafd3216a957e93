"""Documents that occur several times: find them, compare two versions of an index, correct one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspire.model import Index
from termspire.plans.skew import frequent_keys, spread_join
from termspire.plans.staging import stage


def duplicate_ids(docs: DataFrame) -> DataFrame:
    """One row `ndup`: how many docids have more than one row."""
    return (
        docs.groupBy("docid")
        .agg(F.count("docid").alias("rows"))
        .where(F.col("rows") > 1)
        .agg(F.count(F.lit(1)).alias("ndup"))
    )


def captures(metadata: DataFrame, record: str) -> DataFrame:
    """All captures of one document id."""
    return metadata.where(F.col("id") == record).select("id", "record_id", "title")


def changed_lengths(raw: Index, corrected: Index) -> DataFrame:
    """Rows of the raw documents whose length differs from the corrected one.

    A docid may own a large part of the raw rows; such docids are spread over several tasks.
    """
    counts = raw.docs.groupBy("docid").agg(F.count(F.lit(1)).alias("rows"))
    frequent = frequent_keys(counts, "docid", "rows", raw.stats.select("num_docs").scalar())
    lengths = corrected.docs.select(
        "docid", F.col("name").alias("corrected_name"), F.col("len").alias("corrected_len")
    )
    joined = spread_join(raw.docs, lengths, "docid", frequent, ["name", "len"])
    return joined.where(F.col("len") != F.col("corrected_len")).select(
        "docid", "name", "len", "corrected_name", "corrected_len"
    )


def _two_dicts(raw: Index, corrected: Index) -> DataFrame:
    before = raw.dict.select("termid", F.col("df").alias("df_before"))
    return corrected.dict.select("termid", "term", "df").join(before, "termid")


def changed_df(raw: Index, corrected: Index) -> DataFrame:
    """One row `terms`: how many terms have another document frequency after the correction."""
    changed = _two_dicts(raw, corrected).where(F.col("df") != F.col("df_before"))
    return changed.agg(F.count(F.lit(1)).alias("terms"))


def shrunk_terms(raw: Index, corrected: Index, by: int = 2) -> DataFrame:
    """(term, df) of the terms whose document frequency fell by more than `by`."""
    shrunk = _two_dicts(raw, corrected).where(F.col("df") < F.col("df_before") - F.lit(by))
    return shrunk.select("term", "df")


def shrunk_count(raw: Index, corrected: Index, by: int = 2) -> DataFrame:
    """One row `terms`: how many terms `shrunk_terms` lists."""
    return shrunk_terms(raw, corrected, by).agg(F.count(F.lit(1)).alias("terms"))


def corrected_index(index: Index) -> Index:
    """The index with one row per docid; term ids stay, frequencies and statistics are recomputed.

    A term that several captures of a document hold gets one posting, with the largest frequency.
    The length is the sum of the kept frequencies, the name the smallest one. All groupings combine
    within tasks first, so the captures of one document do not meet in one task.
    """
    # Four tables are made of these rows, so they are grouped once.
    grouped = index.postings.groupBy("termid", "docid").agg(F.max("tf").alias("tf"))
    postings = stage(grouped, "corrected-postings")
    lengths = postings.groupBy("docid").agg(F.sum("tf").alias("len"))
    docs = (
        index.docs.groupBy("docid")
        .agg(F.min("name").alias("name"))
        .join(lengths, "docid", "left")
        .select("docid", "name", F.coalesce("len", F.lit(0)).cast("long").alias("len"))
    )
    frequencies = postings.groupBy("termid").agg(F.count(F.lit(1)).alias("df"))
    terms = index.dict.drop("df").join(frequencies, "termid")
    keep = [c for c in index.dict.columns]
    return Index(
        postings=postings,
        dict=terms.select(*keep),
        docs=docs,
        stats=docs.agg(F.count(F.lit(1)).alias("num_docs"), F.avg("len").alias("avgdl")),
        unique_docs=True,
    )

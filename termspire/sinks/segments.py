"""Add documents to an index on disk: segments beside it, and a compaction of the buckets they touch."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termspire.model import Index
from termspire.operators.index_build import delta_index
from termspire.plans.staging import delete, folders, scratch
from termspire.sinks.index_files import (
    POSTINGS_PER_FILE,
    TERMS_PER_FILE,
    write_dict,
    write_docs,
    write_postings,
    write_record,
)
from termspire.sources.index_files import Segment, read_index, read_segments


@dataclass(frozen=True)
class Compaction:
    """What a compaction rewrote: the segments merged, and the buckets (None without buckets)."""

    merged: int
    buckets: list[int] | None


def append_documents(
    spark: SparkSession,
    root: str,
    documents: DataFrame,
    docid: str = "doc_id",
    text: str = "text",
    postings_per_file: int = POSTINGS_PER_FILE,
    terms_per_file: int = TERMS_PER_FILE,
) -> Index:
    """Write the documents as a new segment of the index under `root`, and open the result.

    Known terms keep their ids, new ones get the ids after the largest, so no file that is there
    changes and no posting is renumbered. The cost is that of the new documents, and one pass over the
    dictionary. The record, written last, names the segment: a failed run leaves the index as it was.
    A docid that the index has already makes it one with repeated documents, as a raw load would.
    """
    with scratch(spark):
        index = read_index(spark, root)
        delta = delta_index(index, documents, docid, text)
        folder = f"segment-{uuid.uuid4().hex[:12]}"
        base = f"{root}/{folder}"
        delta.stats.write.parquet(f"{base}/stats")
        rows = spark.read.parquet(f"{base}/stats").first()["num_docs"]
        write_docs(delta.docs, f"{base}/docs", rows)
        size = delta.dict.agg(F.count(F.lit(1)), F.sum("df")).first()
        write_dict(delta.dict, f"{base}/dict", size[0], terms_per_file)
        write_postings(delta.postings, f"{base}/postings", index.layout, size[1] or 0, postings_per_file)
        segments = [*read_segments(spark, root), Segment(folder)]
        unique = index.unique_docs and delta.unique_docs and not _repeats(index.docs, delta.docs)
        write_record(spark, root, index.layout, index.has_lengths, unique, segments)
    return read_index(spark, root)


def _repeats(old: DataFrame, new: DataFrame) -> bool:
    return not old.select("docid").join(new.select("docid"), "docid", "left_semi").isEmpty()


def compact(
    spark: SparkSession,
    root: str,
    postings_per_file: int = POSTINGS_PER_FILE,
    terms_per_file: int = TERMS_PER_FILE,
) -> Compaction:
    """Merge all segments after the first into one, and with it the buckets of the first they touch.

    Only buckets that have postings in a later segment are read and written again; the files of the
    others stay where and as they are, and are read from there. The documents of the later segments
    become one folder beside those of the first. The dictionary is written anew. Superseded files stay
    for readers that have them open; `drop_superseded` deletes them.
    """
    segments = read_segments(spark, root)
    index = read_index(spark, root)
    if len(segments) == 1:
        return Compaction(0, [] if index.layout.kind != "none" else None)
    first, later = segments[0], segments[1:]
    added = read_index(spark, root, later)
    postings, buckets = index.postings, None
    if index.layout.kind != "none":
        # Bounded by the buckets of the layout.
        buckets = sorted(r[0] for r in added.postings.select("thash").distinct().collect())
        postings = postings.where(F.col("thash").isin(buckets))
    folder = f"segment-{uuid.uuid4().hex[:12]}"
    base = f"{root}/{folder}"
    index.stats.write.parquet(f"{base}/stats")
    write_docs(added.docs, f"{base}/docs", added.stats.first()["num_docs"])
    write_dict(index.dict, f"{base}/dict", index.dict.count(), terms_per_file)
    write_postings(postings, f"{base}/postings", index.layout, postings.count(), postings_per_file)
    kept = ("docs",) if buckets is None else ("docs", "postings")
    dropped = tuple(sorted({*first.dropped, *(buckets or [])}))
    record = [Segment(first.folder, kept, dropped), Segment(folder)]
    write_record(spark, root, index.layout, index.has_lengths, index.unique_docs, record)
    return Compaction(len(later), buckets)


def drop_superseded(spark: SparkSession, root: str) -> None:
    """Delete the folders that the record doesn't name, and the tables and buckets it doesn't use."""
    used = {s.folder: s for s in read_segments(spark, root)}
    for name in folders(spark, root):
        if name.startswith(("version-", "segment-")) and name not in used:
            delete(spark, f"{root}/{name}")
    for name, segment in used.items():
        gone = [t for t in ("dict", "stats", "postings", "docs") if t not in segment.tables]
        if "postings" in segment.tables:
            gone += [f"postings/thash={bucket}" for bucket in segment.dropped]
        for part in gone:
            delete(spark, f"{root}/{name}/{part}")


def segment_report(spark: SparkSession, root: str) -> DataFrame:
    """(segment, documents, postings, terms, new_terms) for each segment, numbered from 0 in order.

    `new_terms` are the terms that no earlier segment has: those whose ids are beyond the largest
    before, since ids are given in order.
    """
    parts = None
    top = -1
    for number, segment in enumerate(read_segments(spark, root)):
        part = read_index(spark, root, [segment])
        sums = part.dict.agg(
            F.count(F.lit(1)).alias("terms"),
            F.coalesce(F.sum("df"), F.lit(0)).alias("postings"),
            F.count_if(F.col("termid") > top).alias("new_terms"),
        )
        largest = part.dict.agg(F.max("termid")).first()[0]
        top = top if largest is None else max(top, largest)
        documents = part.stats.select("num_docs").scalar().alias("documents")
        row = sums.select(F.lit(number).alias("segment"), documents, "postings", "terms", "new_terms")
        parts = row if parts is None else parts.union(row)
    return parts

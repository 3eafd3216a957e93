"""Write an index under one root folder, in the physical layout its readers profit from."""

from __future__ import annotations

import uuid
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from termspire.model import Index, Layout
from termspire.operators.block_max import BLOCK_BITS, Impacts, block_impacts
from termspire.operators.layout import layout_dict, with_bucket
from termspire.plans.staging import delete, folders, local_relation
from termspire.sources.index_files import Segment, read_impacts, read_index, read_segments

# Rows per file. One task sorts the rows of a file, so they must fit in its memory: a posting takes about
# a hundred bytes there, and few in the file.
POSTINGS_PER_FILE = 4_000_000
# A bound is grouped and sorted in the task that writes it.
BOUNDS_PER_FILE = 2_000_000
TERMS_PER_FILE = 8_000_000
DOCS_PER_FILE = 8_000_000
# Postings are sorted, so the differences of ids are small: blocks of delta-coded numbers, which Spark's
# reader decodes, take less than dictionaries of ids.
PACKED = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary#termid": "false",
    "parquet.enable.dictionary#docid": "false",
}
# Bloom filters: how often an absent value may seem present, and the largest filter of a row group.
BLOOM_FALSE = 0.001
BLOOM_BYTES = 32 << 20
# A small table is cut finer, to use the whole cluster, but not below this many rows per file.
MIN_PER_FILE = 100_000


def _files(spark: SparkSession, rows: int, rows_per_file: int) -> int:
    slots = spark.sparkContext.defaultParallelism
    return max(1, ceil(rows / rows_per_file), min(slots, rows // MIN_PER_FILE))


def _with_bloom(writer: DataFrameWriter, column: str, values: int) -> DataFrameWriter:
    """Give each row group a Bloom filter of a column whose values differ, sized for `values` of them.

    A dictionary of a column of distinct values is as large as the column, and Parquet leaves a Bloom
    filter out where it has one, so it is switched off.
    """
    return (
        writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{column}", max(values, 1))
        .option(f"parquet.bloom.filter.fpp#{column}", BLOOM_FALSE)
        .option("parquet.bloom.filter.max.bytes", BLOOM_BYTES)
        .option(f"parquet.enable.dictionary#{column}", "false")
    )


def write_postings(
    postings: DataFrame, path: str, layout: Layout, rows: int, rows_per_file: int = POSTINGS_PER_FILE
) -> None:
    """Postings in folders by bucket, each file sorted by (termid, docid).

    Files are cut by ranges of (bucket, termid, docid), not by bucket: a bucket or a term that holds
    a third of all rows is written by a third of the tasks, and each file still covers a narrow
    range, so the statistics in its footer prune well. Ids are delta-coded (see PACKED).
    """
    order = [*(["thash"] if layout.kind != "none" else []), "termid", "docid"]
    keyed = with_bucket(postings, layout)
    files = _files(postings.sparkSession, rows, rows_per_file)
    sorted_rows = keyed.repartitionByRange(files, *order).sortWithinPartitions(*order)
    writer = sorted_rows.write.mode("overwrite").options(**PACKED)
    (writer.partitionBy("thash") if layout.kind != "none" else writer).parquet(path)


def write_dict(
    terms: DataFrame, path: str, rows: int, rows_per_file: int = TERMS_PER_FILE
) -> None:
    """Dictionary sorted by (crange, termid), so that row groups hold narrow ranges of both, with Bloom
    filters of its terms: a scan for a word that isn't there reads no row."""
    files = _files(terms.sparkSession, rows, rows_per_file)
    ordered = (
        layout_dict(terms)
        .repartitionByRange(files, "crange", "termid")
        .sortWithinPartitions("crange", "termid")
    )
    _with_bloom(ordered.write.mode("overwrite"), "term", ceil(rows / files)).parquet(path)


def write_docs(docs: DataFrame, path: str, rows: int, rows_per_file: int = DOCS_PER_FILE) -> None:
    """Documents sorted by docid, so that names of a few are found by the files' statistics, and with
    Bloom filters of docid, so that ids between those of a file are known to be absent."""
    files = _files(docs.sparkSession, rows, rows_per_file)
    ordered = (
        docs.select("docid", "name", "len")
        .repartitionByRange(files, "docid")
        .sortWithinPartitions("docid")
    )
    _with_bloom(ordered.write.mode("overwrite"), "docid", ceil(rows / files)).parquet(path)


def write_impacts(index: Index, path: str, bits: int = BLOCK_BITS, rows_per_file: int = BOUNDS_PER_FILE) -> Impacts:
    """Bounds of the blocks of an index, sorted by (termid, block), and open them."""
    spark = index.postings.sparkSession
    files = _files(spark, index.dict.agg(F.sum("df")).first()[0] or 0, rows_per_file)
    ordered = block_impacts(index, bits, files).withColumn("bits", F.lit(bits))
    ordered.sortWithinPartitions("termid", "block").write.mode("overwrite").parquet(path)
    return read_impacts(spark, path)


def write_index(
    index: Index,
    root: str,
    layout: Layout = Layout(),
    postings_per_file: int = POSTINGS_PER_FILE,
    terms_per_file: int = TERMS_PER_FILE,
) -> Index:
    """Write the four tables and the layout record, and open the result.

    Every call makes a folder of its own under `root`, and the record, written last, names the one
    that counts. So a failed run leaves the index as it was, and a reader of the version before goes
    on reading it. `drop_old_versions` deletes those.
    """
    spark = index.postings.sparkSession
    version = f"version-{uuid.uuid4().hex[:12]}"
    base = f"{root}/{version}"
    index.stats.write.parquet(f"{base}/stats")
    write_docs(index.docs, f"{base}/docs", index.stats.first()["num_docs"])
    size = index.dict.agg(F.count(F.lit(1)), F.sum("df")).first()
    write_dict(index.dict, f"{base}/dict", size[0], terms_per_file)
    write_postings(index.postings, f"{base}/postings", layout, size[1] or 0, postings_per_file)
    write_record(spark, root, layout, index.has_lengths, index.unique_docs, [Segment(version)])
    return read_index(spark, root)


def drop_old_versions(spark: SparkSession, root: str) -> None:
    """Delete the versions under `root` that the record does not name."""
    current = {s.folder for s in read_segments(spark, root)}
    for name in folders(spark, root):
        if name.startswith(("version-", "segment-")) and name not in current:
            delete(spark, f"{root}/{name}")


def write_record(
    spark: SparkSession, root: str, layout: Layout, has_lengths: bool, unique_docs: bool, segments: list[Segment]
) -> None:
    """Name the segments that make up the index under `root`, and how they are laid out."""
    named = [{"folder": s.folder, "tables": list(s.tables), "dropped": list(s.dropped)} for s in segments]
    kind = pa.struct(
        [("folder", pa.string()), ("tables", pa.list_(pa.string())), ("dropped", pa.list_(pa.int32()))]
    )
    record = pa.table(
        {
            "kind": pa.array([layout.kind]),
            "param": pa.array([layout.param], pa.int32()),
            "has_lengths": pa.array([has_lengths]),
            "unique_docs": pa.array([unique_docs]),
            "version": pa.array([segments[0].folder]),
            "segments": pa.array([named], pa.list_(kind)),
        }
    )
    local_relation(spark, record).write.mode("overwrite").parquet(f"{root}/layout")

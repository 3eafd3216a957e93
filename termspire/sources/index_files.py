"""Read an index from its root folder or from a database of the catalog."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termspire import schemas
from termspire.model import Index, Layout
from termspire.operators.block_max import BLOCK_BITS, Impacts


def _postings_schema(layout: Layout, has_lengths: bool) -> T.StructType:
    fields = list(schemas.POSTINGS.fields)
    if has_lengths:
        fields.append(schemas.POSTING_LENGTH)
    if layout.kind != "none":
        fields.append(schemas.POSTING_BUCKET)
    return T.StructType(fields)


def read_record(spark: SparkSession, root: str) -> Row:
    """How the index under `root` is laid out, and in which folder its tables are."""
    return spark.read.schema(schemas.LAYOUT).parquet(f"{root}/layout").first()


ALL_TABLES = ("postings", "dict", "docs", "stats")


@dataclass(frozen=True)
class Segment:
    """A folder of an index: the tables of it that count, and the buckets of its postings that don't."""

    folder: str
    tables: tuple[str, ...] = ALL_TABLES
    dropped: tuple[int, ...] = ()


def read_segments(spark: SparkSession, root: str) -> list[Segment]:
    """The folders that make up the index under `root`, in the order in which they were written."""
    record = read_record(spark, root)
    if record["segments"] is None:
        return [Segment(record["version"])]
    return [Segment(s["folder"], tuple(s["tables"]), tuple(s["dropped"])) for s in record["segments"]]


def read_index(spark: SparkSession, root: str, segments: list[Segment] | None = None) -> Index:
    """Open the index under `root`, or some of its segments. Postings are read from the root of their
    folder, so the bucket stays a column and a filter on it prunes folders.

    Segments share term ids. Their postings and documents are read side by side, the frequencies of a
    term add up, and filters on terms, ids and buckets still reach the files of each.
    """
    record = read_record(spark, root)
    layout = Layout(record["kind"], record["param"])
    segments = read_segments(spark, root) if segments is None else segments

    def table(name: str, schema: T.StructType) -> DataFrame:
        parts = []
        for segment in segments:
            if name in segment.tables:
                part = spark.read.schema(schema).parquet(f"{root}/{segment.folder}/{name}")
                gone = name == "postings" and segment.dropped
                parts.append(part.where(~F.col("thash").isin(list(segment.dropped))) if gone else part)
        return reduce(DataFrame.unionAll, parts)

    terms, stats = table("dict", schemas.DICT), table("stats", schemas.STATS)
    if sum("dict" in s.tables for s in segments) > 1:
        terms = terms.groupBy("term", "termid", "crange").agg(F.sum("df").alias("df"))
        terms = terms.select("term", "termid", "df", "crange")
        # Lengths are whole numbers, so their sum is got back without an error.
        length = F.sum(F.round(F.col("avgdl") * F.col("num_docs")))
        stats = stats.agg(F.sum("num_docs").alias("num_docs"), (length / F.sum("num_docs")).alias("avgdl"))
    return Index(
        postings=table("postings", _postings_schema(layout, record["has_lengths"])),
        dict=terms,
        docs=table("docs", schemas.DOCS),
        stats=stats,
        layout=layout,
        unique_docs=record["unique_docs"],
    )


def read_impacts(spark: SparkSession, path: str) -> Impacts:
    """Open the bounds that `write_impacts` wrote."""
    rows = spark.read.schema(schemas.IMPACTS).parquet(path)
    first = rows.select("bits").first()
    return Impacts(rows.drop("bits"), first["bits"] if first else BLOCK_BITS)


def register_views(index: Index, prefix: str = "") -> None:
    """Offer the four tables to SQL as temporary views, replacing earlier ones of the same name."""
    for name, table in index.tables().items():
        table.createOrReplaceTempView(f"{prefix}{name}")


def create_tables(spark: SparkSession, database: str, root: str) -> None:
    """Make a database whose tables are the files under `root`; several roots give several versions.

    The record of the layout is a table too, so that a reader of the database need not be told.
    """
    index = read_index(spark, root)
    if len(read_segments(spark, root)) > 1:
        raise ValueError("tables of a database are folders: compact the index and write it anew first")
    record = spark.read.schema(schemas.LAYOUT).parquet(f"{root}/layout")
    base = f"{root}/{record.first()['version']}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{root}'")
    for name, table in (index.tables() | {"layout": record}).items():
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
        bucketed = name == "postings" and index.layout.kind != "none"
        spark.sql(
            f"CREATE TABLE {database}.{name} ({columns}) USING parquet "
            + ("PARTITIONED BY (thash) " if bucketed else "")
            + f"LOCATION '{root if name == 'layout' else base}/{name}'"
        )
        if bucketed:
            spark.sql(f"MSCK REPAIR TABLE {database}.{name}")


def create_bucketed_tables(index: Index, database: str, root: str, buckets: int) -> None:
    """Make a database of copies of the tables, with postings and documents in buckets by docid.

    Both sides of a join by docid are then where they belong, so ranking with lengths from `docs`, or
    over postings without lengths, moves neither. In exchange, postings are not pruned by term.
    """
    spark = index.postings.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{root}'")
    for name, table in index.tables().items():
        if name == "postings":
            table = table.drop("thash")
        writer = table.write.mode("overwrite").format("parquet").option("path", f"{root}/{name}")
        if name in ("postings", "docs"):
            order = ["docid", "termid"] if name == "postings" else ["docid"]
            # One task a bucket, so a bucket is one file.
            writer = table.repartition(buckets, "docid").write.mode("overwrite").format("parquet")
            writer = writer.option("path", f"{root}/{name}").bucketBy(buckets, "docid").sortBy(*order)
        writer.saveAsTable(f"{database}.{name}")
    row = [("none", 0, index.has_lengths, index.unique_docs, "", None)]
    record = spark.createDataFrame(row, schemas.LAYOUT)
    record.write.mode("overwrite").format("parquet").option("path", f"{root}/layout").saveAsTable(f"{database}.layout")


def read_tables(spark: SparkSession, database: str) -> Index:
    """Open the index in a database that `create_tables` made, laid out as its record says."""

    def table(name: str) -> DataFrame:
        return spark.table(f"{database}.{name}")

    record = table("layout").first()
    layout = Layout(record["kind"], record["param"])
    return Index(
        table("postings"),
        table("dict"),
        table("docs"),
        table("stats"),
        layout,
        record["unique_docs"],
    )

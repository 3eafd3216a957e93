"""Permanent views of an index in the catalog, switched from one state of its record to the next at once."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from termspire.model import Index, Layout
from termspire.sources.index_files import ALL_TABLES, read_index, read_record, read_segments

_CURRENT = "current_index"


def publish_views(spark: SparkSession, database: str, root: str) -> str:
    """Offer the index under `root`, as its record is now, in the views of a database.

    Each segment's tables are external tables; a state of the index is four views over them. One more
    view says which state counts and how it is laid out, and replacing it is the switch: a reader gets
    all four tables of one state, and one that has an older state open goes on reading that. Returns
    the state's name.
    """
    record, segments = read_record(spark, root), read_segments(spark, root)
    index = read_index(spark, root)
    state = f"s{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in ALL_TABLES:
        parts = []
        for segment in segments:
            if name not in segment.tables:
                continue
            table = f"{database}.{name}_{segment.folder.replace('-', '_')}"
            _external_table(spark, table, f"{root}/{segment.folder}/{name}", index.tables()[name].schema)
            columns = ", ".join(f"`{c}`" for c in index.tables()[name].columns)
            gone = ", ".join(map(str, segment.dropped)) if name == "postings" else ""
            parts.append(f"SELECT {columns} FROM {table}" + (f" WHERE thash NOT IN ({gone})" if gone else ""))
        body = " UNION ALL ".join(parts)
        if len(parts) > 1 and name == "dict":
            body = f"SELECT term, termid, sum(df) AS df, crange FROM ({body}) GROUP BY term, termid, crange"
        if len(parts) > 1 and name == "stats":
            length = "sum(round(avgdl * num_docs)) / sum(num_docs)"
            body = f"SELECT sum(num_docs) AS num_docs, {length} AS avgdl FROM ({body})"
        spark.sql(f"CREATE VIEW {database}.{name}_{state} AS {body}")
    said = (
        f"'{state}' AS state, '{record['kind']}' AS kind, {record['param']} AS param, "
        f"{str(record['unique_docs']).lower()} AS unique_docs"
    )
    spark.sql(f"CREATE OR REPLACE VIEW {database}.{_CURRENT} AS SELECT {said}")
    return state


def _external_table(spark: SparkSession, table: str, path: str, schema) -> None:
    if spark.catalog.tableExists(table):
        # A segment's files stay as they are, but for buckets that are superseded.
        return
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    bucketed = "thash" in schema.fieldNames()
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet "
        + ("PARTITIONED BY (thash) " if bucketed else "")
        + f"LOCATION '{path}'"
    )
    if bucketed:
        spark.sql(f"MSCK REPAIR TABLE {table}")


def read_views(spark: SparkSession, database: str) -> Index:
    """Open the index that the views of a database offer now: one state of it, whatever is published later."""
    current = spark.table(f"{database}.{_CURRENT}").first()
    tables = [spark.table(f"{database}.{name}_{current['state']}") for name in ALL_TABLES]
    return Index(*tables, Layout(current["kind"], current["param"]), current["unique_docs"])


def drop_old_views(spark: SparkSession, database: str) -> None:
    """Drop the views of states that no longer count, and the tables that the one that counts doesn't use.

    Files stay; `drop_superseded` deletes those that the record doesn't name.
    """
    state = spark.table(f"{database}.{_CURRENT}").first()["state"]
    used = set()
    for name in ALL_TABLES:
        text = spark.sql(f"SHOW CREATE TABLE {database}.{name}_{state}").first()[0]
        used.add(f"{name}_{state}")
        used |= {word.strip("`,()").split(".")[-1].strip("`") for word in text.split() if f"{name}_" in word}
    for found in spark.catalog.listTables(database):
        if found.isTemporary or found.name == _CURRENT or found.name in used:
            continue
        spark.sql(f"DROP {'VIEW' if found.tableType == 'VIEW' else 'TABLE'} {database}.{found.name}")

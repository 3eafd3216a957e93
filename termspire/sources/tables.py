"""Parquet readers. A path may be local or on any store that Hadoop reads (hdfs, s3a, …)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def store_session(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session with Hadoop settings of its own, such as the endpoint and the keys of one object store.

    Frames that it reads, and what is made of them, are read and written with these settings, by tasks
    as well as by the driver; other sessions of the application don't see them, so two indexes can lie
    in two stores with different keys. Frames of other sessions don't get them: read the documents of an
    index with the session that writes it. Hadoop keeps an open file system for scheme and host, so the
    settings of a host are those it was first opened with.
    """
    session = spark.newSession()
    for key, value in settings.items():
        session.conf.set(key, value)
    return session


def read_folder(
    spark: SparkSession, root: str, schema: T.StructType, keys: T.StructType, *subfolders: str
) -> DataFrame:
    """Read a folder whose subfolders are named key=value; the keys become columns of given types.

    Without `subfolders` the root is read and a filter on a key prunes folders. With them, only
    those (they may hold wildcards) are listed, which spares listing a very wide root.
    """
    reader = spark.read.schema(T.StructType(schema.fields + keys.fields)).option("basePath", root)
    paths = [f"{root.rstrip('/')}/{sub}" for sub in subfolders] or [root]
    return reader.parquet(*paths)


def temporary_table(df: DataFrame, name: str) -> DataFrame:
    """Keep a result for the session under a name that SQL can use; an earlier one is freed."""
    catalog = df.sparkSession.catalog
    if catalog.tableExists(name) and catalog.isCached(name):
        catalog.uncacheTable(name)
    kept = df.cache()
    kept.createOrReplaceTempView(name)
    return kept

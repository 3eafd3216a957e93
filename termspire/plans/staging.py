"""Intermediate tables in the shared folder, and small tables that are proven to be small."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A frame is broadcast, or held by the driver, only after its size was measured against these.
MAX_LOCAL_ROWS = 50_000
MAX_LOCAL_BYTES = 4 << 20
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20

_folders: dict[str, str] = {}
_staged: list[str] = []


def workspace(spark: SparkSession) -> str:
    """Folder of this application under the cluster's `spark.checkpoint.dir`.

    A folder on one machine is used only in local mode, and only when that setting is absent.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="termspire-")
        _folders[app] = f"{base.rstrip('/')}/termspire-{app}-{uuid.uuid4().hex[:8]}"
    return _folders[app]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{workspace(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back.

    It cuts the lineage, survives the loss of executors, and gives later plans real file sizes.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    _staged.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path, with the settings of the session."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), found


def delete(spark: SparkSession, path: str) -> None:
    files, found = file_system(spark, path)
    files.delete(found, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder."""
    files, found = file_system(spark, path)
    return [status.getPath().getName() for status in files.listStatus(found)]


@contextmanager
def scratch(spark: SparkSession):
    """Delete the tables that are staged within the block when it ends.

    What is made of them must have been written by then, as an index is by `write_index`.
    """
    first = len(_staged)
    try:
        yield
    finally:
        for name in _staged[first:]:
            delete(spark, name)
        del _staged[first:]


def widen(df: DataFrame) -> DataFrame:
    """Spread a frame that is read in fewer tasks than the cluster runs at once.

    It matters for small inputs only; a large one has more tasks and is left as it is. The size is
    the optimizer's, that of the files for a plain read, so nothing is run to learn it.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    task = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    return df.repartition(slots) if size < slots * task else df


def local_relation(spark: SparkSession, table: pa.Table) -> DataFrame:
    """A frame whose few rows are part of the plan, so that its size is known to the optimizer."""
    return spark.createDataFrame(table)


def is_small(df: DataFrame, *text_columns: str) -> bool:
    """Whether a frame may be broadcast: its rows and the bytes of its strings are counted first."""
    sizes = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in text_columns]
    row = df.agg(F.count(F.lit(1)), *sizes).first()
    return row[0] <= MAX_BROADCAST_ROWS and sum(row[1:]) <= MAX_BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, *text_columns: str) -> DataFrame:
    return F.broadcast(df) if is_small(df, *text_columns) else df

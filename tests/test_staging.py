import os

from pyspark.sql import functions as F

from termspire import Layout
from termspire.operators.index_build import build_index
from termspire.plans import staging
from termspire.sinks import write_index
from termspire.sources import temporary_table


def test_a_build_leaves_nothing_but_the_index(spark):
    docs = spark.createDataFrame([(n, f"the word {n} and more") for n in range(20)], "doc_id bigint, text string")
    root = staging.workspace(spark).removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with staging.scratch(spark):
        index = write_index(build_index(docs), staging.new_folder(spark, "kept"), Layout("hash", 3))
    left = set(os.listdir(root)) - before
    assert {n.split("-")[0] for n in left} == {"kept"}
    assert index.docs.count() == 20


def test_widen_runs_nothing(spark, monkeypatch):
    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    wide = staging.widen(frame)
    assert set(tracker.getJobIdsForGroup(None)) == before
    assert wide.count() == 7


def test_a_temporary_table_frees_the_one_before(spark):
    first = temporary_table(spark.range(5), "kept_rows")
    assert first.is_cached and first.count() == 5
    temporary_table(spark.range(7), "kept_rows")
    assert spark.table("kept_rows").count() == 7
    assert not spark.range(5).storageLevel.useMemory

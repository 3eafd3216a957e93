import random

import micro
import pytest
from pyspark.sql import functions as F

from termspire import Layout
from termspire.operators.index_build import build_index
from termspire.operators.lookup import terms_in
from termspire.operators.scan_report import scan_report
from termspire.plans.staging import new_folder
from termspire.sinks import write_index


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(400)]
    docs = micro.corpus(spark, texts).select((F.col("doc_id") * 10).alias("doc_id"), "text")
    return write_index(build_index(docs), new_folder(spark, "scanned"), Layout("shift", 9))


def rows(report):
    return [r.asDict() for r in report.orderBy("scan").collect()]


def test_counts_files_bytes_partitions_and_rows(spark, index):
    whole = rows(scan_report(index.postings))
    assert len(whole) == 1 and whole[0]["table"] == "postings"
    assert whole[0]["rows"] == index.postings.count() and whole[0]["files"] >= whole[0]["partitions"] > 3
    one = rows(scan_report(index.postings.where("thash = 2")))[0]
    assert one["partitions"] == 1 and one["files"] < whole[0]["files"] and one["bytes"] < whole[0]["bytes"]
    assert one["rows"] == index.postings.where("thash = 2").count()


def test_every_scan_of_a_plan_once(spark, index):
    joined = index.postings.join(index.dict, "termid").join(index.docs, "docid").groupBy("term").count()
    assert sorted(r["table"] for r in rows(scan_report(joined))) == ["dict", "docs", "postings"]
    twice = index.docs.groupBy("len").count()
    shared = twice.join(twice.withColumnRenamed("count", "again"), "len")
    assert len(rows(scan_report(shared))) <= 2
    below = index.docs.where(F.col("len") > index.stats.select("avgdl").scalar())
    assert {r["table"] for r in rows(scan_report(below))} == {"docs", "stats"}
    assert rows(scan_report(spark.range(5))) == []


def test_absent_words_and_ids_read_no_rows(spark, index):
    known = {r.term for r in index.dict.select("term").collect()}
    rng = random.Random(6)
    absent = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(60)]
    absent = [w for w in absent if w not in known][:20]
    assert sum(rows(scan_report(terms_in(index.dict, [w])))[0]["rows"] > 0 for w in absent) <= 1
    word = sorted(known)[len(known) // 2]
    assert rows(scan_report(terms_in(index.dict, [word])))[0]["rows"] > 0
    # Ids are tens, so those between are within every file's range.
    read = [rows(scan_report(index.docs.where(F.col("docid") == n)))[0]["rows"] for n in range(1001, 1010)]
    assert sum(r > 0 for r in read) <= 1
    assert rows(scan_report(index.docs.where("docid = 1000")))[0]["rows"] > 0


def test_bloom_filters_decide(spark, index):
    """The same lookup without them reads the file that holds words before and after."""
    word = "eeeeezq"
    spark.conf.set("parquet.filter.bloom.enabled", "false")
    try:
        without = rows(scan_report(terms_in(index.dict, [word])))[0]["rows"]
    finally:
        spark.conf.unset("parquet.filter.bloom.enabled")
    assert rows(scan_report(terms_in(index.dict, [word])))[0]["rows"] == 0 < without

import micro
from termspire.operators import duplicates
from termspire.operators.index_build import build_index
from termspire.plans import skew
from pyspark.sql import functions as F


def captured(spark):
    """Document 0 was captured three times, with different texts; document 1 once."""
    rows = micro.corpus(spark, ["x y", "x y z", "x", "y q"])
    return rows.withColumn("doc_id", (F.col("doc_id") == 3).cast("long")).withColumn(
        "name", F.concat(F.lit("n"), F.length("text"))
    )


def test_analysis_and_correction(spark):
    raw = build_index(captured(spark), name=F.col("name"))
    fixed = duplicates.corrected_index(raw)
    assert duplicates.duplicate_ids(raw.docs).first()["ndup"] == 1
    assert duplicates.duplicate_ids(fixed.docs).first()["ndup"] == 0
    df = {r["term"]: r["df"] for r in raw.dict.collect()}
    assert df == {"q": 1, "x": 3, "y": 3, "z": 1}
    assert {r["term"]: r["df"] for r in fixed.dict.collect()} == {"q": 1, "x": 1, "y": 2, "z": 1}
    assert sorted(map(tuple, fixed.docs.collect())) == [(0, "n1", 3), (1, "n3", 2)]
    assert tuple(fixed.stats.first()) == (2, 2.5)
    assert duplicates.changed_df(raw, fixed).first()["terms"] == 2
    assert duplicates.shrunk_count(raw, fixed, by=1).first()["terms"] == 1
    assert [tuple(r) for r in duplicates.shrunk_terms(raw, fixed, by=1).collect()] == [("x", 1)]
    changed = sorted((r["docid"], r["len"], r["corrected_len"]) for r in duplicates.changed_lengths(raw, fixed).collect())
    assert changed == [(0, 1, 3), (0, 2, 3)]


def test_a_hot_document_is_spread(spark, monkeypatch):
    """Most rows are copies of one docid: the result is the same however few slots there are."""
    rows = spark.range(600).select(
        F.when(F.col("id") < 500, 0).otherwise(F.col("id")).cast("long").alias("doc_id"),
        F.concat(F.lit("n"), "id").alias("name"),
        F.repeat(F.lit("w "), (F.col("id") % 3 + 1).cast("int")).alias("text"),
    )
    raw = build_index(rows, name=F.col("name"))
    fixed = duplicates.corrected_index(raw)
    expected = sorted(map(tuple, duplicates.changed_lengths(raw, fixed).collect()))
    assert len(expected) == sum(1 for i in range(500) if i % 3 != 2)
    monkeypatch.setattr(skew, "SLOTS", 4)
    assert sorted(map(tuple, duplicates.changed_lengths(raw, fixed).collect())) == expected


def test_captures(spark):
    rows = [("7f", "r1", "t"), ("7f", "r2", "t"), ("00", "r3", "t")]
    metadata = spark.createDataFrame(rows, "id string, record_id string, title string")
    assert {r["record_id"] for r in duplicates.captures(metadata, "7f").collect()} == {"r1", "r2"}

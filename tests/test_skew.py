import pyarrow as pa
from pyspark.sql import functions as F

from termspire.plans import skew, staging
from termspire.plans.skew import SLOTS, frequent_pairs, grid_join


def test_grid_join_makes_each_pair_once_and_spreads_them(spark):
    left = [(1, n) for n in range(3)] + [(2, n) for n in range(900)] + [(3, n) for n in range(40)]
    right = [(1, n) for n in range(900)] + [(2, n) for n in range(2)] + [(3, n) for n in range(40)]
    left += [(4, 0), (5, 1)]
    right += [(4, 7), (6, 1)]
    a = spark.createDataFrame(pa.table({"k": [r[0] for r in left], "docid": [r[1] for r in left]}))
    b = spark.createDataFrame(pa.table({"k": [r[0] for r in right], "qno": [r[1] for r in right]}))
    counts = a.groupBy("k").agg(F.count("*").alias("l")).join(b.groupBy("k").agg(F.count("*").alias("r")), "k")
    frequent = frequent_pairs(counts, "k", "l", "r")
    ways = {r["k"]: (r["left_ways"], r["right_ways"]) for r in frequent.collect()}
    assert set(ways) == {1, 2, 3} and all(x * y > 100 for x, y in ways.values())
    assert sum(x * y for x, y in ways.values()) <= 2 * SLOTS
    joined = grid_join(a, b, "k", frequent, ["docid"], ["qno"])
    rows = joined.withColumn("task", F.spark_partition_id()).collect()
    expected = [(k, d, q) for k, d in left for j, q in right if j == k]
    assert sorted((r["k"], r["docid"], r["qno"]) for r in rows) == sorted(expected)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for key in (1, 2, 3):
            tasks = joined.where(F.col("k") == key).select(F.spark_partition_id().alias("t")).distinct().count()
            assert tasks > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_head_join(spark, monkeypatch):
    big = spark.range(3000).selectExpr("if(id % 3 = 0, id, id % 2) as k", "id")
    lookup = spark.range(2000).selectExpr("id as k", "id * 10 as v")
    counts = big.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    want = sorted(map(tuple, big.join(lookup, "k").select("k", "id", "v").collect()))
    monkeypatch.setattr(skew, "HEAD_ROWS", 2)
    head = skew.head_keys(counts, "k", "rows")
    assert sorted(r.k for r in head.collect()) == [0, 1]
    frequent = skew.frequent_keys(counts, "k", "rows", 3000)
    joined = skew.head_join(big, lookup, "k", head, frequent, ["id"])
    assert sorted(map(tuple, joined.select("k", "id", "v").collect())) == want
    # Short strings only: nothing is left for the head.
    words = counts.withColumn("word", F.repeat(F.lit("x"), 100))
    monkeypatch.setattr(staging, "MAX_BROADCAST_BYTES", 10)
    assert skew.head_keys(words, "k", "rows", "word").isEmpty()
    monkeypatch.setattr(skew, "HEAD_ROWS", 10_000)
    assert skew.head_keys(counts, "k", "rows") is None

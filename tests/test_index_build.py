import random

import pytest
from pyspark.sql import functions as F

from micro import corpus
from termspire.operators import index_build
from termspire.operators.index_build import build_index
from termspire.plans import skew, staging
from termspire.plans.numbering import number_rows

TEXTS = ["The cat, the DOG", "", "dog dog dog", "über-cat", None, "the"]


def as_dicts(index):
    terms = {r["term"]: (r["termid"], r["df"]) for r in index.dict.collect()}
    names = {tid: term for term, (tid, _) in terms.items()}
    postings = sorted((names[r["termid"]], r["docid"], r["tf"]) for r in index.postings.collect())
    docs = sorted((r["docid"], r["len"]) for r in index.docs.collect())
    return terms, postings, docs


def expected(texts):
    import re

    docs, postings = [], []
    for docid, text in enumerate(texts):
        words = re.findall(r"[a-zä-ü]+", (text or "").lower().replace("ü", "u"))
        docs.append((docid, len(words)))
        postings += [(w, docid, words.count(w)) for w in set(words)]
    words = sorted({p[0] for p in postings})
    terms = {w: (i, sum(p[0] == w for p in postings)) for i, w in enumerate(words)}
    return terms, sorted(postings), docs


def test_small_corpus(spark):
    index = build_index(corpus(spark, TEXTS))
    assert as_dicts(index) == expected(TEXTS)
    assert index.unique_docs
    assert tuple(index.stats.first()) == (6, 10 / 6)
    assert {r["len"] for r in index.postings.where(F.col("docid") == 2).collect()} == {3}


@pytest.mark.parametrize("seed", [1, 2])
def test_properties_and_hot_terms(spark, monkeypatch, seed):
    """A third of the postings belong to one term; the spread join must give what the broadcast gives."""
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    texts = ["hot " * draw.randint(1, 3) + " ".join(draw.choices(words, k=draw.randint(0, 3))) for _ in range(200)]
    plain = as_dicts(build_index(corpus(spark, texts)))
    assert plain == expected(texts)
    monkeypatch.setattr(staging, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "SLOTS", 8)
    spread = as_dicts(build_index(corpus(spark, texts).repartition(5)))
    assert spread == plain


def test_repeated_docid_is_kept(spark):
    rows = corpus(spark, ["x y", "x", "z"]).withColumn("doc_id", F.least("doc_id", F.lit(1)))
    index = build_index(rows)
    assert not index.unique_docs
    assert sorted(r["docid"] for r in index.docs.collect()) == [0, 1, 1]


def test_number_rows(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 7919 % 1009).alias("v"))
    rows = sorted((r["n"], r["v"]) for r in number_rows(df, ["v"], "n").collect())
    assert [r[0] for r in rows] == list(range(1000))
    assert [r[1] for r in rows] == sorted(r[1] for r in rows)


def test_frequencies_are_counted_without_a_shuffle(spark):
    rows = corpus(spark, ["a b a"]).select(
        F.col("doc_id").alias("docid"), F.lit("d").alias("name"), "text"
    )
    plan = index_build.forward_table(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_frequent_keys_are_bounded(spark, monkeypatch):
    """Fewer keys than slots, whatever the counts; every key above its share is among them."""
    monkeypatch.setattr(skew, "SLOTS", 8)
    counts = spark.range(100).select("id", (F.col("id") * F.col("id")).alias("rows"))
    total = sum(i * i for i in range(100))
    kept = {r["id"]: r["ways"] for r in skew.frequent_keys(counts, "id", "rows", total).collect()}
    assert kept == {i: -(-i * i * 8 // total) for i in range(100) if i * i * 8 > total}
    assert len(kept) < 8
    even = spark.range(8).select("id", F.lit(5).alias("rows"))
    assert skew.frequent_keys(even, "id", "rows", 40).count() == 0


def test_frequent_terms_are_not_shuffled(spark, monkeypatch):
    """With a dictionary too large to broadcast, the postings of its most frequent terms meet their ids in place."""
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    texts = [f"every most{'xy'[n % 2]} rare{words[n]} other{words[n // 3]}" for n in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = sorted(map(tuple, build_index(docs).postings.collect()))
    monkeypatch.setattr(staging, "MAX_BROADCAST_ROWS", 5)
    met, join = [], index_build.spread_join
    monkeypatch.setattr(index_build, "spread_join", lambda big, *rest: met.append(big) or join(big, *rest))
    assert sorted(map(tuple, build_index(docs).postings.collect())) == want
    assert {r.term[:4] for r in met[0].select("term").collect()} == {"rare", "othe"}

import random

import micro
import pytest
from pyspark.sql import functions as F

from termspire import Layout
from termspire.operators import block_max, rank
from termspire.operators.index_build import build_index
from termspire.operators.layout import with_lengths
from termspire.plans import staging
from termspire.plans.staging import new_folder
from termspire.sinks import write_impacts, write_index
from termspire.sources import literal_queries, read_impacts


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    texts = [" ".join(["every", *rng.choices(words, weights=range(1, 101), k=rng.randint(1, 60))]) for _ in range(300)]
    texts += ["every ak bl cm dn eo"] * 40 + ["every"] * 2
    docs = micro.corpus(spark, texts).select((F.col("doc_id") - 50).alias("doc_id"), "text")
    return write_index(build_index(docs), new_folder(spark, "blocks"), Layout("shift", 4))


@pytest.fixture(scope="module")
def impacts(spark, index):
    return write_impacts(index, new_folder(spark, "impacts"), bits=3)


QUERIES = [["ak", "bl", "jt"], ["every"], ["every", "it", "aa"], ["cm", "dn", "eo", "ak", "bl"], ["zz"], ["jt"]]


def rows(frame):
    return [(r.qno, r["rank"], r.docid, round(r.bm25score, 7), r["name"]) for r in frame.orderBy("qno", "rank").collect()]


@pytest.mark.parametrize("k", [1, 5, 60, 1000])
def test_same_rows_as_scoring_everything(spark, index, impacts, k):
    asked = literal_queries(spark, QUERIES)
    assert rows(block_max.bm25_block_max(index, impacts, asked, k)) == rows(rank.bm25(index, asked, k))


def test_other_parameters_and_large_batches(spark, index, impacts, monkeypatch):
    asked = literal_queries(spark, QUERIES)
    want = rows(rank.bm25(index, asked, 7, k1=0.9, b=0.2))
    assert rows(block_max.bm25_block_max(index, impacts, asked, 7, k1=0.9, b=0.2)) == want
    # Nothing is small enough to broadcast.
    for module in (rank, block_max):
        monkeypatch.setattr(module, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(staging, "MAX_BROADCAST_ROWS", 0)
    assert rows(block_max.bm25_block_max(index, impacts, asked, 7, k1=0.9, b=0.2)) == want


def test_bounds_hold(spark, index, impacts):
    terms = rank.resolve_terms(index, literal_queries(spark, QUERIES))
    scored = rank.doc_scores(rank.term_scores(index, terms)).withColumn("block", block_max.block_of(F.col("docid"), 3))
    _, asked, _ = block_max.surviving_blocks(index, impacts, terms, 5)
    bounds = block_max._bounds(index, impacts, terms, asked, rank.K1, rank.B)
    both = scored.join(bounds, ["qno", "block"], "left")
    assert both.where("bound IS NULL OR bound < bm25score - 1e-9").count() == 0


def test_blocks_are_skipped_but_not_those_of_negative_weight(spark, index, impacts):
    asked = literal_queries(spark, [["jt", "ak"]])
    _, weights, kept = block_max.surviving_blocks(index, impacts, asked, 3)
    found = block_max.postings_scored(impacts, weights, kept).first()
    assert 0 < found.scored < found.postings / 2
    # All scores are negative, so any document can be among the best.
    terms, weights, kept = block_max.surviving_blocks(index, impacts, literal_queries(spark, [["every"]]), 3)
    found = block_max.postings_scored(impacts, weights, kept).first()
    assert found.scored == found.postings == 342 and weights.first().weight < 0


def test_blocks_need_lengths_and_single_rows(spark, index, impacts):
    with pytest.raises(ValueError, match="lengths"):
        block_max.block_impacts(micro.index(spark))
    assert block_max.block_impacts(with_lengths(micro.index(spark)), 2).count() == 7
    assert read_impacts(spark, new_folder_of(impacts)).bits == 3


def new_folder_of(impacts):
    return impacts.rows.inputFiles()[0].rsplit("/", 1)[0]


def test_empty_index(spark):
    empty = build_index(micro.corpus(spark, ["a"]).limit(0))
    found = write_impacts(write_index(empty, new_folder(spark, "none")), new_folder(spark, "impacts"))
    assert block_max.bm25_block_max(empty, found, literal_queries(spark, [["a"]]), 3).count() == 0


def test_many_blocks_meet_the_queries_as_bits(spark, index, impacts, monkeypatch):
    """Chosen blocks aren't written with every term of their queries; the 70 queries need two words of bits."""
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    asked = literal_queries(spark, [[words[n], words[n + 7], "every", words[(13 * n) % 100]] for n in range(70)])
    want, labels, stage = rows(rank.bm25(index, asked, 3)), [], block_max.stage
    _, weights, kept = block_max.surviving_blocks(index, impacts, asked, 3)
    counted = sorted(map(tuple, block_max.postings_scored(impacts, weights, kept).collect()))
    monkeypatch.setattr(block_max, "stage", lambda df, label: labels.append(label) or stage(df, label))
    monkeypatch.setattr(block_max, "MAX_BROADCAST_ROWS", 0)
    assert rows(block_max.bm25_block_max(index, impacts, asked, 3)) == want
    assert "blocks" not in labels and "query-bits" in labels
    # Joined by query and block, as for batches that aren't broadcast.
    assert sorted(map(tuple, block_max.postings_scored(impacts, weights, kept).collect())) == counted

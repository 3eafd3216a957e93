import random

import pytest
from pyspark.sql import functions as F

import micro
from termspire import Layout
from termspire.operators import batch, lookup, rank
from termspire.operators.index_build import build_index
from termspire.plans import skew
from termspire.plans.staging import new_folder
from termspire.sinks import write_index


def scores(df, *keys):
    return {tuple(r[k] for k in keys): pytest.approx(r["bm25score"], abs=1e-6) for r in df.collect()}


def rows(df):
    names = ["qno", "docid", "bm25score", "name"]
    names += ["rank"] if "rank" in df.columns else []
    return sorted(tuple(round(r[n], 9) if n == "bm25score" else r[n] for n in names) for r in df.collect())


def test_hand_worked_scores(spark):
    asked = micro.queries(spark, ["a"], ["b"], ["c"], ["e"], ["c", "d"])
    got = scores(rank.bm25(micro.index(spark), asked), "qno", "docid")
    assert got[(0, 0)] == 0.0  # idf is zero, the document still qualifies
    assert got[(1, 0)] == micro.B_IN_0  # idf is negative and kept
    assert got[(2, 0)] == micro.C_IN_0
    assert got[(3, 3)] == micro.E_IN_3 and got[(3, 4)] == micro.E_IN_3
    assert got[(4, 0)] == 2 * micro.C_IN_0


def test_ties_go_to_the_smaller_docid(spark):
    best = rank.bm25(micro.index(spark), micro.queries(spark, ["e"]), k=2).collect()
    assert [(r["docid"], r["rank"]) for r in sorted(best, key=lambda r: r["rank"])] == [(3, 1), (4, 2)]


def test_set_and_bag(spark):
    index, asked = micro.index(spark), micro.queries(spark, ["c", "c", "e"])
    assert scores(rank.bm25(index, asked), "docid")[(0,)] == micro.C_IN_0
    assert scores(rank.bm25(index, asked, repeat_terms=True), "docid")[(0,)] == 2 * micro.C_IN_0


def test_equal_term_scores_collapse_only_on_demand(spark):
    index, asked = micro.index(spark), micro.queries(spark, ["c", "d"])
    assert scores(rank.bm25(index, asked), "docid")[(0,)] == 2 * micro.C_IN_0
    assert scores(rank.bm25(index, asked, collapse_equal_scores=True), "docid")[(0,)] == micro.C_IN_0


def test_per_term_rows_are_not_added(spark):
    got = rank.bm25_per_term(micro.index(spark), micro.queries(spark, ["c", "b"])).collect()
    zero = sorted(r["bm25score"] for r in got if r["docid"] == 0)
    assert zero == [pytest.approx(micro.B_IN_0, abs=1e-6), pytest.approx(micro.C_IN_0, abs=1e-6)]


def test_unknown_terms(spark):
    index, asked = micro.index(spark), micro.queries(spark, ["c", "nope"], ["nope"])
    assert set(scores(rank.bm25(index, asked), "qno")) == {(0,)}
    found = lookup.lookup_terms(index, asked)
    assert [r["qno"] for r in lookup.unknown_queries(asked, found).collect()] == [1]
    assert tuple(batch.batch_report(index, asked).first()) == (2, 1, 1)
    assert [r["docid"] for r in batch.run_batch(index, asked).collect()] == [0]


def test_empty_batch(spark):
    assert rank.bm25(micro.index(spark), micro.queries(spark), k=3).count() == 0


@pytest.mark.parametrize("layout", [Layout(), Layout("hash", 4), Layout("shift", 2)])
def test_empty_index(spark, layout):
    """No documents, or documents without a word: no results, and no error."""
    for texts in ([], ["", "123"]):
        index = write_index(build_index(micro.corpus(spark, texts)), new_folder(spark, "empty"), layout)
        assert index.stats.first()["num_docs"] == len(texts)
        for prune in ("constants", "join", None):
            assert rank.bm25(index, micro.queries(spark, ["a"]), k=3, prune=prune).count() == 0


def test_parameters(spark):
    index, asked = micro.index(spark), micro.queries(spark, ["c"])
    flat = scores(rank.bm25(index, asked, k1=0.0), "docid")[(0,)]
    assert flat == pytest.approx(0.39794, abs=1e-5)


def brute_force(docs, postings, terms):
    """Plain joins, as nested loops: copies of a posting meet copies of a document."""
    from math import log10

    avgdl = sum(d[2] for d in docs) / len(docs)
    df = {t[1]: t[2] for t in micro.DICT}
    ids = {t[0]: t[1] for t in micro.DICT}
    totals = {}
    for term in set(terms):
        for termid, docid, tf in postings:
            for d in docs:
                if termid == ids[term] and d[0] == docid:
                    s = log10(len(docs) / (1 + df[termid])) * (tf * 2.5)
                    s /= tf + 1.5 * (0.25 + 0.75 * (d[2] / avgdl))
                    totals[docid] = totals.get(docid, 0) + s
    return sorted(
        (0, docid, round(s, 9), d[1]) for docid, s in totals.items() for d in docs if d[0] == docid
    )


def test_repeated_documents_repeat_rows(spark):
    docs = [*micro.DOCS, (0, "again", 14), (0, "twin", 10)]
    postings = [*micro.POSTINGS, (2, 0, 2), (2, 0, 1)]
    index = micro.index(spark, docs, postings, unique=False)
    got = rank.bm25(index, micro.queries(spark, ["c", "e"]))
    assert rows(got) == brute_force(docs, postings, ["c", "e"])
    best = rank.bm25(index, micro.queries(spark, ["c", "e"]), k=2)
    assert [(r[1], r[3]) for r in rows(best)] == [(0, "again"), (0, "d0")]


@pytest.fixture(scope="module")
def corpus_index(spark):
    draw = random.Random(5)
    words = [f"{a}{b}" for a in "abcdef" for b in "xyz"]
    texts = ["the " + " ".join(draw.choices(words, k=draw.randint(0, 12))) for _ in range(150)]
    return write_index(
        build_index(micro.corpus(spark, texts)), new_folder(spark, "ranked"), Layout("shift", 2)
    )


@pytest.fixture(scope="module")
def asked(spark):
    return micro.queries(spark, ["the", "ax"], ["ax", "by", "by", "cz"], ["none"], ["the"])


def test_all_shapes_agree(spark, corpus_index, asked):
    plain = rows(rank.bm25(corpus_index, asked, k=10))
    for options in ({"prune": "join"}, {"prune": None}, {"use_docs": True}):
        assert rows(rank.bm25(corpus_index, asked, k=10, **options)) == plain
    every = rows(rank.bm25(corpus_index, asked))
    filtered = rank.bm25_from_filtered(corpus_index, asked).withColumn("name", F.concat(F.lit("d"), "docid"))
    assert rows(filtered) == every
    assert [tuple(r) for r in rank.sorted_results(rank.bm25(corpus_index, asked)).select("qno", "docid").collect()] == [
        (q, d) for q, _, d in sorted((q, -s, d) for q, d, s, _ in every)
    ]


@pytest.mark.parametrize("local, small", [(0, 10**6), (0, 0)])
def test_large_batches_take_other_joins_to_the_same_rows(
    spark, corpus_index, asked, monkeypatch, local, small
):
    plain = rows(rank.bm25(corpus_index, asked, k=10))
    every = rows(rank.bm25(corpus_index, asked, use_docs=True))
    lists = rows(rank.bm25_per_term(corpus_index, asked))
    found = sorted(map(tuple, rank.filtered_postings(corpus_index, asked).collect()))
    monkeypatch.setattr(lookup, "MAX_LOCAL_ROWS", local)
    monkeypatch.setattr(rank, "MAX_BROADCAST_ROWS", small)
    monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", small)
    monkeypatch.setattr(skew, "SLOTS", 4)
    for prune in ("constants", "join", None):
        assert rows(rank.bm25(corpus_index, asked, k=10, prune=prune)) == plain
    assert rows(rank.bm25(corpus_index, asked, use_docs=True)) == every
    assert rows(rank.bm25_per_term(corpus_index, asked)) == lists
    assert sorted(map(tuple, rank.filtered_postings(corpus_index, asked).collect())) == found


def test_many_results_per_query(corpus_index, asked, monkeypatch):
    plain = rows(rank.bm25(corpus_index, asked, k=40))
    monkeypatch.setattr(rank, "MAX_TRIMMED_BY_SPARK", 3)
    assert rows(rank.bm25(corpus_index, asked, k=40)) == plain


def test_more_tasks_for_more_rows(corpus_index, asked, monkeypatch):
    plain = rows(rank.bm25(corpus_index, asked, k=10))
    monkeypatch.setattr(rank, "PAIRS_PER_TASK", 20)
    result = rank.bm25(corpus_index, asked, k=10)
    scores = rank.ranked(rank.doc_scores(rank.term_scores(corpus_index, asked)), 10)
    assert "REPARTITION_BY_NUM" in scores._jdf.queryExecution().executedPlan().toString()
    assert rows(result) == plain


def test_long_word_lists(corpus_index, asked, monkeypatch):
    short = sorted(map(tuple, lookup.docs_for_terms(corpus_index, asked).collect()))
    monkeypatch.setattr(lookup, "MAX_LOCAL_ROWS", 0)
    assert sorted(map(tuple, lookup.docs_for_terms(corpus_index, asked).collect())) == short
    monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "SLOTS", 4)
    assert sorted(map(tuple, lookup.docs_for_terms(corpus_index, asked).collect())) == short


def test_plan_has_one_shuffle_of_scores_and_no_cartesian_product(corpus_index, asked):
    scores = rank.ranked(rank.doc_scores(rank.term_scores(corpus_index, asked)), 10)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(docid") == 1
    assert "hashpartitioning(qno" in plan and "WindowGroupLimit" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert "Python" not in plan


def test_lookup_shapes(spark, corpus_index):
    words = ["the", "ax", "none"]
    expected = sorted(map(tuple, lookup.terms_in(corpus_index.dict, words).collect()))
    assert len(expected) == 2
    for found in (
        lookup.terms_in(corpus_index.dict, words, keyed=True),
        lookup.terms_or(corpus_index.dict, words),
        lookup.terms_or(corpus_index.dict, words, keyed=False),
        lookup.terms_union(corpus_index.dict, words),
        lookup.terms_union(corpus_index.dict, words, keyed=True),
    ):
        assert sorted(map(tuple, found.collect())) == expected


def test_term_ids_and_documents(spark, corpus_index):
    words = micro.queries(spark, ["the", "none", "the"])
    found = {r["word"]: (r["known"], r["termid"]) for r in lookup.term_ids(corpus_index.dict, words).collect()}
    assert found["none"] == (False, -1) and found["the"][0]
    docs = lookup.docs_for_terms(corpus_index, words).collect()
    assert len(docs) == 150 and {r["word"] for r in docs} == {"the"}


def test_pairs_keep_their_tasks(spark):
    """Adaptive execution merged the tasks by the bytes of the postings, which are few before they meet queries."""
    scored = spark.range(10_000).withColumnRenamed("id", "docid")
    assert rank._by_document(scored, 5 * rank.PAIRS_PER_TASK).rdd.getNumPartitions() >= 5
    assert rank._by_document(scored, 10).rdd.getNumPartitions() == 1

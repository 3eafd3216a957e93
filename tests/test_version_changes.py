from collections import Counter

import micro
import pytest

from termspire.operators import rank
from termspire.operators import versions as v
from termspire.operators.index_build import build_index
from termspire.plans import staging
from termspire.plans.staging import new_folder
from termspire.sources import create_bucketed_tables, literal_queries, read_tables

BEFORE = ["the cat sat", "a dog the the", "", "only here"]
AFTER = ["a the cat", "the dog the the", "zebra", None, "new cat"]


def terms(text):
    return Counter((text or "").split())


def expected():
    old = {(t, d): n for d, x in enumerate(BEFORE) for t, n in terms(x).items()}
    new = {(t, d): n for d, x in enumerate(AFTER) for t, n in terms(x).items()}
    kind = lambda a, b: "gained" if a is None else "lost" if b is None else "same" if a == b else "changed"
    postings = sorted((t, d, old.get((t, d)), new.get((t, d)), kind(old.get((t, d)), new.get((t, d)))) for t, d in {*old, *new})
    df = [Counter(t for t, _ in side) for side in (old, new)]
    dicts = sorted((t, df[0].get(t), df[1].get(t), kind(df[0].get(t), df[1].get(t))) for t in {*df[0], *df[1]})
    return postings, dicts


@pytest.mark.parametrize("small", [True, False])
def test_against_brute_force(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(staging, "MAX_BROADCAST_ROWS", 0)
    before, after = build_index(micro.corpus(spark, BEFORE)), build_index(micro.corpus(spark, AFTER))
    postings, dicts = expected()
    key = lambda row: tuple(x if x is not None else -1 for x in row)
    assert sorted(map(tuple, v.compared_postings(before, after).collect()), key=key) == sorted(postings, key=key)
    assert sorted(map(tuple, v.changed_terms(before, after).collect()), key=key) == sorted(
        (r for r in dicts if r[3] != "same"), key=key
    )
    report = Counter({("dict", c): n for c, n in Counter(r[3] for r in dicts).items()})
    report.update({("postings", c): n for c, n in Counter(r[4] for r in postings).items()})
    assert {(r.table_name, r.change): r.rows for r in v.change_report(before, after).collect()} == dict(report)


def test_empty_versions(spark):
    index = build_index(micro.corpus(spark, BEFORE))
    none = build_index(micro.corpus(spark, BEFORE).limit(0))
    assert {r.change for r in v.changed_terms(none, index).collect()} == {"gained"}
    assert {r.change for r in v.compared_postings(index, none).collect()} == {"lost"}
    assert v.change_report(none, none).count() == 0


@pytest.mark.parametrize("copies", [1, 2])
def test_bucketed_tables_join_documents_where_they_are(spark, monkeypatch, copies):
    docs = micro.corpus(spark, [f"{t or ''} w{n}" for n, t in enumerate(BEFORE * 20)])
    index = build_index(docs if copies == 1 else docs.union(docs))
    root = new_folder(spark, "bucketed")
    database = "bucketed_" + root.rsplit("-", 1)[-1]
    create_bucketed_tables(index, database, root, 4)
    tables = read_tables(spark, database)
    assert tables.unique_docs == (copies == 1)
    asked = literal_queries(spark, [["the", "cat"], ["w3", "dog"]])
    key = lambda frame: sorted((r.qno, r.docid, round(r.bm25score, 7), r["name"]) for r in frame.collect())
    assert key(rank.bm25(tables, asked, use_docs=True)) == key(rank.bm25(index, asked, use_docs=True))
    # Beyond the size of a broadcast the join by docid is merged in place: no exchange below it.
    monkeypatch.setattr(rank, "MAX_BROADCAST_ROWS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        terms = rank.resolve_terms(tables, asked)
        if copies == 1:
            found = rank.postings_of(tables, terms)
            joined = rank._with_document_length(tables, found.select("termid", "docid", "tf", "df"), 1000)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            docs_side = plan[plan.index("SortMergeJoin") :]
            assert "bucketed" in docs_side.lower() and docs_side.count("Exchange hashpartitioning(docid") == 0
        assert key(rank.bm25(tables, asked, use_docs=True)) == key(rank.bm25(index, asked, use_docs=True))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP DATABASE {database} CASCADE")

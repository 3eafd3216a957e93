import os
import random

import micro
import pytest

from termspire import Layout
from termspire.operators.index_build import build_index
from termspire.operators.rank import bm25
from termspire.plans.staging import new_folder
from termspire.sinks import append_documents, compact, drop_superseded, segment_report, write_index
from termspire.sources import create_tables, literal_queries, read_index

LAYOUTS = [Layout("shift", 3), Layout("hash", 5), Layout()]
BATCHES = [
    ["the cat sat", "a dog and a cat", "zebra apple the", ""],
    ["new words here", "the zebra", None, "Äpfel cat cat"],
    ["0 ...", "here again the mouse", "apple"],
]


def documents(spark, batch):
    first = sum(len(b) for b in BATCHES[:batch])
    rows = [(first + n, t) for n, t in enumerate(BATCHES[batch])]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def grown(spark, layout):
    root = new_folder(spark, "segments")
    write_index(build_index(documents(spark, 0)), root, layout)
    for batch in (1, 2):
        append_documents(spark, root, documents(spark, batch))
    return root


def whole(spark):
    return build_index(documents(spark, 0).union(documents(spark, 1)).union(documents(spark, 2)))


def by_term(index):
    """Postings and frequencies named by term, since ids are given in another order."""
    terms = index.dict.select("term", "termid", "df", "crange")
    rows = index.postings.join(terms, "termid").select("term", "docid", "tf", "len", "df", "crange")
    return sorted(map(tuple, rows.collect()))


def files(root):
    """Postings files by bucket folder, with their times."""
    found = {}
    for folder, _, names in os.walk(root.removeprefix("file:")):
        if "/postings" in folder:
            for name in names:
                if name.endswith(".parquet"):
                    path = f"{folder}/{name}"
                    found[path] = os.stat(path).st_mtime_ns
    return found


def ranking(index, spark):
    queries = literal_queries(spark, [["the", "cat"], ["zebra", "here"], ["apfel", "none"]])
    return [(r.qno, r.docid, round(r.bm25score, 9), r["name"], r["rank"]) for r in bm25(index, queries, 5).orderBy("qno", "rank").collect()]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_added_documents_equal_one_build(spark, layout):
    root = grown(spark, layout)
    index, want = read_index(spark, root), whole(spark)
    assert by_term(index) == by_term(want)
    assert sorted(map(tuple, index.docs.collect())) == sorted(map(tuple, want.docs.collect()))
    assert tuple(index.stats.first()) == tuple(want.stats.first()) and index.unique_docs
    assert index.dict.count() == index.dict.select("termid").distinct().count() == want.dict.count()
    assert ranking(index, spark) == ranking(want, spark)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_compaction_rewrites_touched_buckets_only(spark, layout):
    root = grown(spark, layout)
    want, before = ranking(read_index(spark, root), spark), files(root)
    reader = read_index(spark, root)
    done = compact(spark, root)
    assert done.merged == 2
    assert ranking(read_index(spark, root), spark) == want == ranking(reader, spark)
    drop_superseded(spark, root)
    index, after = read_index(spark, root), files(root)
    assert ranking(index, spark) == want and by_term(index) == by_term(whole(spark))
    kept = {path for path in after if path in before}
    assert all(after[p] == before[p] for p in kept)
    if layout.kind == "none":
        assert done.buckets is None and not kept
    else:
        # What is left of the first files is all of them but the touched buckets'.
        first = [p for p in before if "/version-" in p]
        assert kept == {p for p in first if int(p.split("thash=")[1].split("/")[0]) not in done.buckets}
    # A second round on top of a compaction.
    append_documents(spark, root, documents(spark, 0).selectExpr("doc_id + 100 AS doc_id", "text"))
    assert compact(spark, root).merged == 2
    drop_superseded(spark, root)
    both = build_index(documents(spark, 0).union(documents(spark, 1)).union(documents(spark, 2)).union(
        documents(spark, 0).selectExpr("doc_id + 100 AS doc_id", "text")))
    assert by_term(read_index(spark, root)) == by_term(both)
    assert compact(spark, root).merged == 1


def test_untouched_buckets_stay(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{chr(97 + a)}{chr(97 + b)}" for a in range(12) for b in range(12)], k=30)) for _ in range(60)]
    root = new_folder(spark, "segments")
    write_index(build_index(micro.corpus(spark, texts)), root, Layout("shift", 3))
    before = files(root)
    append_documents(spark, root, spark.createDataFrame([(900, "waa wab waa")], "doc_id bigint, text string"))
    assert compact(spark, root).buckets == [0]
    drop_superseded(spark, root)
    after = files(root)
    assert len([p for p in before if p in after and before[p] == after[p]]) >= len(before) - 2 > 5


def test_a_failed_append_leaves_the_index_as_it_was(spark, monkeypatch):
    from termspire.sinks import segments

    root = grown(spark, Layout("hash", 3))
    want = ranking(read_index(spark, root), spark)

    def fails(*rest):
        raise OSError("no space")

    monkeypatch.setattr(segments, "write_postings", fails)
    for act in (lambda: append_documents(spark, root, documents(spark, 0)), lambda: compact(spark, root)):
        with pytest.raises(OSError):
            act()
        assert ranking(read_index(spark, root), spark) == want


def test_repeated_ids_empty_batches_and_the_report(spark):
    root = grown(spark, Layout("hash", 3))
    assert append_documents(spark, root, documents(spark, 0).limit(0)).unique_docs
    index = append_documents(spark, root, documents(spark, 0))
    assert not index.unique_docs and index.stats.first()["num_docs"] == 15
    report = [tuple(r) for r in segment_report(spark, root).orderBy("segment").collect()]
    assert [r[:2] for r in report] == [(0, 4), (1, 4), (2, 3), (3, 0), (4, 4)]
    assert report[3][2:] == (0, 0, 0) and report[4][4] == 0 and report[0][3] == report[0][4]
    assert sum(r[4] for r in report) == index.dict.count() and sum(r[2] for r in report) == index.postings.count()
    with pytest.raises(ValueError, match="compact"):
        create_tables(spark, "segmented", root)


def test_an_empty_index_grows(spark):
    root = new_folder(spark, "segments")
    write_index(build_index(documents(spark, 0).limit(0)), root, Layout("hash", 3))
    index = append_documents(spark, root, documents(spark, 1))
    assert by_term(index) == by_term(build_index(documents(spark, 1)))
    assert index.stats.first()["num_docs"] == 4

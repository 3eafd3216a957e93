import micro

import pytest

from termspire import Layout
from termspire.operators import rank
from termspire.operators.index_build import build_index
from termspire.plans.staging import new_folder
from termspire.sinks import append_documents, compact, drop_superseded, write_index
from termspire.sinks.views import drop_old_views, publish_views, read_views
from termspire.sources import literal_queries, read_index

TEXTS = ["the cat sat", "a dog and a cat", "the zebra and a cat", "new words", "the the end", "cat"]


def kept(index, spark):
    found = rank.bm25(index, literal_queries(spark, [["the", "cat"], ["words"]]), 4)
    return [(r.qno, r.docid, round(r.bm25score, 9), r["name"]) for r in found.orderBy("qno", "rank").collect()]


@pytest.mark.parametrize("layout", [Layout("shift", 2), Layout("hash", 3), Layout()])
def test_readers_keep_their_state_and_new_ones_see_the_next(spark, layout):
    root = new_folder(spark, "published")
    database = "views_" + root.rsplit("-", 1)[-1]
    docs = micro.corpus(spark, TEXTS)
    try:
        write_index(build_index(docs.where("doc_id < 3")), root, layout)
        publish_views(spark, database, root)
        first = read_views(spark, database)
        before = kept(first, spark)
        assert before == kept(read_index(spark, root), spark) and first.layout == layout
        append_documents(spark, root, docs.where("doc_id >= 3"))
        assert kept(read_views(spark, database), spark) == before  # not published yet
        publish_views(spark, database, root)
        second = read_views(spark, database)
        after = kept(build_index(docs), spark)
        assert kept(second, spark) == after and kept(first, spark) == before
        # Readers of the state before the compaction go on, too.
        compact(spark, root)
        publish_views(spark, database, root)
        third = read_views(spark, database)
        assert kept(third, spark) == after and kept(second, spark) == after and kept(first, spark) == before
        state = spark.table(f"{database}.current_index").first().state
        drop_old_views(spark, database)
        drop_superseded(spark, root)
        left = {t.name for t in spark.catalog.listTables(database)}
        assert {f"{n}_{state}" for n in ("postings", "dict", "docs", "stats")} < left
        assert sum("_s" + state[1:] in n for n in left) == 4 and kept(read_views(spark, database), spark) == after
        by_sql = spark.sql(f"SELECT count(*) AS n FROM {database}.docs_{state}").first().n
        assert by_sql == len(TEXTS)
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")

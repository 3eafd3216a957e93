import micro
import pytest
from pyspark.sql import functions as F

from termspire import Layout
from termspire.operators import rank
from termspire.operators.index_build import build_index
from termspire.plans.staging import folders, new_folder
from termspire.sinks import append_documents, compact, drop_old_versions, drop_superseded, write_index
from termspire.sources import literal_queries, read_index, store_session

TEXTS = ["the cat sat", "a dog and a cat", "the zebra", "new words"]


def kept(index, spark):
    found = rank.bm25(index, literal_queries(spark, [["the", "cat"]]), 3)
    return [(r.docid, round(r.bm25score, 9), r["name"]) for r in found.orderBy("rank").collect()]


def test_an_index_in_a_store_that_one_session_knows(spark):
    folder = new_folder(spark, "store").removeprefix("file://")
    settings = {"fs.viewfs.mounttable.ownstore.link./kept": f"file://{folder}"}
    root = "viewfs://ownstore/kept/index"
    with pytest.raises(Exception, match="ownstore|mount"):
        read_index(spark, root)
    store = store_session(spark, settings)
    docs = micro.corpus(store, TEXTS)
    write_index(build_index(docs.where("doc_id < 2")), root, Layout("hash", 3))
    first = write_index(build_index(docs.where("doc_id < 2")), root, Layout("hash", 3))
    assert sum(n.startswith("version-") for n in folders(store, root)) == 2
    drop_old_versions(store, root)
    assert sum(n.startswith("version-") for n in folders(store, root)) == 1 and first.dict.count() == 6
    append_documents(store, root, docs.where(F.col("doc_id") >= 2))
    want = kept(build_index(docs), store)
    assert kept(read_index(store, root), store) == want
    compact(store, root)
    drop_superseded(store, root)
    assert kept(read_index(store, root), store) == want
    # The same files by their own path, without the settings.
    assert kept(read_index(spark, f"file://{folder}/index"), spark) == want
    assert spark.conf.get("fs.viewfs.mounttable.ownstore.link./kept", None) is None

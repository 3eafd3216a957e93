import random

import pytest
from pyspark.sql import functions as F

import micro
from termspire import Layout, schemas
from termspire.model import Index
from termspire.operators import lookup, profile, rank
from termspire.operators.index_build import build_index
from termspire.operators.layout import choose_shift, choose_shift_by_dict, layout_hash, layout_shift, with_lengths
from termspire.plans.staging import new_folder
from termspire.sinks import write_index, write_parquet
from termspire.sources import (
    create_tables,
    read_folder,
    read_index,
    read_tables,
    register_views,
    temporary_table,
)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def written(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    built = build_index(documents)
    return {
        layout.kind: write_index(built, new_folder(spark, "t"), layout)
        for layout in (Layout(), Layout("hash", 40), Layout("shift", 10))
    }


def test_round_trip(spark, written):
    for kind, index in written.items():
        assert index.layout.kind == kind
        assert index.has_lengths and index.unique_docs
        assert index.dict.schema == schemas.DICT
        assert ("thash" in index.postings.columns) == (kind != "none")
    reference = written["none"].postings
    for kind in ("hash", "shift"):
        other = written[kind].postings.drop("thash").select(*reference.columns)
        assert other.exceptAll(reference).count() == 0 and reference.exceptAll(other).count() == 0


def test_each_term_is_in_its_bucket_only(written):
    for kind in ("hash", "shift"):
        index = written[kind]
        wrong = index.postings.where(F.col("thash") != index.layout.bucket(F.col("termid")))
        assert wrong.count() == 0


def test_dict_is_sorted(written):
    rows = written["none"].dict.select("crange", "termid").collect()
    assert rows == sorted(rows)


def test_postings_files_are_sorted(written):
    import pyarrow.parquet as pq

    for index in written.values():
        for path in index.postings.inputFiles():
            rows = pq.ParquetFile(path.removeprefix("file://")).read(["termid", "docid"]).to_pylist()
            pairs = [(r["termid"], r["docid"]) for r in rows]
            assert pairs == sorted(pairs)


def test_constant_bucket_reaches_the_scan(written):
    text = plan(lookup.docs_of_term_id(written["hash"], 7))
    assert "PartitionFilters: [" in text and "(thash#" in text
    assert "EqualTo(termid,7)" in text


def test_keyed_lookup_reaches_the_scan(written):
    text = plan(lookup.terms_in(written["none"].dict, ["the", "and"], keyed=True))
    assert "In(crange, [" in text and "In(term, [" in text


def test_ranking_prunes_by_constants_and_by_join(spark, written):
    asked = micro.queries(spark, ["the", "and"])
    constants = plan(rank.term_scores(written["shift"], asked))
    assert "PartitionFilters: [thash#" in constants
    joined = plan(rank.term_scores(written["shift"], asked, prune="join"))
    assert "dynamicpruning" in joined
    sorted_only = plan(rank.term_scores(written["none"], asked))
    assert "PushedFilters: [In(termid, [" in sorted_only
    with pytest.raises(ValueError):
        rank.bm25(written["none"], asked, prune="nothing")
    control = plan(rank.term_scores(written["shift"], asked, prune=None))
    assert "PartitionFilters: []" in control and "dynamicpruning" not in control


def test_names_of_the_best_are_read_by_docid(spark, written):
    text = plan(rank.bm25(written["shift"], micro.queries(spark, ["the", "and"]), k=5))
    assert "PushedFilters: [In(docid, [" in text


def test_documents_of_words_are_read_by_term(spark, written):
    words = spark.createDataFrame([("the",), ("nothing-like-it",)], "qterm string")
    text = plan(lookup.docs_for_terms(written["shift"], words))
    assert "EqualTo(termid," in text or "In(termid, [" in text
    assert "PartitionFilters: [" in text and "(thash#" in text


def test_pruning_by_join_stays_when_the_batch_is_large(spark, written, monkeypatch):
    asked = micro.queries(spark, ["the", "and"])
    expected = sorted(map(tuple, rank.bm25(written["shift"], asked).select("qno", "docid").collect()))
    monkeypatch.setattr(rank, "MAX_BROADCAST_ROWS", 0)
    assert "PartitionFilters: [thash#" in plan(rank.term_scores(written["shift"], asked, prune="join"))
    found = rank.bm25(written["shift"], asked, prune="join")
    assert sorted(map(tuple, found.select("qno", "docid").collect())) == expected


@pytest.mark.parametrize(
    "rows, top, size, expected",
    [
        (10, 100, 100 << 20, 7),  # under one bucket: 2^7 > 100
        (1_000, 66_305, 1_000, 13),  # 16 buckets of 4144 ids: 2^13 > 4144
        (1_000, 1 << 40, 1_000, 37),  # as far as it takes
    ],
)
def test_choose_shift(spark, rows, top, size, expected):
    postings = spark.range(rows).select(
        F.when(F.col("id") == 0, F.lit(top)).otherwise(F.col("id") % 5).alias("termid")
    )
    assert choose_shift(postings, bucket_bytes=size).first()["shift"] == expected


def test_choose_shift_bounds_the_folders(spark):
    postings = spark.range(1_000).select(F.col("id").alias("termid"))
    assert choose_shift(postings, bucket_bytes=16, max_buckets=4).first()["shift"] == 8
    large = postings.select(F.col("termid") + F.lit(1 << 40).alias("termid")).toDF("termid")
    assert choose_shift(large, bucket_bytes=16, max_buckets=4).first()["shift"] == 39
    assert choose_shift(large, bucket_bytes=16, max_buckets=4, max_shift=20).first()["shift"] is None


def test_choose_shift_by_dict(spark):
    index = micro.index(spark)
    for size in (1, 16, 100, 1 << 20):
        by_dict = choose_shift_by_dict(index.dict, bucket_bytes=size).first()
        assert by_dict == choose_shift(index.postings, bucket_bytes=size).first()


def test_layouts_add_the_bucket_once(spark):
    postings = micro.index(spark).postings
    assert layout_shift(layout_hash(postings, 4), 2).columns == [*postings.columns, "thash"]


def test_lengths_beside_postings(spark):
    index = with_lengths(micro.index(spark))
    lengths = dict((d[0], d[2]) for d in micro.DOCS)
    assert all(r["len"] == lengths[r["docid"]] for r in index.postings.collect())
    raw = micro.index(spark, unique=False)
    assert with_lengths(raw) is raw


def test_catalog_and_views(spark, written):
    root = new_folder(spark, "catalog")
    write_index(written["shift"], root, Layout("shift", 10))
    create_tables(spark, "version_one", root)
    index = read_tables(spark, "version_one")
    assert index.layout == Layout("shift", 10) and index.unique_docs
    assert index.postings.count() == written["none"].postings.count()
    register_views(index, "v_")
    assert spark.sql("SELECT num_docs FROM v_stats").first()[0] == 200


def test_an_index_knows_its_layout(spark, written):
    shift = written["shift"]
    with pytest.raises(ValueError):
        Index(shift.postings, shift.dict, shift.docs, shift.stats)
    root = new_folder(spark, "catalog")
    write_index(micro.index(spark, unique=False), root, Layout("hash", 3))
    create_tables(spark, "version_raw", root)
    raw = read_tables(spark, "version_raw")
    assert raw.layout == Layout("hash", 3) and not raw.unique_docs


def test_folder_with_typed_keys(spark):
    from pyspark.sql import types as T

    root = new_folder(spark, "folder")
    rows = [("7f", "r1", "t", 2024, "eng"), ("7f", "r2", "t", 2024, "deu")]
    df = spark.createDataFrame(rows, "id string, record_id string, title string, year int, language string")
    df.write.partitionBy("year", "language").parquet(root)
    keys = T.StructType(
        [T.StructField("year", T.ShortType()), T.StructField("language", T.StringType())]
    )
    whole = read_folder(spark, root, schemas.METADATA, keys)
    assert whole.schema["year"].dataType == T.ShortType()
    one = read_folder(spark, root, schemas.METADATA, keys, "year=2024/language=en*")
    assert [tuple(r) for r in one.collect()] == [("7f", "r1", "t", 2024, "eng")]


def test_overwriting_some_folders(spark):
    root = new_folder(spark, "replace")
    write_parquet(spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), root, "k")
    write_parquet(spark.createDataFrame([(3, "a")], "v int, k string"), root, "k")
    assert sorted(map(tuple, spark.read.parquet(root).collect())) == [(2, "b"), (3, "a")]


def test_temporary_table(spark):
    kept = temporary_table(micro.queries(spark, ["a", "b"]), "kept_query")
    assert spark.sql("SELECT count(*) FROM kept_query").first()[0] == 2
    kept.unpersist()


def test_reports(written):
    index = written["shift"]
    counts = {r["table_name"]: r["row_count"] for r in profile.row_counts(index).collect()}
    assert counts["docs"] == 200 and counts["stats"] == 1
    files = profile.file_layout(index.postings, "thash").collect()
    assert sum(r["rows"] for r in files) == counts["postings"]
    assert all(r["files"] >= 1 and r["bytes"] > 0 for r in files)
    assert [r["docid"] for r in profile.sample_rows(index.docs, 3, "docid").collect()] == [0, 1, 2]
    assert profile.sample_rows(index.docs, 3).count() == 3


def test_a_hot_bucket_is_written_by_several_tasks(spark):
    """One term owns most postings: its bucket is cut into several files, each a range of docids."""
    rows = spark.range(5_000).select(
        F.lit(3).cast("long").alias("termid"), F.col("id").alias("docid"), F.lit(1).alias("tf")
    )
    hot = micro.index(spark)
    from termspire import Index

    terms = spark.createDataFrame([("hot", 3, 5_000, 10)], schemas.DICT)
    index = write_index(
        Index(rows, terms, hot.docs, hot.stats),
        new_folder(spark, "hot"),
        Layout("hash", 4),
        postings_per_file=1_000,
    )
    files = profile.file_layout(index.postings, "thash").collect()
    assert len(files) == 1 and files[0]["files"] >= 4 and files[0]["rows"] == 5_000


def test_packed_postings_are_small_and_whole(spark):
    rng = random.Random(31)
    texts = [" ".join(rng.choices([f"w{chr(97 + n // 26)}{chr(97 + n % 26)}" for n in range(400)], k=60)) for _ in range(1500)]
    docs = micro.corpus(spark, texts).select((F.col("doc_id") * 1_000_003 - 5_000).alias("doc_id"), "text")
    built = build_index(docs)
    index = write_index(built, new_folder(spark, "packed"), Layout("shift", 8))
    columns = ["termid", "docid", "tf", "len"]
    assert sorted(map(tuple, index.postings.select(columns).collect())) == sorted(map(tuple, built.postings.select(columns).collect()))
    rows, size = profile.file_layout(index.postings, "thash").agg(F.sum("rows"), F.sum("bytes")).first()
    assert size < 8 * rows

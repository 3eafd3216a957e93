"""One entry per operator or job; each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termspire import schemas
from termspire.functions.keys import register_sql_functions
from termspire.model import Layout
from termspire.operators import batch, block_max, duplicates, lookup, profile, rank, sampling, tokens, versions
from termspire.operators.scan_report import scan_report as report_scans
from termspire.operators.index_build import build_index
from termspire.operators.layout import choose_shift, choose_shift_by_dict, layout_shift, with_lengths
from termspire.plans.staging import new_folder
from termspire.registered.fixtures import (
    HASH_BUCKETS,
    PROBE_TERMS,
    SAMPLE_QUERIES,
    SAMPLE_SEED,
    SAMPLE_SIZE,
    ABSENT_WORDS,
    benchmark_queries,
    compacted_index,
    document_impacts,
    document_index,
    fixed_index,
    grown_index,
    hashed_index,
    once,
    probe_queries,
    raw_index,
    table,
)
from termspire.sinks import drop_old_versions, publish_views, segment_report, write_csv, write_index, write_parquet
from termspire.sources import (
    create_tables,
    literal_queries,
    number_queries,
    read_folder,
    read_index,
    read_parquet,
    read_query_log,
    read_query_sample,
    read_tables,
    register_views,
    store_session,
    temporary_table,
)

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}


def query(function: Query) -> Query:
    _registry[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_registry)


def _scores(df: DataFrame) -> DataFrame:
    """Results as they are compared: scores to six decimals, the rank as a long where there is one."""
    df = df.withColumn("bm25score", F.round("bm25score", 6))
    return df.withColumn("rank", F.col("rank").cast("long")) if "rank" in df.columns else df


def entry(spark: SparkSession) -> DataFrame:
    return bm25_top20(spark, "/root/testdata/sf0.001")


# ---------------------------------------------------------------- tables, layouts, sources, sinks


@query
def index_dict(spark, sf_dir):
    terms = document_index(spark, sf_dir).dict
    return terms.select("term", "termid", "df", F.col("crange").cast("long").alias("crange"))


@query
def index_postings(spark, sf_dir):
    postings = document_index(spark, sf_dir).postings
    return postings.select("termid", "docid", F.col("tf").cast("long").alias("tf"))


@query
def index_docs(spark, sf_dir):
    return document_index(spark, sf_dir).docs


@query
def index_stats(spark, sf_dir):
    stats = document_index(spark, sf_dir).stats
    return stats.select("num_docs", F.round("avgdl", 6).alias("avgdl"))


@query
def postings_with_lengths(spark, sf_dir):
    """Lengths joined to postings that lack them."""
    return with_lengths(hashed_index(spark, sf_dir)).postings.select("termid", "docid", "len")


@query
def shift_layout(spark, sf_dir):
    """What each bucket of the order-preserving layout holds."""
    keyed = layout_shift(document_index(spark, sf_dir).postings, shift=12)
    return keyed.groupBy(F.col("thash").cast("long").alias("thash")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("termid").alias("first_termid"),
        F.max("termid").alias("last_termid"),
    )


@query
def hash_layout(spark, sf_dir):
    """How many buckets of the hash layout hold each term (one), and its postings."""
    postings = hashed_index(spark, sf_dir).postings
    per_bucket = postings.groupBy("termid", "thash").agg(F.count(F.lit(1)).alias("rows"))
    return per_bucket.groupBy("termid").agg(
        F.count(F.lit(1)).alias("buckets"), F.sum("rows").alias("rows")
    )


@query
def shift_choice(spark, sf_dir):
    """The shift for several bucket sizes."""
    return _shifts(choose_shift, document_index(spark, sf_dir).postings)


@query
def shift_choice_by_dict(spark, sf_dir):
    """The same, from the dictionary alone."""
    return _shifts(choose_shift_by_dict, document_index(spark, sf_dir).dict)


def _shifts(choose, source):
    choices = [
        choose(source, bucket_bytes=size).select(
            F.lit(size).cast("long").alias("bucket_bytes"), F.col("shift").cast("long").alias("shift")
        )
        for size in (64 << 10, 256 << 10, 100 << 20)
    ]
    return reduce(DataFrame.union, choices)


@query
def bucket_scan(spark, sf_dir):
    """Documents of one term id, read from its bucket only."""
    index = hashed_index(spark, sf_dir)
    termid = index.dict.where(F.col("term") == "the").first()["termid"]
    return lookup.docs_of_term_id(index, termid)


@query
def shift_bucket_scan(spark, sf_dir):
    """The rows of one bucket by a condition on its range of term ids and on the bucket itself."""
    index = document_index(spark, sf_dir)
    termid = index.dict.where(F.col("term") == "the").first()["termid"]
    bucket = index.layout.bucket(F.lit(termid).cast("long"))
    return index.postings.where(F.col("thash") == bucket).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("tf").alias("tokens")
    )


def _metadata_root(spark, sf_dir):
    """Pages as crawl metadata, in folders by date and language; the id is the host, so it repeats.

    The pages have no date, so their numbers stand for six days in two months.
    """

    def make():
        pages = table(spark, sf_dir, "pages")
        metadata = pages.select(
            F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("id"),
            F.col("page_id").cast("string").alias("record_id"),
            F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
            F.lit(2024).alias("year"),
            (F.col("page_id") % 2 + 1).cast("int").alias("month"),
            (F.col("page_id") % 3 + 1).cast("int").alias("day"),
            F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("language"),
        )
        root = new_folder(spark, "metadata")
        write_parquet(metadata, root, "year", "month", "day", "language")
        return root

    return once(spark, sf_dir, "metadata", make)


_FOLDERS = T.StructType(
    [T.StructField(key, T.IntegerType(), True) for key in ("year", "month", "day")]
    + [T.StructField("language", T.StringType(), True)]
)


@query
def folder_scan(spark, sf_dir):
    """Records per date and language, which are read from the folder names."""
    root = _metadata_root(spark, sf_dir)
    records = read_folder(spark, root, schemas.METADATA, _FOLDERS)
    return records.groupBy("year", "month", "day", "language").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("id").alias("ids")
    )


@query
def captures(spark, sf_dir):
    """All English records of one month of the most frequent host, from their folders only."""
    root = _metadata_root(spark, sf_dir)
    folders = "year=2024/month=2/day=*/language=en"
    english = read_folder(spark, root, schemas.METADATA, _FOLDERS, folders)
    host = F.regexp_extract("url", "^https?://([^/]+)/", 1)
    pages = table(spark, sf_dir, "pages")
    record = pages.groupBy(host.alias("id")).count().orderBy(F.desc("count"), "id").first()["id"]
    return duplicates.captures(english, record)


@query
def catalog_ranking(spark, sf_dir):
    """Ranking over the tables of a database whose location is the index folder."""

    def make():
        source = document_index(spark, sf_dir)
        root = new_folder(spark, "catalog")
        write_index(source, root, Layout("shift", 12))
        database = "index_" + root.rsplit("-", 1)[-1]
        create_tables(spark, database, root)
        return database

    database = once(spark, sf_dir, "catalog", make)
    return _scores(rank.bm25(read_tables(spark, database), probe_queries(spark), k=20))


@query
def catalog_raw_ranking(spark, sf_dir):
    """The same over an index in which documents occur several times: its record says so."""

    def make():
        root = new_folder(spark, "catalog-raw")
        write_index(raw_index(spark, sf_dir), root, Layout("hash", HASH_BUCKETS))
        database = "index_" + root.rsplit("-", 1)[-1]
        create_tables(spark, database, root)
        return database

    database = once(spark, sf_dir, "catalog-raw", make)
    return _scores(rank.bm25(read_tables(spark, database), probe_queries(spark), k=20))


@query
def sql_ranking(spark, sf_dir):
    """The batch ranked in SQL, over the views, with the two key functions. Postings carry lengths."""
    index = document_index(spark, sf_dir)
    register_views(index)
    register_sql_functions(spark, index.layout.param)
    temporary_table(probe_queries(spark).distinct(), "asked")
    return spark.sql(
        """
        SELECT qno, docid, round(sum(idf * points), 6) AS bm25score
        FROM (
          SELECT a.qno, e.docid,
                 log10((SELECT num_docs FROM stats) / (1 + t.df)) AS idf,
                 2.5D * e.tf / (e.tf + 0.375D + 1.125D * e.len / (SELECT avgdl FROM stats)) AS points
          FROM asked a
          JOIN dict t ON t.term = a.qterm AND t.crange = cr(a.qterm)
          JOIN postings e ON e.termid = t.termid AND e.thash = p(t.termid)
        )
        GROUP BY qno, docid
        """
    )


@query
def export_tables(spark, sf_dir):
    """The small tables copied to Parquet and read back: rows and totals."""
    index = document_index(spark, sf_dir)

    def make():
        root = new_folder(spark, "export")
        write_parquet(index.dict.select("term", "termid", "df"), f"{root}/dict")
        write_parquet(index.docs, f"{root}/docs")
        return root

    root = once(spark, sf_dir, "export", make)
    terms = read_parquet(spark, f"{root}/dict").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("df").alias("total")
    )
    docs = read_parquet(spark, f"{root}/docs", schemas.DOCS).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("len").alias("total")
    )
    return terms.select(F.lit("dict").alias("table_name"), "rows", "total").union(
        docs.select(F.lit("docs").alias("table_name"), "rows", "total")
    )


# ---------------------------------------------------------------- query texts


@query
def tokenize_normalised(spark, sf_dir):
    """Terms of every conversation turn, turns numbered in order."""
    turns = number_queries(
        table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"]
    )
    return tokens.tokenize_queries(turns, text="text")


@query
def tokenize_whitespace(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return tokens.tokenize_queries(items, mode="whitespace", qno="item_id", text="text")


@query
def tokenize_without_apostrophes(spark, sf_dir):
    items = table(spark, sf_dir, "pages")
    return tokens.tokenize_queries(
        items, mode="whitespace", qno="page_id", text="html", drop_apostrophes=True
    )


@query
def token_lists(spark, sf_dir):
    """Term arrays, shown as their size and joined text."""
    lists = tokens.token_lists(table(spark, sf_dir, "documents"), "text")
    return lists.select(
        F.size("qt").cast("long").alias("terms"), F.md5(F.concat_ws(" ", "qt")).alias("digest")
    )


def _log_path(spark, sf_dir):
    """Conversation turns as a tab-separated query log."""

    def make():
        turns = table(spark, sf_dir, "conversations").select(
            F.concat_ws("-", "conv_id", "turn").alias("QueryID"),
            F.trim(F.regexp_replace("text", r"[ \t\n\f\r]+", " ")).alias("QueryText"),
            F.col("role").alias("DocumentID"),
        )
        path = new_folder(spark, "log")
        turns.write.option("sep", "\t").option("escape", '"').csv(path)
        return path

    return once(spark, sf_dir, "log", make)


@query
def query_log(spark, sf_dir):
    """The log as read, one row per distinct text."""
    log = read_query_log(spark, _log_path(spark, sf_dir))
    return log.select("QueryText").distinct()


@query
def query_sample(spark, sf_dir):
    """A seeded sample of distinct texts from the log."""
    log = read_query_log(spark, _log_path(spark, sf_dir))
    return sampling.sample_queries(log, SAMPLE_SIZE, SAMPLE_SEED)


def _sample_path(spark, sf_dir):
    def make():
        path = new_folder(spark, "sample")
        write_csv(query_sample(spark, sf_dir), path)
        return path

    return once(spark, sf_dir, "sample", make)


def _sampled_queries(spark, sf_dir):
    """The sample as stored, numbered by text."""
    return number_queries(read_query_sample(spark, _sample_path(spark, sf_dir)), ["QueryText"])


@query
def sample_terms(spark, sf_dir):
    """The sample, written as CSV with a header, read, numbered and tokenised."""
    return tokens.tokenize_queries(_sampled_queries(spark, sf_dir))


@query
def sql_tokenize(spark, sf_dir):
    """The terms of the sample by statements in SQL: tokenise, number the queries, one row per term."""
    register_sql_functions(spark)
    _sampled_queries(spark, sf_dir).createOrReplaceTempView("sampled")
    return spark.sql(
        """
        SELECT qno, explode(qt) AS qterm FROM (
          SELECT qno, tokenize(QueryText) AS qt FROM sampled
        )
        """
    )


@query
def sample_ranking(spark, sf_dir):
    """The best document for each sampled query."""
    asked = tokens.tokenize_queries(_sampled_queries(spark, sf_dir))
    return _scores(rank.bm25(document_index(spark, sf_dir), asked, k=1))


# ---------------------------------------------------------------- term lookup


@query
def lookup_batch(spark, sf_dir):
    """Known terms of every benchmark passage, with their repeats."""
    return lookup.lookup_terms(document_index(spark, sf_dir), benchmark_queries(spark, sf_dir))


@query
def lookup_in(spark, sf_dir):
    return lookup.terms_in(document_index(spark, sf_dir).dict, PROBE_TERMS)


@query
def lookup_in_keyed(spark, sf_dir):
    return lookup.terms_in(document_index(spark, sf_dir).dict, PROBE_TERMS, keyed=True)


@query
def lookup_or_keyed(spark, sf_dir):
    return lookup.terms_or(document_index(spark, sf_dir).dict, PROBE_TERMS)


@query
def lookup_union(spark, sf_dir):
    return lookup.terms_union(document_index(spark, sf_dir).dict, PROBE_TERMS)


@query
def lookup_union_keyed(spark, sf_dir):
    return lookup.terms_union(document_index(spark, sf_dir).dict, PROBE_TERMS, keyed=True)


@query
def term_ids(spark, sf_dir):
    """Whether each word of the benchmark is known, and its id or -1."""
    words = tokens.tokenize_queries(
        table(spark, sf_dir, "benchmark"), mode="whitespace", qno="item_id", text="text"
    )
    return lookup.term_ids(document_index(spark, sf_dir).dict, words)


@query
def docs_for_terms(spark, sf_dir):
    words = probe_queries(spark).select("qterm").distinct()
    return lookup.docs_for_terms(document_index(spark, sf_dir), words)


@query
def unknown_queries(spark, sf_dir):
    """Queries without a known term, when every distinct word of the conversations is a query."""
    turns = table(spark, sf_dir, "conversations").select(F.lit(0).alias("qno"), "text")
    words = tokens.tokenize_queries(turns, mode="whitespace", text="text").select("qterm").distinct()
    asked = number_queries(words)
    found = lookup.lookup_terms(document_index(spark, sf_dir), asked)
    return lookup.unknown_queries(asked, found)


# ---------------------------------------------------------------- ranking


@query
def bm25_all(spark, sf_dir):
    return _scores(rank.bm25(document_index(spark, sf_dir), probe_queries(spark)))


@query
def bm25_top20(spark, sf_dir):
    return _scores(rank.bm25(document_index(spark, sf_dir), probe_queries(spark), k=20))


@query
def bm25_top15(spark, sf_dir):
    asked = literal_queries(spark, [["playing", "the", "on", "and"]])
    return _scores(rank.bm25(document_index(spark, sf_dir), asked, k=15))


@query
def bm25_sorted(spark, sf_dir):
    """All rows, sorted by query and score."""
    return _scores(rank.sorted_results(rank.bm25(hashed_index(spark, sf_dir), probe_queries(spark))))


@query
def bm25_web_queries(spark, sf_dir):
    """The ten web queries, split at white space."""
    texts = literal_queries(spark, [[text] for text in SAMPLE_QUERIES])
    asked = tokens.tokenize_queries(texts, mode="whitespace", text="qterm")
    return _scores(rank.bm25(document_index(spark, sf_dir), asked, k=20))


@query
def bm25_benchmark(spark, sf_dir):
    """The whole benchmark as one batch: 20 documents for each passage."""
    asked = benchmark_queries(spark, sf_dir)
    return _scores(rank.bm25(document_index(spark, sf_dir), asked, k=20))


@query
def bm25_benchmark_repeated(spark, sf_dir):
    """The same with repeated words counted as often as a passage holds them."""
    asked = benchmark_queries(spark, sf_dir)
    return _scores(rank.bm25(document_index(spark, sf_dir), asked, k=20, repeat_terms=True))


@query
def bm25_repeated_terms(spark, sf_dir):
    index = document_index(spark, sf_dir)
    return _scores(rank.bm25(index, probe_queries(spark), k=20, repeat_terms=True))


@query
def bm25_joined_buckets(spark, sf_dir):
    """Buckets pruned through the join with the query terms."""
    index = document_index(spark, sf_dir)
    return _scores(rank.bm25(index, probe_queries(spark), k=20, prune="join"))


@query
def bm25_all_buckets(spark, sf_dir):
    """The control: every bucket is read."""
    index = document_index(spark, sf_dir)
    return _scores(rank.bm25(index, probe_queries(spark), k=20, prune=None))


@query
def bm25_hash_buckets(spark, sf_dir):
    """Hash layout, lengths from the documents."""
    return _scores(rank.bm25(hashed_index(spark, sf_dir), probe_queries(spark), k=20))


@query
def bm25_docs_join(spark, sf_dir):
    """Lengths from the documents although the postings carry them."""
    index = document_index(spark, sf_dir)
    return _scores(rank.bm25(index, probe_queries(spark), k=20, use_docs=True))


@query
def term_scores(spark, sf_dir):
    scores = rank.term_scores(document_index(spark, sf_dir), probe_queries(spark))
    return scores.select(
        "qno", "docid", "termid", F.round("bm25termscore", 6).alias("bm25termscore")
    )


@query
def bm25_late_grouping(spark, sf_dir):
    """Term scores first, then their sums, then the best 20 with names."""
    index = document_index(spark, sf_dir)
    terms = rank.resolve_terms(index, probe_queries(spark))
    scores = rank.doc_scores(rank.term_scores(index, terms))
    return _scores(rank.top_named(index, scores, 20, terms.queries))


@query
def bm25_term_lists(spark, sf_dir):
    """Equal term scores of a document count once."""
    index = document_index(spark, sf_dir)
    return _scores(rank.bm25(index, probe_queries(spark), collapse_equal_scores=True))


@query
def filtered_postings(spark, sf_dir):
    found = rank.filtered_postings(document_index(spark, sf_dir), probe_queries(spark))
    return found.withColumn("tf", F.col("tf").cast("long"))


@query
def bm25_filtered_postings(spark, sf_dir):
    return _scores(rank.bm25_from_filtered(document_index(spark, sf_dir), probe_queries(spark)))


@query
def bm25_per_term(spark, sf_dir):
    return _scores(rank.bm25_per_term(document_index(spark, sf_dir), probe_queries(spark), k=20))


@query
def batch_best(spark, sf_dir):
    """The best document of every benchmark passage that has a known term."""
    asked = benchmark_queries(spark, sf_dir)
    return _scores(batch.run_batch(document_index(spark, sf_dir), asked, k=1))


@query
def batch_report(spark, sf_dir):
    """Queries asked, answered and skipped, for the conversation turns split at white space."""
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("qno"), F.col("text").alias("QueryText")
    )
    asked = tokens.tokenize_queries(turns, mode="whitespace")
    return batch.batch_report(document_index(spark, sf_dir), asked, asked=turns)


@query
def batch_means(spark, sf_dir):
    """Totals and means over the answered queries of the benchmark batch, without its seconds."""
    index, passages = document_index(spark, sf_dir), table(spark, sf_dir, "benchmark")
    asked = passages.select(F.col("item_id").alias("qno"))
    _, report = batch.timed_batch(index, benchmark_queries(spark, sf_dir), k=5, asked=asked)
    rounded = [F.round(c, 6).alias(c) for c in ("mean_hits", "mean_best")]
    return report.select("asked", "answered", "skipped", "hits", *rounded)


# ---------------------------------------------------------------- repeated documents


@query
def duplicate_ids(spark, sf_dir):
    return duplicates.duplicate_ids(raw_index(spark, sf_dir).docs)


@query
def corrected_dict(spark, sf_dir):
    return fixed_index(spark, sf_dir).dict.select("term", "termid", "df")


@query
def corrected_docs(spark, sf_dir):
    return fixed_index(spark, sf_dir).docs


@query
def corrected_postings(spark, sf_dir):
    postings = fixed_index(spark, sf_dir).postings
    return postings.select("termid", "docid", F.col("tf").cast("long").alias("tf"))


@query
def corrected_stats(spark, sf_dir):
    stats = fixed_index(spark, sf_dir).stats
    return stats.select("num_docs", F.round("avgdl", 6).alias("avgdl"))


@query
def changed_lengths(spark, sf_dir):
    return duplicates.changed_lengths(raw_index(spark, sf_dir), fixed_index(spark, sf_dir))


@query
def changed_df(spark, sf_dir):
    return duplicates.changed_df(raw_index(spark, sf_dir), fixed_index(spark, sf_dir))


@query
def shrunk_count(spark, sf_dir):
    return duplicates.shrunk_count(raw_index(spark, sf_dir), fixed_index(spark, sf_dir))


@query
def shrunk_terms(spark, sf_dir):
    return duplicates.shrunk_terms(raw_index(spark, sf_dir), fixed_index(spark, sf_dir))


@query
def bm25_raw(spark, sf_dir):
    """Ranking over the raw index: every copy of a posting meets every copy of its document."""
    return _scores(rank.bm25(raw_index(spark, sf_dir), probe_queries(spark)))


@query
def bm25_raw_top20(spark, sf_dir):
    return _scores(rank.bm25(raw_index(spark, sf_dir), probe_queries(spark), k=20))


@query
def bm25_corrected(spark, sf_dir):
    return _scores(rank.bm25(fixed_index(spark, sf_dir), probe_queries(spark), k=20))


# ---------------------------------------------------------------- reports


@query
def row_counts(spark, sf_dir):
    return profile.row_counts(document_index(spark, sf_dir))


@query
def store_row_counts(spark, sf_dir):
    """Row counts of an index that lies in a store known to one session only, by another scheme."""

    def make():
        folder = new_folder(spark, "store")
        target = folder if ":/" in folder else f"file://{folder}"
        host = "store" + folder.rsplit("-", 1)[-1]
        store = store_session(spark, {f"fs.viewfs.mounttable.{host}.link./kept": target})
        root = f"viewfs://{host}/kept/index"
        docs = table(store, sf_dir, "documents")
        for _ in range(2):
            write_index(build_index(docs), root, Layout("shift", 12))
        drop_old_versions(store, root)
        return store, root

    store, root = once(spark, sf_dir, "store", make)
    counts = profile.row_counts(read_index(store, root))
    return counts.withColumn("scheme", F.lit(root.split(":")[0]))


@query
def sample_rows(spark, sf_dir):
    return profile.sample_rows(document_index(spark, sf_dir).docs, 5, "docid")


@query
def file_layout(spark, sf_dir):
    """Rows of each postings bucket, and whether it has files and bytes, whose numbers may differ."""
    found = profile.file_layout(document_index(spark, sf_dir).postings, "thash")
    return found.select(
        F.col("thash").cast("long").alias("thash"),
        "rows",
        (F.col("files") >= 1).alias("has_files"),
        (F.col("bytes") > 0).alias("has_bytes"),
    )


@query
def posting_bytes(spark, sf_dir):
    """Postings, and whether one takes less than the 16 bytes of a long and two integers, lengths included."""
    files = profile.file_layout(document_index(spark, sf_dir).postings, "thash")
    return files.agg(
        F.sum("rows").alias("postings"), (F.sum("bytes") < 16 * F.sum("rows")).alias("packed")
    )


@query
def bucket_rows(spark, sf_dir):
    """The rows of each bucket, counted from its files."""
    files = profile.file_layout(document_index(spark, sf_dir).postings, "thash")
    return files.select(F.col("thash").cast("long").alias("thash"), "rows")


@query
def scan_report(spark, sf_dir):
    """What finding the postings of one word reads, by how buckets are pruned.

    `found` are the rows out of the join; that folders were left unread shows in files, bytes and rows.
    """
    index = document_index(spark, sf_dir)
    terms = rank.resolve_terms(index, literal_queries(spark, [["the"]]))
    whole = index.postings.count()
    reports = []
    for prune in ("constants", "join", None):
        found = rank.postings_of(index, terms, prune)
        scans = report_scans(found).where(F.col("table") == "postings")
        every = report_scans(index.postings).select("files", "bytes").first()
        reports.append(
            scans.select(
                F.lit(prune or "none").alias("pruned_by"),
                F.lit(found.count()).cast("long").alias("found"),
                (F.col("files") < every["files"]).alias("fewer_files"),
                (F.col("bytes") < every["bytes"]).alias("fewer_bytes"),
                (F.col("rows") < whole).alias("fewer_rows"),
            )
        )
    return reduce(DataFrame.union, reports)


@query
def absent_words(spark, sf_dir):
    """Looking up a word that no document has reads no row of the dictionary, though every word lies
    between the first and the last of a file."""
    terms = document_index(spark, sf_dir).dict
    reports = []
    for word in [*ABSENT_WORDS, *PROBE_TERMS]:
        found = lookup.terms_in(terms, [word])
        reports.append(
            report_scans(found).agg((F.sum("rows") > 0).alias("reads_rows")).select(
                F.lit(word).alias("word"), F.lit(found.count() > 0).alias("known"), "reads_rows"
            )
        )
    return reduce(DataFrame.union, reports)


# ---------------------------------------------------------------- segments


@query
def segments(spark, sf_dir):
    """Documents, postings, terms and new terms of each segment of a growing index."""
    found = segment_report(spark, grown_index(spark, sf_dir))
    return found.withColumn("segment", F.col("segment").cast("long"))


@query
def bm25_segments(spark, sf_dir):
    """Every benchmark passage, ranked over three segments that were never merged."""
    asked = benchmark_queries(spark, sf_dir)
    return _scores(rank.bm25(read_index(spark, grown_index(spark, sf_dir)), asked, k=20))


@query
def published_terms(spark, sf_dir):
    """The dictionary by SQL, over the permanent views of an index of three segments."""

    def make():
        root = grown_index(spark, sf_dir)
        database = "published_" + root.rsplit("-", 1)[-1]
        return database, publish_views(spark, database, root)

    database, state = once(spark, sf_dir, "published", make)
    return spark.sql(
        f"SELECT d.term, d.df, count(*) AS postings, sum(p.tf) AS tokens "
        f"FROM {database}.dict_{state} d JOIN {database}.postings_{state} p USING (termid) GROUP BY ALL"
    )


@query
def compacted_postings(spark, sf_dir):
    """Postings by term of an index that grew and was compacted, against those of one build."""
    index = compacted_index(spark, sf_dir)
    return index.postings.join(index.dict, "termid").groupBy("term", "df").agg(
        F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("tokens"), F.sum("docid").alias("docids")
    )


# ---------------------------------------------------------------- pruning by block


@query
def bm25_block_max(spark, sf_dir):
    """Every benchmark passage; only blocks of documents that can hold one of the 20 best are scored."""
    index, impacts = document_index(spark, sf_dir), document_impacts(spark, sf_dir)
    return _scores(block_max.bm25_block_max(index, impacts, benchmark_queries(spark, sf_dir), k=20))


@query
def block_max_report(spark, sf_dir):
    """The postings of each passage's terms, and whether the best hits were found with four fifths of all."""
    index, impacts = document_index(spark, sf_dir), document_impacts(spark, sf_dir)
    asked = benchmark_queries(spark, sf_dir)
    _, weights, kept = block_max.surviving_blocks(index, impacts, asked, k=1)
    found = block_max.postings_scored(impacts, weights, kept)
    share = found.select(F.sum("scored") / F.sum("postings")).scalar()
    return found.select("qno", "postings", (F.col("scored") <= F.col("postings")).alias("no_more"), (share < 0.8).alias("fewer"))


# ---------------------------------------------------------------- versions with other term ids


@query
def changed_terms(spark, sf_dir):
    """Terms of the documents and of the conversation turns, as two versions with ids of their own."""
    return versions.changed_terms(document_index(spark, sf_dir), raw_index(spark, sf_dir))


@query
def change_report(spark, sf_dir):
    """Terms and postings that the second of two such versions gained, lost, changed or kept."""
    return versions.change_report(document_index(spark, sf_dir), raw_index(spark, sf_dir))


@query
def renumbered_postings(spark, sf_dir):
    """Postings of the grown index against those of one build: other term ids, no difference."""
    grown = read_index(spark, grown_index(spark, sf_dir))
    found = versions.compared_postings(document_index(spark, sf_dir), grown)
    return found.groupBy("term", "change").agg(F.count(F.lit(1)).alias("postings"), F.sum("tf_after").alias("tokens"))

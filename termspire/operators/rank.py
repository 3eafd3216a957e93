"""BM25 for a batch of queries in one job."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termspire.functions.scoring import K1, B, inverse_document_frequency, term_score
from termspire.model import Index
from termspire.operators.lookup import MAX_CONSTANTS, lookup_terms, measure_queries
from termspire.plans.skew import frequent_keys, frequent_pairs, grid_join, spread_join
from termspire.plans.staging import MAX_BROADCAST_ROWS, local_relation, stage

# The sum of floating-point scores depends on the order of the rows in its last digits. Ranking by
# nine decimals makes scores that are equal on paper tie, and the docid then decides.
RANK_STEPS = 1e9
# Rows (query, posting) that one task sums, in some hundred bytes each: a task of this size doesn't spill.
PAIRS_PER_TASK = 2_000_000
# A task isn't started for less than this.
MIN_PAIRS = 50_000
# Default of spark.sql.optimizer.windowGroupLimitThreshold.
MAX_TRIMMED_BY_SPARK = 1_000


@dataclass(frozen=True)
class QueryTerms:
    """The known terms of a batch, looked up once, and what their size allows.

    `asked` holds (qno, termid, n) and `distinct` one row (termid, df, thash) per term. `postings`
    is the exact number of postings of the distinct terms, and `pairs` that of the (query, posting)
    rows: the dictionary tells both before a single posting is read. `termids` is None when there
    are too many to write into a plan.
    """

    asked: DataFrame
    distinct: DataFrame
    rows: int
    queries: int
    postings: int
    pairs: int
    buckets: list[int] | None
    termids: list[int] | None

    @property
    def broadcastable(self) -> bool:
        return self.rows <= MAX_BROADCAST_ROWS


def resolve_terms(index: Index, queries: DataFrame, repeat_terms: bool = False) -> QueryTerms:
    """Look the batch up. A small result becomes part of the plan, a larger one a staged table.

    With `repeat_terms` a term counts as often as the query holds it, otherwise once.
    """
    size = measure_queries(queries)
    bucket = index.layout.bucket(F.col("termid")) if "thash" in index.postings.columns else None
    found = lookup_terms(index, queries, size).select(
        "qno",
        "termid",
        "df",
        F.col("n") if repeat_terms else F.lit(1).cast("long").alias("n"),
        (F.lit(None).cast("int") if bucket is None else bucket).alias("thash"),
    )
    # A term has one row in the dictionary, so the result has no more rows than the batch.
    if size.local:
        return _local_terms(found)
    return _staged_terms(found)


def _local_terms(found: DataFrame) -> QueryTerms:
    spark = found.sparkSession
    table = found.toArrow()
    distinct = table.select(["termid", "df", "thash"]).group_by(["termid", "df", "thash"]).aggregate([])
    termids = distinct["termid"].to_pylist()
    return QueryTerms(
        asked=local_relation(spark, table.select(["qno", "termid", "n"])),
        distinct=local_relation(spark, distinct),
        rows=table.num_rows,
        queries=len(table["qno"].unique()),
        postings=sum(distinct["df"].to_pylist()),
        pairs=sum(table["df"].to_pylist()),
        buckets=_known(distinct["thash"].unique().to_pylist()),
        termids=sorted(termids) if len(termids) <= MAX_CONSTANTS else None,
    )


def _staged_terms(found: DataFrame) -> QueryTerms:
    frame = stage(found, "terms")
    distinct = stage(frame.select("termid", "df", "thash").distinct(), "distinct-terms")
    rows, queries, pairs = frame.agg(
        F.count(F.lit(1)), F.count_distinct("qno"), F.coalesce(F.sum("df"), F.lit(0))
    ).first()
    # Bounded by the number of buckets in the layout, whatever the batch.
    postings, buckets = distinct.agg(
        F.coalesce(F.sum("df"), F.lit(0)), F.collect_set("thash")
    ).first()
    return QueryTerms(
        asked=frame.select("qno", "termid", "n"),
        distinct=distinct,
        rows=rows,
        queries=queries,
        postings=postings,
        pairs=pairs,
        buckets=_known(buckets),
        termids=None,
    )


def _known(buckets: list[int | None]) -> list[int]:
    return sorted(b for b in buckets if b is not None)


def _as_terms(index: Index, queries: DataFrame | QueryTerms, repeat_terms: bool) -> QueryTerms:
    return queries if isinstance(queries, QueryTerms) else resolve_terms(index, queries, repeat_terms)


def postings_of(index: Index, terms: QueryTerms, prune: str | None = "constants") -> DataFrame:
    """Postings of the batch's distinct terms, with `df`; each posting once, whoever asks for it.

    prune="constants" writes the buckets (never more than the layout has) and a short list of term
    ids into the filter, "join" leaves it to a join on the bucket, which Spark turns into dynamic
    partition pruning, and None reads every bucket.
    """
    postings, wanted, keys = index.postings, terms.distinct, ["termid"]
    bucketed = "thash" in postings.columns
    if prune == "constants":
        if bucketed:
            postings = postings.where(F.col("thash").isin(terms.buckets))
        if terms.termids is not None:
            postings = postings.where(F.col("termid").isin(terms.termids))
    elif prune == "join" and bucketed:
        # The terms are read from the dictionary under a filter: Spark prunes by a join only when
        # it can see that the other side was filtered.
        wanted = _from_dict(index, terms)
        keys.append("thash")
    elif prune not in ("join", None):
        raise ValueError(f"unknown pruning: {prune}")
    if "thash" not in keys:
        wanted = wanted.drop("thash")
    if terms.broadcastable:
        return postings.join(F.broadcast(wanted), keys)
    if bucketed and prune == "join":
        # The spread join has no bucket key, so the buckets, which the layout bounds, are constants.
        postings = postings.where(F.col("thash").isin(terms.buckets))
    frequent = frequent_keys(wanted, "termid", "df", terms.postings)
    return spread_join(postings, wanted.drop("thash"), "termid", frequent, ["docid"])


def _from_dict(index: Index, terms: QueryTerms) -> DataFrame:
    if terms.termids is None:
        return terms.distinct.where(F.col("thash") >= 0)
    return index.dict.where(F.col("termid").isin(terms.termids)).select(
        "termid", "df", index.layout.bucket(F.col("termid")).alias("thash")
    )


def _with_document_length(index: Index, postings: DataFrame, rows: int) -> DataFrame:
    """Postings with the length of their document and `copies`, the number of equal rows.

    The join moves the side that is known to be small: the postings of the batch were counted in
    the dictionary.
    """
    docs = index.docs.select("docid", "len")
    small = rows <= MAX_BROADCAST_ROWS
    if index.unique_docs:
        joined = docs.join(F.broadcast(postings), "docid") if small else postings.join(docs, "docid")
        return joined.withColumn("copies", F.lit(1).cast("long"))
    # Each copy of a posting meets each copy of its document. Equal postings are counted first, and
    # equal documents before or right after the join, so that the copies of a document are never
    # paired with one another: the rows grow with its distinct lengths.
    count = F.count(F.lit(1))
    postings = postings.groupBy("termid", "docid", "tf", "df").agg(count.alias("posting_copies"))
    if small:
        joined = docs.join(F.broadcast(postings), "docid")
        joined = joined.groupBy(*postings.columns, "len").agg(count.alias("doc_copies"))
    else:
        lengths = stage(docs.groupBy("docid", "len").agg(count.alias("doc_copies")), "lengths")
        rows_of = lambda side, name: side.groupBy("docid").agg(count.alias(name))
        counts = rows_of(lengths, "lengths").join(rows_of(postings, "found"), "docid")
        frequent = frequent_pairs(counts, "docid", "found", "lengths")
        joined = grid_join(postings, lengths, "docid", frequent, ["termid", "tf"], ["len"])
    return joined.withColumn("copies", F.col("posting_copies") * F.col("doc_copies"))


def scored_postings(
    index: Index,
    postings: DataFrame,
    rows: int,
    k1: float = K1,
    b: float = B,
    use_docs: bool = False,
) -> DataFrame:
    """(docid, termid, copies, bm25termscore), one row per posting.

    Lengths stored beside the postings make the join with `docs` unnecessary; `use_docs` keeps it.
    """
    if "len" in postings.columns and index.unique_docs and not use_docs:
        with_length = postings.withColumn("copies", F.lit(1).cast("long"))
    else:
        with_length = _with_document_length(
            index, postings.select("termid", "docid", "tf", "df"), rows
        )
    num_docs = index.stats.select("num_docs").scalar()
    avgdl = index.stats.select("avgdl").scalar()
    score = term_score(
        inverse_document_frequency(num_docs, F.col("df")), F.col("tf"), F.col("len"), avgdl, k1, b
    )
    return with_length.select("docid", "termid", "copies", score.alias("bm25termscore"))


def for_queries(scored: DataFrame, terms: QueryTerms) -> DataFrame:
    """(qno, docid, termid, copies, bm25termscore): each scored posting, for every query that asks.

    The postings are shuffled by docid before they meet the queries. A term shared by many queries
    is moved once, and grouping by (qno, docid) afterwards needs no other shuffle. A batch too
    large to broadcast is joined by term, with the frequent terms spread.
    """
    if terms.broadcastable:
        pairs = _by_document(scored, terms.pairs).join(F.broadcast(terms.asked), "termid")
    else:
        pairs = _meet(scored, terms)
    return pairs.select(
        "qno", "docid", "termid", (F.col("copies") * F.col("n")).alias("copies"), "bm25termscore"
    )


def _meet(postings: DataFrame, terms: QueryTerms) -> DataFrame:
    """Postings and the queries that ask for their term, where a term may have many of both."""
    asking = terms.asked.groupBy("termid").agg(F.count(F.lit(1)).alias("queries"))
    counts = terms.distinct.select("termid", "df").join(asking, "termid")
    frequent = frequent_pairs(counts, "termid", "df", "queries")
    return grid_join(postings, terms.asked, "termid", frequent, ["docid"], ["qno"])


def _by_document(scored: DataFrame, pairs: int) -> DataFrame:
    """Shuffle by docid, into as many tasks as the known pairs need."""
    return scored.repartition(tasks_for(scored, pairs), "docid")


def tasks_for(df: DataFrame, pairs: int) -> int:
    """Tasks for so many pairs: at least the session's default, but no more than pairs need by far.

    The number is given with the shuffle, so that it stays. Adaptive execution would merge tasks by the
    bytes that it sees, which are those before each row meets its queries.
    """
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = ceil(pairs / PAIRS_PER_TASK)
    return max(needed, min(default, ceil(pairs / MIN_PAIRS)), 1)


def term_scores(
    index: Index,
    queries: DataFrame | QueryTerms,
    repeat_terms: bool = False,
    prune: str | None = "constants",
    k1: float = K1,
    b: float = B,
    use_docs: bool = False,
) -> DataFrame:
    """(qno, docid, termid, copies, bm25termscore): what each term adds to each document, not yet
    grouped. `copies` tells how often the row counts."""
    terms = _as_terms(index, queries, repeat_terms)
    found = postings_of(index, terms, prune)
    return for_queries(scored_postings(index, found, terms.postings, k1, b, use_docs), terms)


def doc_scores(scores: DataFrame) -> DataFrame:
    """(qno, docid, bm25score): the sum of the term scores of each document."""
    return scores.groupBy("qno", "docid").agg(
        F.sum(F.col("bm25termscore") * F.col("copies")).alias("bm25score")
    )


def rank_key(score: Column) -> Column:
    return F.floor(score * F.lit(RANK_STEPS) + F.lit(0.5))


def ranked(scores: DataFrame, k: int, ties: tuple[str, ...] = ("docid",)) -> DataFrame:
    """The k best rows per query, with their `rank`.

    Spark trims each task to k rows per query before it shuffles them by query, up to its limit for
    k. Beyond that the trimming is spelled out here, so that one query never meets in one task whole.
    """
    order = [rank_key(F.col("bm25score")).desc(), *ties]
    if k > MAX_TRIMMED_BY_SPARK:
        slices = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        in_slice = Window.partitionBy("qno", "_slice").orderBy(*order)
        scores = (
            scores.withColumn("_slice", F.pmod(F.xxhash64(*ties), F.lit(slices)))
            .withColumn("rank", F.row_number().over(in_slice))
            .where(F.col("rank") <= k)
            .drop("_slice", "rank")
        )
    numbered = scores.withColumn(
        "rank", F.row_number().over(Window.partitionBy("qno").orderBy(*order))
    )
    return numbered.where(F.col("rank") <= k)


def sorted_results(results: DataFrame) -> DataFrame:
    """Full sort by query, then score descending. Range-partitioned, unlike a rank over all rows."""
    return results.orderBy("qno", rank_key(F.col("bm25score")).desc(), "docid")


def with_names(index: Index, scores: DataFrame, rows: int | None = None) -> DataFrame:
    """The scored documents with their name, fetched last and for these documents only.

    `rows` is the known largest number of scored rows, if there is one.
    """
    names = index.docs.select("docid", "name")
    if rows is not None and rows <= MAX_CONSTANTS:
        # The few best are computed now: their ids, as constants, let the sorted files of `docs` be
        # skipped but for the row groups that hold them.
        table = scores.toArrow()
        scores = local_relation(scores.sparkSession, table)
        names = names.where(F.col("docid").isin(table["docid"].unique().to_pylist()))
        joined = names.join(F.broadcast(scores), "docid")
    elif rows is not None and rows <= MAX_BROADCAST_ROWS:
        joined = names.join(F.broadcast(scores), "docid")
    else:
        joined = scores.join(names, "docid")
    return joined.select(*[c for c in scores.columns if c != "rank"], "name", *_rank_column(scores))


def _rank_column(scores: DataFrame) -> list[str]:
    return ["rank"] if "rank" in scores.columns else []


def top_named(index: Index, scores: DataFrame, k: int | None, queries: int) -> DataFrame:
    """The k best rows of each query with names; all rows when k is None.

    Every scored document has a row in `docs`, so the k best documents give at least the k best
    rows, and only those are joined. Documents with several rows are ranked and cut once more.
    """
    if k is None:
        return with_names(index, scores)
    best = with_names(index, ranked(scores, k), rows=k * queries)
    return best if index.unique_docs else ranked(best.drop("rank"), k, ties=("docid", "name"))


def bm25(
    index: Index,
    queries: DataFrame | QueryTerms,
    k: int | None = None,
    repeat_terms: bool = False,
    collapse_equal_scores: bool = False,
    prune: str | None = "constants",
    k1: float = K1,
    b: float = B,
    use_docs: bool = False,
) -> DataFrame:
    """(qno, docid, bm25score, name[, rank]) of the documents that hold any term of each query.

    Results are exact sums over the set of query terms. `repeat_terms` counts repeated words,
    `collapse_equal_scores` counts equal term scores of one document once, as a distinct union of
    (docid, score) lists does. With k, the k best rows per query are kept and ranked.
    """
    terms = _as_terms(index, queries, repeat_terms)
    scores = term_scores(index, terms, prune=prune, k1=k1, b=b, use_docs=use_docs)
    if collapse_equal_scores:
        scores = scores.select("qno", "docid", "bm25termscore").distinct()
        scores = scores.withColumn("copies", F.lit(1).cast("long"))
    return top_named(index, doc_scores(scores), k, terms.queries)


def filtered_postings(
    index: Index, queries: DataFrame | QueryTerms, prune: str | None = "constants"
) -> DataFrame:
    """(qno, termid, docid, df, tf): the distinct postings of each query's terms."""
    terms = _as_terms(index, queries, repeat_terms=False)
    found = _distinct_postings(index, terms, prune)
    if terms.broadcastable:
        pairs = found.join(F.broadcast(terms.asked), "termid")
    else:
        pairs = _meet(found, terms)
    return pairs.select("qno", "termid", "docid", "df", "tf")


def _distinct_postings(index: Index, terms: QueryTerms, prune: str | None) -> DataFrame:
    return postings_of(index, terms, prune).select("termid", "docid", "df", "tf").distinct()


def bm25_from_filtered(
    index: Index,
    queries: DataFrame | QueryTerms,
    k: int | None = None,
    prune: str | None = "constants",
) -> DataFrame:
    """(qno, docid, bm25score[, rank]): distinct postings are filtered first and joined with `docs`
    after; names are not fetched."""
    terms = _as_terms(index, queries, repeat_terms=False)
    found = _distinct_postings(index, terms, prune)
    scored = scored_postings(index, found, terms.postings, use_docs=True)
    scores = doc_scores(for_queries(scored, terms))
    return scores if k is None else ranked(scores, k)


def bm25_per_term(
    index: Index,
    queries: DataFrame | QueryTerms,
    k: int | None = None,
    prune: str | None = "constants",
) -> DataFrame:
    """One row per (query, matching term, document): sums per term are listed, not added up.

    Equal rows appear once, as in a distinct union of the lists of the terms.
    """
    terms = _as_terms(index, queries, repeat_terms=False)
    per_term = (
        term_scores(index, terms, prune=prune)
        .groupBy("qno", "docid", "termid")
        .agg(F.sum(F.col("bm25termscore") * F.col("copies")).alias("bm25score"))
        .select("qno", "docid", "bm25score")
        .distinct()
    )
    return top_named(index, per_term, k, terms.queries)

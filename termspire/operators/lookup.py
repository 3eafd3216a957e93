"""Find terms in the dictionary, and the documents of a term."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspire.functions.keys import crange
from termspire.model import Index
from termspire.plans.skew import frequent_keys, spread_join
from termspire.plans.staging import (
    MAX_BROADCAST_BYTES,
    MAX_BROADCAST_ROWS,
    MAX_LOCAL_BYTES,
    MAX_LOCAL_ROWS,
    broadcast_if_small,
    local_relation,
    stage,
)

# A longer list of term ids is not written into the plan as constants.
MAX_CONSTANTS = 1_000


def _same_term(word: str, keyed: bool):
    found = F.col("term") == word
    return found & (F.col("crange") == crange(F.lit(word))) if keyed else found


def terms_in(terms: DataFrame, words: list[str], keyed: bool = False) -> DataFrame:
    """(termid, df) of the words, with one IN list; `keyed` adds the list of their range keys."""
    found = F.col("term").isin(words)
    if keyed:
        found &= F.col("crange").isin([crange(F.lit(w)) for w in words])
    return terms.where(found).select("termid", "df")


def terms_or(terms: DataFrame, words: list[str], keyed: bool = True) -> DataFrame:
    """(termid, df) of the words, as one OR of conditions per word."""
    return terms.where(reduce(lambda a, b: a | b, [_same_term(w, keyed) for w in words])).select(
        "termid", "df"
    )


def terms_union(terms: DataFrame, words: list[str], keyed: bool = False) -> DataFrame:
    """(termid, df) of the words, as a distinct union of one lookup per word."""
    parts = [terms.where(_same_term(w, keyed)).select("termid", "df") for w in words]
    return reduce(DataFrame.union, parts).distinct()


@dataclass(frozen=True)
class QuerySize:
    """Measured size of a batch: rows of (qno, qterm), bytes of its terms, range keys it uses."""

    rows: int
    bytes: int
    keys: list[int]

    @property
    def local(self) -> bool:
        return self.rows <= MAX_LOCAL_ROWS and self.bytes <= MAX_LOCAL_BYTES

    @property
    def broadcastable(self) -> bool:
        return self.rows <= MAX_BROADCAST_ROWS and self.bytes <= MAX_BROADCAST_BYTES


def measure_queries(queries: DataFrame) -> QuerySize:
    """One pass over the batch. The range keys are bounded by the number of code points."""
    row = queries.agg(
        F.count(F.lit(1)),
        F.coalesce(F.sum(F.octet_length("qterm")), F.lit(0)),
        F.collect_set(crange(F.col("qterm"))),
    ).first()
    return QuerySize(row[0], row[1], sorted(row[2]))


def distinct_terms(queries: DataFrame) -> DataFrame:
    """(qno, qterm, n): each term of a query once, with the number of its repeats."""
    return queries.groupBy("qno", "qterm").agg(F.count(F.lit(1)).alias("n"))


def _restricted(terms: DataFrame, column: str, values: list) -> DataFrame:
    """The rows with one of the values, if the values are few and the column exists."""
    if len(values) > MAX_CONSTANTS or column not in terms.columns:
        return terms
    return terms.where(F.col(column).isin(values))


def lookup_terms(index: Index, queries: DataFrame, size: QuerySize | None = None) -> DataFrame:
    """(qno, term, termid, df, n) for the query terms that the dictionary knows.

    One pass over the dictionary, restricted to the range keys of the batch, and to its words if
    they are few: the files are sorted, so a short query reads a few row groups. The query side is
    broadcast if its measured size allows.
    """
    size = size or measure_queries(queries)
    terms = _restricted(index.dict, "crange", size.keys)
    if size.local:
        counted = queries.select("qno", "qterm").toArrow().group_by(["qno", "qterm"])
        table = counted.aggregate([([], "count_all")]).rename_columns(["qno", "qterm", "n"])
        terms = _restricted(terms, "term", table["qterm"].unique().to_pylist())
        wanted = F.broadcast(local_relation(queries.sparkSession, table))
    else:
        wanted = distinct_terms(queries)
        wanted = F.broadcast(wanted) if size.broadcastable else wanted
    return terms.join(wanted, F.col("term") == F.col("qterm")).select(
        "qno", "term", "termid", "df", "n"
    )


def term_ids(terms: DataFrame, words: DataFrame, column: str = "qterm") -> DataFrame:
    """(word, known, termid) for each given word; unknown words have termid -1."""
    words = words.select(F.col(column).alias("word")).distinct()
    found = (
        terms.join(broadcast_if_small(words, "word"), F.col("term") == F.col("word"))
        .select("word", "termid")
    )
    return words.join(found, "word", "left").select(
        "word",
        F.col("termid").isNotNull().alias("known"),
        F.coalesce("termid", F.lit(-1)).alias("termid"),
    )


def unknown_queries(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(qno) of the queries without a single known term."""
    return queries.select("qno").distinct().join(found.select("qno").distinct(), "qno", "left_anti")


def docs_for_terms(index: Index, words: DataFrame, column: str = "qterm") -> DataFrame:
    """(word, docid) of every posting of the given words; unknown words give no rows.

    A list of words that is small is looked up at once, and its buckets and term ids become constants
    of the plan, so only the row groups that hold them are read. For a larger one the join carries
    the bucket of each term id, and only the folders of those are read. A list too long to broadcast
    is joined by term id, with the frequent terms spread.
    """
    words = words.select(F.col(column).alias("word")).distinct()
    size = measure_queries(words.select(F.col("word").alias("qterm")))
    if size.local:
        asked = words.select(F.lit(0).cast("long").alias("qno"), F.col("word").alias("qterm"))
        ids = lookup_terms(index, asked, size).select(F.col("term").alias("word"), "termid")
        bucket = index.layout.bucket(F.col("termid")) if "thash" in index.postings.columns else F.lit(None)
        table = ids.withColumn("thash", bucket.cast("int")).toArrow()
        postings = index.postings
        if "thash" in postings.columns:
            postings = postings.where(F.col("thash").isin(table["thash"].unique().to_pylist()))
        postings = _restricted(postings, "termid", table["termid"].unique().to_pylist())
        ids = local_relation(index.postings.sparkSession, table.select(["word", "termid"]))
        return postings.join(F.broadcast(ids), "termid").select("word", "docid")
    terms = _restricted(index.dict, "crange", size.keys)
    small = size.broadcastable
    found = terms.join(F.broadcast(words) if small else words, F.col("term") == F.col("word"))
    ids = found.select("word", "termid", "df")
    if not small:
        ids = stage(ids, "words")
        frequent = frequent_keys(ids, "termid", "df", ids.select(F.sum("df")).scalar())
        joined = spread_join(index.postings, ids, "termid", frequent, ["docid"])
        return joined.select("word", "docid")
    keys = ["termid"]
    if "thash" in index.postings.columns:
        ids = ids.withColumn("thash", index.layout.bucket(F.col("termid")))
        keys.append("thash")
    return index.postings.join(F.broadcast(ids), keys).select("word", "docid")


def docs_of_term_id(index: Index, termid: int) -> DataFrame:
    """(docid) of one term id, read from its bucket only."""
    postings = index.postings.where(F.col("termid") == termid)
    if "thash" in postings.columns:
        postings = postings.where(F.col("thash") == index.layout.bucket(F.lit(termid).cast("long")))
    return postings.select("docid")

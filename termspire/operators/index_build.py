"""Make an index from a table of documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termspire.functions.keys import crange
from termspire.functions.text import tokenize
from termspire.model import Index
from termspire.plans.numbering import number_rows
from termspire.plans.skew import frequent_keys, head_keys, spread_join
from termspire.plans.staging import is_small, stage, widen


def forward_table(documents: DataFrame) -> DataFrame:
    """(docid, name, len, terms) for each row (docid, name, text); `terms` holds its (term, tf).

    A row is counted in place: its tokens are sorted, each run starts where a token differs from
    the one before it, and the distance to the next start is the frequency. So no token is shuffled.
    """
    tokens = documents.select(
        F.col("docid").cast("long").alias("docid"),
        F.col("name").cast("string").alias("name"),
        F.sort_array(F.coalesce(tokenize(F.col("text")), F.array().cast("array<string>"))).alias(
            "tokens"
        ),
    )
    positions = F.when(F.size("tokens") > 0, F.sequence(F.lit(0), F.size("tokens") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    starts = F.filter(
        positions, lambda i: (i == 0) | (F.get("tokens", i) != F.get("tokens", i - F.lit(1)))
    )
    runs = F.transform(
        "starts",
        lambda start, i: F.struct(
            F.get("tokens", start).alias("term"),
            (F.coalesce(F.get("starts", i + F.lit(1)), F.size("tokens")) - start).alias("tf"),
        ),
    )
    return (
        tokens.withColumn("starts", starts)
        .withColumn("terms", runs)
        .select("docid", "name", F.size("tokens").cast("long").alias("len"), "terms")
    )


def build_index(
    documents: DataFrame,
    docid: str = "doc_id",
    text: str = "text",
    name: Column | None = None,
    unique_docs: bool | None = None,
) -> Index:
    """Index of all rows. A docid that occurs several times is kept as often, as a raw load does.

    Whether one does is checked, unless `unique_docs` tells.
    The tokenised rows are staged once, then read column by column: lengths for `docs`, terms for
    `dict`, terms and frequencies for `postings`. Term ids are dense, from 0, in term order.
    """
    forward, index = _counted(documents, docid, text, name, unique_docs)
    return replace(index, postings=_with_term_ids(forward, index.dict))


def _counted(
    documents: DataFrame, docid: str, text: str, name: Column | None = None, unique_docs: bool | None = None
) -> tuple[DataFrame, Index]:
    """The forward table of the documents, staged, and their index but for its postings."""
    name = F.concat(F.lit("d"), F.col(docid)) if name is None else name
    rows = documents.select(
        F.col(docid).alias("docid"), name.alias("name"), F.col(text).alias("text")
    )
    forward = stage(forward_table(widen(rows)), "forward")

    docs = forward.select("docid", "name", "len")
    totals = docs.agg(
        F.count(F.lit(1)).alias("num_docs"),
        F.avg("len").alias("avgdl"),
    )
    if unique_docs is None:
        unique_docs = docs.groupBy("docid").count().where(F.col("count") > 1).isEmpty()

    counted = (
        forward.select(F.explode("terms.term").alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    terms = number_rows(counted, ["term"], "termid").select(
        "term", "termid", "df", crange(F.col("term")).alias("crange")
    )
    return forward, Index(forward, terms, docs, totals, unique_docs=unique_docs)


def delta_index(index: Index, documents: DataFrame, docid: str = "doc_id", text: str = "text") -> Index:
    """Index of new documents whose term ids go with those of `index`.

    Terms that the index has keep their id; the others are numbered from its largest id on, in term
    order. Frequencies are those of the new documents alone. Lengths are stored if the index has them.
    """
    forward, own = _counted(documents, docid, text)
    # Own ids were dense and in term order, so the new terms keep that order among themselves.
    known = index.dict.select("term", F.col("termid").alias("known"))
    small = is_small(own.dict.select("term"), "term")
    terms = F.broadcast(own.dict) if small else own.dict
    matched = stage(known.join(terms, "term").select("termid", "known"), "known-terms")
    top = index.dict.agg(F.coalesce(F.max("termid"), F.lit(-1))).first()[0]
    unknown = own.dict.join(matched, "termid", "left_anti")
    first = F.lit(top + 1).cast("long")
    fresh = number_rows(unknown.select("term", "termid"), ["term"], "place").select(
        "termid", (F.col("place") + first).alias("known")
    )
    mapped = stage(matched.union(fresh), "term-ids")
    terms = own.dict.join(mapped, "termid").select("term", F.col("known").alias("termid"), "df", "crange")
    columns = ["docid", "tf", *(["len"] if index.has_lengths else [])]
    # The postings get their last ids at once, so they're not joined by their own ids and then again.
    terms = stage(terms, "renumbered")
    return replace(own, postings=_with_term_ids(forward, terms).select("termid", *columns), dict=terms)


def _with_term_ids(forward: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings with term ids and lengths: the dictionary is broadcast if measured small. If not, its
    most frequent terms are, which own most postings, and the others are joined by term with those of
    many postings spread, for which the dictionary already holds the counts."""
    rows = forward.select("docid", "len", F.inline("terms"))
    ids = terms.select("term", "termid")
    if is_small(ids, "term"):
        joined = rows.join(F.broadcast(ids), "term")
    else:
        total = terms.agg(F.sum("df")).first()[0]
        head = head_keys(terms, "term", "df", "term").select("term", "termid")
        met = rows.join(F.broadcast(head), "term")
        rows, terms = (t.join(F.broadcast(head.select("term")), "term", "left_anti") for t in (rows, terms))
        ids = terms.select("term", "termid")
        # Frequent terms are told by a hash, so that their list is small however long they are. Two
        # terms of one hash are both spread, which does no harm.
        hashed = F.xxhash64("term").alias("_term")
        counts = terms.select(hashed, "df").groupBy("_term").agg(F.sum("df").alias("df"))
        frequent = frequent_keys(counts, "_term", "df", total)
        rows, ids = rows.withColumn("_term", hashed), ids.withColumn("_term", hashed)
        ids = ids.withColumnRenamed("term", "_word")
        joined = spread_join(rows, ids, "_term", frequent, ["docid"]).where("term = _word")
        joined = joined.select(met.columns).union(met)
    return joined.select("termid", "docid", F.col("tf").cast("int").alias("tf"), "len")

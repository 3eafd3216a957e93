"""Exact top k that scores only the blocks of documents which can hold one of the k best.

A block is a range of docids. For each term and block the largest frequency and the smallest length
are kept: no posting of the block can score more than those two would together, whatever the
collection's totals are. The sum of these bounds over a query's terms bounds every document of the
block. A few blocks of the largest bounds are scored first; the k-th best score they give is one that
all k best reach, so blocks that are bounded below it are never joined with postings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termspire.functions.scoring import K1, B, inverse_document_frequency, term_score
from termspire.model import Index
from termspire.operators.rank import QueryTerms, ranked, resolve_terms, tasks_for, with_names
from termspire.plans.skew import frequent_pairs, grid_join
from termspire.plans.staging import MAX_BROADCAST_ROWS, stage

# A block holds 2^BLOCK_BITS docids, so a term has at most as many postings in it.
BLOCK_BITS = 10
# Blocks of a query that are scored to learn what its k best reach.
SEEDS = 4
# Up to so many queries, those that keep a block are bits beside it.
MAX_BITS = 1 << 16
# Bounds and scores are sums in another order, so they are compared with this much room.
ROOM = 1e-6


@dataclass(frozen=True)
class Impacts:
    """`rows` (termid, block, postings, max_tf, min_len), and the docids of a block as a power of two."""

    rows: DataFrame
    bits: int


def block_of(docid: Column, bits: int) -> Column:
    return F.shiftright(docid, bits)


def block_impacts(index: Index, bits: int = BLOCK_BITS, ranges: int | None = None) -> DataFrame:
    """(termid, block, postings, max_tf, min_len) for each term and block that has postings.

    Postings are added up within tasks before the shuffle; in files sorted by term and docid a block
    is in one or two tasks, so little is left to move. With `ranges`, postings are shuffled into so many
    ranges of (termid, block) and added up there, so the rows need no further shuffle to be written in order.
    """
    if not (index.has_lengths and index.unique_docs):
        raise ValueError("blocks need lengths beside the postings, and one row per document")
    postings = index.postings.select("termid", block_of(F.col("docid"), bits).alias("block"), "tf", "len")
    if ranges is not None:
        postings = postings.repartitionByRange(ranges, "termid", "block")
    return postings.groupBy("termid", "block").agg(
        F.count(F.lit(1)).alias("postings"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len")
    )


def _bounds(index: Index, impacts: Impacts, terms: QueryTerms, asked: DataFrame, k1: float, b: float) -> DataFrame:
    """(qno, block, bound): no document of the block scores more for the query.

    A term of negative weight bounds a block by 0, since a document may lack it. Every block that has
    a term of the query is listed, so none is lost.
    """
    rows = impacts.rows
    if terms.termids is not None:
        rows = rows.where(F.col("termid").isin(terms.termids))
    avgdl = index.stats.select("avgdl").scalar()
    most = term_score(F.col("weight"), F.col("max_tf"), F.col("min_len"), avgdl, k1, b)
    pairs = _meet(rows, asked, terms)
    return pairs.select("qno", "block", F.greatest(most, F.lit(0.0)).alias("most")).groupBy("qno", "block").agg(
        F.sum("most").alias("bound")
    )


def _meet(rows: DataFrame, asked: DataFrame, terms: QueryTerms) -> DataFrame:
    """Blocks of terms and the queries that ask for the term; both may be many for a frequent term.

    Rows are shuffled by block before they meet a batch that is broadcast: each is moved once, whoever
    asks for it, and sums by query and block need no other shuffle.
    """
    if terms.broadcastable:
        return _by_block(rows, terms).join(F.broadcast(asked), "termid")
    blocks = rows.groupBy("termid").agg(F.count(F.lit(1)).alias("blocks"))
    asking = terms.asked.groupBy("termid").agg(F.count(F.lit(1)).alias("queries"))
    frequent = frequent_pairs(blocks.join(asking, "termid"), "termid", "blocks", "queries")
    return grid_join(rows, asked, "termid", frequent, ["block"], ["qno"])


def _by_block(rows: DataFrame, terms: QueryTerms) -> DataFrame:
    """The rows of the batch's terms, shuffled by block."""
    wanted = rows.join(F.broadcast(terms.distinct.select("termid")), "termid", "left_semi")
    return wanted.repartition(tasks_for(rows, terms.pairs), "block")


def _scores(
    index: Index, impacts: Impacts, asked: DataFrame, chosen: DataFrame, terms: QueryTerms, k1: float, b: float
) -> DataFrame:
    """(qno, docid, bm25score) of the documents in the chosen (qno, block).

    Postings meet the queries by term and block. A block holds few postings of a term, so no key is
    large, however frequent the term; many queries of one block meet at most so many postings. If many
    blocks are chosen by a batch that may be broadcast, postings are shuffled by block to the bits of
    the queries that chose it, and meet only those: (qno, block, term) would be far more rows.
    """
    postings = index.postings
    if "thash" in postings.columns:
        postings = postings.where(F.col("thash").isin(terms.buckets))
    if terms.termids is not None:
        postings = postings.where(F.col("termid").isin(terms.termids))
    postings = postings.select("termid", "docid", "tf", "len", block_of(F.col("docid"), impacts.bits).alias("block"))
    terms_of = asked.groupBy("qno").agg(F.count(F.lit(1)).alias("terms"))
    size = chosen.groupBy("qno").agg(F.count(F.lit(1)).alias("blocks")).join(terms_of, "qno")
    small = (size.agg(F.sum(F.col("blocks") * F.col("terms"))).first()[0] or 0) <= MAX_BROADCAST_ROWS
    if not small and terms.broadcastable and terms.queries <= MAX_BITS:
        bits, asked = _choices(chosen, asked)
        bits = bits.repartition(tasks_for(postings, terms.pairs), "block")
        met = _by_block(postings, terms).join(bits, "block").join(F.broadcast(asked), "termid").where(_chosen())
        docs = ["qno", "block", "docid"]
    else:
        wanted = chosen.select("qno", "block").join(asked.select("qno", "termid", "weight"), "qno")
        wanted = stage(wanted, "blocks")
        met = postings.join(F.broadcast(wanted) if small else wanted, ["termid", "block"])
        docs = ["qno", "docid"]
    avgdl = index.stats.select("avgdl").scalar()
    points = term_score(F.col("weight"), F.col("tf"), F.col("len"), avgdl, k1, b)
    scores = met.select(*docs, points.alias("points")).groupBy(*docs).agg(F.sum("points").alias("bm25score"))
    return scores.select("qno", "docid", "bm25score")


def _choices(chosen: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, bits), in which each query of `asked` has a bit, and `asked` with its place there.

    `bits` are longs of 64 queries each, up to the last query that chose the block. Queries are numbered
    within the batch, which is small enough to be broadcast.
    """
    numbers = asked.select("qno").distinct().withColumn("bit", F.row_number().over(Window.orderBy("qno")) - 1)
    numbers = stage(numbers, "query-bits")
    rows = chosen.join(F.broadcast(numbers), "qno").groupBy("block", F.expr("bit div 64").alias("word"))
    words = rows.agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("bits")).groupBy("block")
    found = words.agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    last = F.array_max(F.map_keys("words"))
    bits = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda w: F.coalesce(F.element_at("words", w), F.lit(0)))
    return found.select("block", bits.alias("bits")), asked.join(F.broadcast(numbers), "qno", "left")


def _chosen() -> Column:
    """Whether the query of a row of `asked` is among those of the block."""
    return F.expr("shiftright(get(bits, int(bit div 64)), bit % 64) & 1 = 1")


def surviving_blocks(
    index: Index,
    impacts: Impacts,
    queries: DataFrame | QueryTerms,
    k: int,
    k1: float = K1,
    b: float = B,
) -> tuple[QueryTerms, DataFrame, DataFrame]:
    """The batch's terms, (qno, termid, weight) of each query, and the (qno, block) that can hold one
    of its k best documents."""
    terms = queries if isinstance(queries, QueryTerms) else resolve_terms(index, queries)
    num_docs = index.stats.select("num_docs").scalar()
    weight = inverse_document_frequency(num_docs, F.col("df")) * F.col("n")
    asked = stage(terms.asked.join(terms.distinct.select("termid", "df"), "termid").select("qno", "termid", weight.alias("weight")), "asked")
    bounds = stage(_bounds(index, impacts, terms, asked, k1, b), "bounds")
    order = Window.partitionBy("qno").orderBy(F.desc("bound"), "block")
    seeds = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SEEDS)
    scored = ranked(_scores(index, impacts, asked, seeds, terms, k1, b), k)
    # A query whose seeds hold fewer than k documents has no such score, and keeps all its blocks.
    least = scored.where(F.col("rank") == k).select("qno", F.col("bm25score").alias("least"))
    kept = bounds.join(F.broadcast(least) if terms.queries <= MAX_BROADCAST_ROWS else least, "qno", "left")
    kept = kept.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - F.lit(ROOM)))
    return terms, asked, stage(kept.select("qno", "block"), "surviving")


def bm25_block_max(
    index: Index,
    impacts: Impacts,
    queries: DataFrame | QueryTerms,
    k: int,
    k1: float = K1,
    b: float = B,
) -> DataFrame:
    """(qno, docid, bm25score, name, rank): the rows of `rank.bm25` with the same k."""
    terms, asked, kept = surviving_blocks(index, impacts, queries, k, k1, b)
    scores = _scores(index, impacts, asked, kept, terms, k1, b)
    return with_names(index, ranked(scores, k), rows=k * terms.queries)


def postings_scored(impacts: Impacts, asked: DataFrame, kept: DataFrame) -> DataFrame:
    """(qno, postings, scored): the postings of each query's terms, and those in the blocks it keeps."""
    queries = asked.agg(F.count(F.lit(1)), F.count_distinct("qno")).first()
    if queries[0] <= MAX_BROADCAST_ROWS and queries[1] <= MAX_BITS:
        bits, asked = _choices(kept, asked)
        rows = impacts.rows.join(F.broadcast(asked.select("termid").distinct()), "termid", "left_semi")
        met = rows.join(bits, "block", "left").join(F.broadcast(asked), "termid")
        scored = F.when(_chosen(), F.col("postings")).otherwise(0)
        return met.groupBy("qno").agg(F.sum("postings").alias("postings"), F.sum(scored).alias("scored"))
    pairs = impacts.rows.join(asked, "termid")
    kept = kept.withColumn("kept", F.lit(True))
    return pairs.join(kept, ["qno", "block"], "left").groupBy("qno").agg(
        F.sum("postings").alias("postings"), F.sum(F.when(F.col("kept"), F.col("postings")).otherwise(0)).alias("scored")
    )

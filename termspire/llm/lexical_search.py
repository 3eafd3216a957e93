"""Ranked search by Block-Max MaxScore over an index of shards.

A shard holds the documents of some megabytes of text: for each of its terms a list of postings in
blocks, compressed, and for each block the frequencies and lengths that no other posting of the block
beats. From these a block's largest score follows whatever the collection's totals are, so shards can
be indexed one by one. A search reads the lists of its terms, keeps the best of each shard, and merges
them; no list leaves its shard whole, and no document is compared with all others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termspire.llm.batches import PART_BYTES, Numbers, parts, raw_texts
from termspire.plans.staging import stage

# Text of a shard; a longer text is a shard of its own.
SHARD_BYTES = 16 << 20
# Postings of a block, and documents that a search looks at together.
BLOCK = 128
RANGE = 4096
# Text of the queries that are answered in one pass over the index.
QUERY_BYTES = 8 << 20

# Terms are runs of letters and digits of ASCII and of anything beyond; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(TERM.encode())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BLOCK = np.dtype([("last", "<u4"), ("at", "<u4"), ("gap", "u1"), ("tf", "u1"), ("peaks", "<u2")])
_PEAK = np.dtype([("tf", "<u4"), ("n", "<i8")])
# Of a term: documents that hold it, its blocks, their peaks, and the postings. Of the documents (no
# term): how many have terms, and all their terms; their ids (`known` of them, in order) and lengths.
_FIELDS = "shard bigint, term string, df bigint, blocks binary, peaks binary, postings binary, known bigint, docs bigint, terms bigint"
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]


@dataclass(frozen=True)
class SearchIndex:
    """The staged rows of all shards, the documents with a term (N), and all their terms (L)."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a posting adds for each unit of its term's weight."""
    m = 25 + (75 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def _width(values: np.ndarray) -> np.ndarray:
    return np.where(values < 1 << 8, 1, np.where(values < 1 << 16, 2, 4))


class _Shard:
    """Documents that are gathered until they are enough for a shard."""

    def __init__(self) -> None:
        self.words, self.ids, self.docs, self.size = Numbers(), [], [], 0

    def add(self, key: int | None, text: bytes) -> None:
        found = _TERM.findall(text.lower())
        self.ids.append(key)
        self.docs.append(np.array([self.words[w] for w in found], np.int32))
        self.size += len(text)

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        # Documents are in the order of their ids, which settles ties; those without id come last.
        order = sorted(range(len(self.ids)), key=lambda r: (self.ids[r] is None, self.ids[r] or 0))
        ids = np.array([self.ids[r] or 0 for r in order], np.int64)
        known = sum(self.ids[r] is not None for r in order)
        docs = [self.docs[r] for r in order]
        lengths = np.array([len(d) for d in docs], np.int64)
        yield _batch(
            [number], [None], [None], [ids.tobytes()], [None], [lengths.tobytes()],
            [known], [int((lengths > 0).sum())], [int(lengths.sum())],
        )
        if not lengths.any():
            return
        words = sorted(self.words)
        place = np.empty(len(words), np.int64)
        place[[self.words[w] for w in words]] = np.arange(len(words))
        keys = (place[np.concatenate(docs)] << 32) | np.repeat(np.arange(len(docs)), lengths)
        keys, tf = np.unique(keys, return_counts=True)
        yield from _lists(number, words, keys >> 32, keys & 0xFFFFFFFF, tf, lengths)


def _batch(*columns) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def _lists(number, words, term, doc, tf, lengths) -> Iterator[pa.RecordBatch]:
    """The rows of a shard's terms, from its postings in the order of term and document."""
    size = len(term)
    first = np.flatnonzero(np.diff(term, prepend=-1))
    df = np.diff(first, append=size)
    within = np.arange(size) - np.repeat(first, df)
    starts = np.flatnonzero(within % BLOCK == 0)
    counts = np.diff(starts, append=size)
    lasts = doc[starts + counts - 1]
    # Gaps are counted from the document before, those of the first in a list from -1.
    gap = np.diff(doc, prepend=0) - 1
    gap[first] = doc[first]
    wide_gap = _width(np.maximum.reduceat(gap, starts))
    wide_tf = _width(np.maximum.reduceat(tf, starts))
    sizes = counts * (wide_gap + wide_tf)
    ends = np.cumsum(sizes)
    block_of = np.repeat(np.arange(len(starts)), counts)
    inside = np.arange(size) - starts[block_of]
    data = np.zeros(int(ends[-1]), np.uint8)
    begin = (ends - sizes)[block_of]
    for values, wide, at in (
        (gap, wide_gap, begin),
        (tf, wide_tf, begin + (counts * wide_gap)[block_of]),
    ):
        each = wide[block_of]
        at = at + inside * each
        for byte in range(4):
            has = each > byte
            data[at[has] + byte] = (values[has] >> (8 * byte)) & 255
    peak_block, peaks = _peaks(block_of, tf, lengths[doc])
    blocks = np.zeros(len(starts), _BLOCK)
    first_block = np.searchsorted(starts, first)
    in_list = np.diff(first_block, append=len(starts))
    blocks["last"], blocks["gap"], blocks["tf"] = lasts, wide_gap, wide_tf
    list_begin = (ends - sizes)[first_block]
    blocks["at"] = (ends - sizes) - np.repeat(list_begin, in_list)
    blocks["peaks"] = np.bincount(peak_block, minlength=len(starts))
    peak_begin = np.searchsorted(peak_block, first_block)
    columns = [
        _binaries(blocks.view(np.uint8), first_block * _BLOCK.itemsize),
        _binaries(peaks.view(np.uint8), peak_begin * _PEAK.itemsize),
        _binaries(data, list_begin),
    ]
    names = pa.array(words, pa.binary()).cast(pa.string())
    for at in range(0, len(first), 50_000):
        n = min(50_000, len(first) - at)
        yield _batch(
            pa.array(np.full(n, number)), names.slice(at, n), pa.array(df[at : at + n]),
            *[c.slice(at, n) for c in columns], *[pa.nulls(n, pa.int64())] * 3,
        )


def _binaries(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Consecutive pieces of a buffer as an array of binaries, without a copy."""
    offsets = np.append(starts, data.nbytes).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _peaks(block: np.ndarray, tf: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The postings of each block such that no other has as many occurrences in as short a document."""
    order = np.lexsort((n, -tf, block))
    block, tf, n = block[order], tf[order], n[order]
    # Blocks are shifted apart, so that the least length so far starts anew in each.
    apart = n - block * (int(n.max()) + 1)
    before = np.minimum.accumulate(apart)
    kept = np.append(True, apart[1:] < before[:-1])
    peaks = np.zeros(int(kept.sum()), _PEAK)
    peaks["tf"], peaks["n"] = tf[kept], n[kept]
    return block[kept], peaks


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> SearchIndex:
    """Indexes every document, each in the task that reads it, and writes the shards to the shared folder.

    The key must be an integer or null. A null text has no terms. Other columns aren't looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            for part in parts(batch, 1, min(PART_BYTES, SHARD_BYTES)):
                for key_, value in zip(part.column(0).to_pylist(), raw_texts(part, 1), strict=True):
                    if shard.ids and shard.size + len(value) > SHARD_BYTES:
                        yield from shard.rows(number)
                        number, shard = number + 1, _Shard()
                    shard.add(key_, value)
        if shard.ids:
            yield from shard.rows(number)

    source = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = stage(source.mapInArrow(run, _FIELDS), "search-index")
    totals = rows.where("term IS NULL").agg(F.sum("docs"), F.sum("terms")).first()
    return SearchIndex(rows, totals[0] or 0, totals[1] or 0)


class _List:
    """One term's postings in a shard; a block is decompressed when its postings are first needed."""

    def __init__(self, row: dict, lengths: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.blocks = np.frombuffer(row["blocks"], _BLOCK)
        self.lasts = self.blocks["last"].astype(np.int64)
        self.df, self.data = row["df"], row["postings"]
        self.lengths, self.totals = lengths, (n_docs, n_terms)
        peaks = np.frombuffer(row["peaks"], _PEAK)
        scores = impacts(peaks["tf"].astype(np.int64), peaks["n"], n_docs, n_terms)
        counts = self.blocks["peaks"].astype(np.int64)
        # The largest score of each block, and 0 behind the last.
        self.bounds = np.append(np.maximum.reduceat(scores, np.cumsum(counts) - counts), 0)
        self.bound = int(self.bounds.max())
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block, and their scores for a weight of one."""
        if number not in self.read:
            head = self.blocks[number]
            count = min(BLOCK, self.df - number * BLOCK)
            at, before = int(head["at"]), int(self.lasts[number - 1]) if number else -1
            gaps = np.frombuffer(self.data, f"<u{head['gap']}", count, at).astype(np.int64)
            tf = np.frombuffer(self.data, f"<u{head['tf']}", count, at + count * int(head["gap"])).astype(np.int64)
            docs = np.cumsum(gaps + 1) + before
            self.read[number] = docs, impacts(tf, self.lengths[docs], *self.totals)
        return self.read[number]

    def within(self, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The postings of documents from `low` to before `high`."""
        for number in range(int(np.searchsorted(self.lasts, low)), len(self.lasts)):
            docs, scores = self.block(number)
            if docs[0] >= high:
                return
            if docs[0] < low or docs[-1] >= high:
                a, b = np.searchsorted(docs, (low, high))
                docs, scores = docs[a:b], scores[a:b]
            yield docs, scores

    def of(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The scores of some documents, whose blocks are known; 0 where the term doesn't occur."""
        found = np.zeros(len(docs), np.int64)
        for number in np.unique(block[block < len(self.lasts)]).tolist():
            here = np.flatnonzero(block == number)
            held, scores = self.block(number)
            at = np.minimum(np.searchsorted(held, docs[here]), len(held) - 1)
            same = held[at] == docs[here]
            found[here[same]] = scores[at[same]]
        return found


def best(lists: list[tuple[_List, int]], n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of n documents by the sum over (list, weight), ties to the smaller, scores above 0.

    Lists are ordered by the most that they can add. Those that together can't reach the k-th best
    score so far are not essential: documents are drawn from the others only, and must pass the sum of
    the block maxima before a block of a non-essential list is decompressed. Only documents that fall
    short of that score are rejected, so ties are kept.
    """
    lists = sorted(lists, key=lambda x: x[0].bound * x[1])
    reach = np.cumsum([x.bound * w for x, w in lists])
    top_docs, top_scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    for low in range(0, n, RANGE):
        high = min(n, low + RANGE)
        loose = int(np.searchsorted(reach, least))
        if loose == len(lists):
            break
        sums = np.zeros(high - low, np.int64)
        for postings, w in lists[loose:]:
            for docs, scores in postings.within(low, high):
                sums[docs - low] += scores * w
        docs = np.flatnonzero(sums)
        sums = sums[docs]
        docs += low
        if loose:
            docs, sums = _with_loose(lists[:loose], int(reach[loose - 1]), docs, sums, least)
        kept = sums >= least
        docs, sums = np.append(top_docs, docs[kept]), np.append(top_scores, sums[kept])
        order = np.lexsort((docs, -sums))[:k]
        top_docs, top_scores = docs[order], sums[order]
        if len(top_docs) == k:
            least = int(top_scores[-1])
    return top_docs, top_scores


def _with_loose(lists, reach: int, docs: np.ndarray, sums: np.ndarray, least: int):
    """Adds the scores of non-essential lists to candidates; those that can't reach `least` go early."""
    kept = sums + reach >= least
    docs, sums = docs[kept], sums[kept]
    blocks = [np.searchsorted(x.lasts, docs) for x, _ in lists]
    bounds = [x.bounds[b] * w for (x, w), b in zip(lists, blocks, strict=True)]
    left = np.sum(bounds, axis=0) if len(docs) else sums
    alive = np.flatnonzero(sums + left >= least)
    for (postings, w), block, bound in reversed(list(zip(lists, blocks, bounds, strict=True))):
        if not len(alive):
            break
        left[alive] -= bound[alive]
        sums[alive] += postings.of(docs[alive], block[alive]) * w
        alive = alive[sums[alive] + left[alive] >= least]
    return docs[alive], sums[alive]


def _search_shard(rows: pa.Table, asked: dict[int, dict[str, int]], k: int, n_docs: int, n_terms: int) -> pa.Table:
    """The best documents of one shard for each query: (query, doc, score)."""
    lists, ids, lengths, known = {}, None, None, 0
    found = rows.to_pylist()
    for row in found:
        if row["term"] is None:
            ids, lengths = (np.frombuffer(row[c], np.int64) for c in ("blocks", "postings"))
            known = row["known"]
    for row in found:
        if row["term"] is not None:
            lists[row["term"]] = _List(row, lengths, n_docs, n_terms)
    queries, docs, scores = [], [], []
    for query, weights in asked.items():
        own = [(lists[t], w) for t, w in weights.items() if t in lists]
        if own:
            d, s = best(own, len(ids), k)
            queries.append(np.full(len(d), query))
            docs.append(d)
            scores.append(s)
    d = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    made = [
        pa.array(np.concatenate(queries) if queries else d),
        pa.array(ids[d], mask=d >= known),
        pa.array(np.concatenate(scores) if scores else d),
    ]
    return pa.table(made, ["query", "doc_id", "score"])


def terms_of(queries: DataFrame) -> DataFrame:
    """(query, block, term, n): the terms of each query's text and how often it holds them."""
    lowered = F.translate("text", _UPPER, _LOWER)
    words = F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)))
    return queries.select("query", "block", words.alias("term")).groupBy("query", "block", "term").agg(
        F.count(F.lit(1)).alias("n")
    )


def search(
    index: SearchIndex, queries: DataFrame, k: int = 10, item: str = "item_id", text: str = "text"
) -> DataFrame:
    """item, `rank` (from 1), `doc_id`, `score` of the k best documents for each row of `queries`.

    A score is the sum over a query's terms, repeats included; documents without a score above 0 are
    left out, equal scores go by ascending doc_id, and documents without id come last among equals. A
    null or empty text finds nothing. Each row of queries is a query of its own, also where rows are
    equal; each row of documents is a document. Queries are answered in blocks of about QUERY_BYTES of
    text, whose terms and weights are broadcast; a block is one pass over the index.
    """
    spark = queries.sparkSession
    rows = stage(
        queries.select(
            F.monotonically_increasing_id().alias("query"), F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")
        ),
        "search-queries",
    )
    blocks = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // QUERY_BYTES + 1
    asked = terms_of(rows.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))))
    lists = index.rows.select("term", "df").where("term IS NOT NULL")
    held = lists.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = stage(asked.join(held, "term"), "search-terms")
    found = None
    for block in range(blocks):
        part = _search_block(spark, index, weighed.where(F.col("block") == block), k)
        found = part if found is None else found.union(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(rows.select("query", "item"), "query").select(F.col("item").alias(item), "rank", "doc_id", "score")


def _search_block(spark, index: SearchIndex, weighed: DataFrame, k: int) -> DataFrame:
    table = weighed.select("query", "term", "n", "df").orderBy("query", "term").toArrow()
    asked: dict[int, dict[str, int]] = {}
    for query, term, n, df in zip(*(c.to_pylist() for c in table.columns), strict=True):
        if (w := weight(index.n_docs, df) * n) > 0:
            asked.setdefault(query, {})[term] = w
    shared = spark.sparkContext.broadcast(asked)
    n_docs, n_terms = index.n_docs, index.n_terms

    def run(rows: pa.Table) -> pa.Table:
        return _search_shard(rows, shared.value, k, n_docs, n_terms)

    # A block's terms are no larger than its text.
    terms = F.broadcast(weighed.select("term").distinct())
    wanted = index.rows.where("term IS NOT NULL").join(terms, "term", "left_semi").select(*_NAMES)
    wanted = wanted.union(index.rows.where("term IS NULL").select(*_NAMES))
    return wanted.groupBy("shard").applyInArrow(run, "query bigint, doc_id bigint, score bigint")

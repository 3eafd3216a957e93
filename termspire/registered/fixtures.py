"""Indexes over the given tables, made once per application, and the query batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termspire.model import Index, Layout
from termspire.operators.block_max import Impacts
from termspire.operators.duplicates import corrected_index
from termspire.operators.index_build import build_index
from termspire.operators.layout import choose_shift_by_dict
from termspire.operators.tokens import tokenize_queries
from termspire.plans.staging import new_folder, scratch, workspace
from termspire.sinks import append_documents, compact, drop_superseded, write_impacts, write_index
from termspire.sources import literal_queries, read_index

# Query terms that occur in the given documents, one repeated, one unknown.
PROBE_QUERIES = [
    ["the", "and"],
    ["the", "the", "and"],
    ["zzzqq"],
    ["and", "la", "und"],
]
PROBE_TERMS = ["the", "and", "la", "zzzqq"]
# Words that no document holds.
ABSENT_WORDS = ["thezq", "anzqd", "undqz"]
# Ten web queries.
SAMPLE_QUERIES = [
    "apnea masks",
    "getting from oakland to san francisco",
    "general gre",
    "chipotal",
    "ok highway patrol",
    "playstore free",
    "sky sports listings today",
    "montezuma costa rica",
    "charity.com",
    "1 800 number for medicaid",
]
# Buckets of a quarter of a megabyte show pruning on small data; the cap is what a large one gets.
BUCKET_BYTES = 256 << 10
MAX_BUCKETS = 1024
HASH_BUCKETS = 40
# Blocks of eight documents, for the same reason.
SMALL_BLOCK_BITS = 3
SAMPLE_SIZE = 100
SAMPLE_SEED = 37

_made: dict[tuple[str, str, str], object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(spark: SparkSession, sf_dir: str, label: str, make):
    """What `make` returns, made at most once per application and input folder."""
    key = (workspace(spark), sf_dir.rstrip("/"), label)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def document_index(spark: SparkSession, sf_dir: str) -> Index:
    """Index of `documents` in the layout that keeps the order of term ids."""

    def make() -> Index:
        with scratch(spark):
            built = build_index(table(spark, sf_dir, "documents"))
            shift = choose_shift_by_dict(built.dict, bucket_bytes=BUCKET_BYTES, max_buckets=MAX_BUCKETS)
            shift = shift.first()["shift"]
            # An empty table gives no shift, and has nothing to lay out.
            layout = Layout() if shift is None else Layout("shift", shift)
            return write_index(built, new_folder(spark, "documents"), layout)

    return once(spark, sf_dir, "documents", make)


def document_impacts(spark: SparkSession, sf_dir: str) -> Impacts:
    """Bounds of the blocks of the index of `documents`."""

    def make() -> Impacts:
        return write_impacts(document_index(spark, sf_dir), new_folder(spark, "impacts"), SMALL_BLOCK_BITS)

    return once(spark, sf_dir, "impacts", make)


def hashed_index(spark: SparkSession, sf_dir: str) -> Index:
    """The same index with postings in buckets by hash, and without lengths beside them."""

    def make() -> Index:
        source = document_index(spark, sf_dir)
        plain = Index(
            source.postings.select("termid", "docid", "tf"), source.dict, source.docs, source.stats
        )
        return write_index(plain, new_folder(spark, "hashed"), Layout("hash", HASH_BUCKETS))

    return once(spark, sf_dir, "hashed", make)


def raw_index(spark: SparkSession, sf_dir: str) -> Index:
    """Index of `conversations` in which every turn is one capture of its conversation's id."""

    def make() -> Index:
        turns = table(spark, sf_dir, "conversations")
        name = F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn"))
        with scratch(spark):
            built = build_index(turns, docid="conv_id", name=name)
            return write_index(built, new_folder(spark, "raw"), Layout("hash", HASH_BUCKETS))

    return once(spark, sf_dir, "raw", make)


def fixed_index(spark: SparkSession, sf_dir: str) -> Index:
    """The corrected version of the raw index."""

    def make() -> Index:
        source = raw_index(spark, sf_dir)
        with scratch(spark):
            fixed = corrected_index(source)
            return write_index(fixed, new_folder(spark, "corrected"), Layout("hash", HASH_BUCKETS))

    return once(spark, sf_dir, "corrected", make)


def grown_index(spark: SparkSession, sf_dir: str) -> str:
    """Root of an index of the English `documents`, to which two segments were added: the documents of
    other languages, then those without one. No term was renumbered, and nothing was compacted."""

    def make() -> str:
        docs, root = table(spark, sf_dir, "documents"), new_folder(spark, "grown")
        english = F.col("lang").eqNullSafe("en")
        with scratch(spark):
            built = build_index(docs.where(english))
            shift = choose_shift_by_dict(built.dict, bucket_bytes=BUCKET_BYTES, max_buckets=MAX_BUCKETS)
            shift = shift.first()["shift"]
            write_index(built, root, Layout() if shift is None else Layout("shift", shift))
        append_documents(spark, root, docs.where(~english & F.col("lang").isNotNull()))
        append_documents(spark, root, docs.where(F.col("lang").isNull()))
        return root

    return once(spark, sf_dir, "grown", make)


def compacted_index(spark: SparkSession, sf_dir: str) -> Index:
    """An index of the `documents` of which the French ones were added later, compacted since."""

    def make() -> Index:
        docs, root = table(spark, sf_dir, "documents"), new_folder(spark, "compacted")
        french = F.col("lang").eqNullSafe("fr")
        with scratch(spark):
            write_index(build_index(docs.where(~french)), root, Layout("hash", HASH_BUCKETS))
        append_documents(spark, root, docs.where(french))
        compact(spark, root)
        drop_superseded(spark, root)
        return read_index(spark, root)

    return once(spark, sf_dir, "compacted", make)


def probe_queries(spark: SparkSession) -> DataFrame:
    return literal_queries(spark, PROBE_QUERIES)


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of `benchmark` as a query of normalised terms."""
    return tokenize_queries(table(spark, sf_dir, "benchmark"), qno="item_id", text="text")

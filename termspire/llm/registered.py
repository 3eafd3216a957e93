"""The registered queries of this subpackage, and the SQL that states what they must return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termspire.llm import bpe, decontaminate, html_text, language, lexical_search, line_dedup, lm_score, near_duplicates, oracles, token_alignment, token_counts, toxicity, url_filter, winnow
from termspire.llm.labelled_urls import labelled_urls

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}


def query(function: Query) -> Query:
    _registry[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_registry)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


_oracles: dict[str, str] = {
    "op1_benchmark_decontamination": oracles.BENCHMARK_DECONTAMINATION,
    "op6_winnowing": oracles.WINNOWING,
    "op9_line_dedup": oracles.LINE_DEDUP,
    "op11_ranked_lexical_search": oracles.RANKED_LEXICAL_SEARCH,
    "op7_minhash_near_duplicates": oracles.MINHASH_NEAR_DUPLICATES,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(number: int) -> Column:
    """The fold of a document; a document without id is in none, and is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(number)), F.lit(-1))


@query
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.drop("items", "spans")


# Rules of the URL filter.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = url_filter.train(labelled_urls(spark))
    return url_filter.judge(table(spark, sf_dir, "pages"), weights, URL_RULES)


@query
def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        with_ids=False,
    )


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    )


@query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.score(table(spark, sf_dir, "documents"), remainder(5) != 1)
    return found.withColumn("held_out", remainder(5) == 1)


@query
def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(table(spark, sf_dir, "documents"))


@query
def op7_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(remainder(4) != 2))
    found = language.identify(docs, model)
    return found.select(
        "doc_id",
        (remainder(4) == 2).alias("held_out"),
        "lang_pred",
        "score",
        F.size("spans").cast("bigint").alias("n_spans"),
    )


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = toxicity.train(docs, table(spark, sf_dir, "labels").where(remainder(5) != 0))
    return toxicity.score(docs, weights).withColumn("held_out", remainder(5) == 0)


@query
def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizers = token_alignment.read_tokenizers(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )
    found = token_alignment.align(table(spark, sf_dir, "documents"), tokenizers, with_groups=False)
    return found.documents().drop("groups")


@query
def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build(table(spark, sf_dir, "documents"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"))

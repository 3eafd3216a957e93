"""A training corpus in five stages, from `documents` to token ids; each stage is a table of Parquet.

Every stage takes (spark, docs, sf_dir) and returns the documents that go on, with the columns of
`documents`; the last returns tokens. `run` writes what a stage returns to the shared folder and reads
it again, so a stage starts from a table and a lost executor costs no more than its tasks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termspire.llm import bpe, decontaminate, language, line_dedup, near_duplicates
from termspire.plans.numbering import number_rows
from termspire.plans.staging import is_small, new_folder, scratch, stage

# SQL cannot express the first stage, a trained model.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are of no learned language: without a letter, or too mixed.

    The model is learned from all documents that have a `lang`; the others get the one that is found.
    """
    model = language.train(docs)
    return language.keep_identified(docs, model)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that more than a tenth of a source's documents contain.

    A document that consists of such lines keeps them: it is one of many copies, which are the next
    stage's. A document without text goes.
    """
    return line_dedup.drop_lines(docs, keep_whole=True).where(F.trim("text") != "")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the smallest doc_id.

    Rows are told apart by a number, not by doc_id: a row goes only if its own text is a near copy.
    Numbers follow doc_id, then text; rows without doc_id come last, so one of them is kept only if
    its group has no other. Where doc_ids are there and differ, they are the numbers.
    """
    packed = docs.select(F.struct("*").alias("row"))
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.where((F.col("n") > 1) | F.col("doc_id").isNull()).head(1):
        numbered = number_rows(packed, [F.asc_nulls_last("row.doc_id"), F.asc("row.text")], "number")
    else:
        numbered = packed.withColumn("number", F.col("row.doc_id").cast("bigint"))
    texts = numbered.select("number", F.col("row.text").alias("text"))
    found = near_duplicates.near_duplicates(texts, "number").where(~F.col("kept"))
    dropped = stage(found.select("number"), "near-duplicates")
    dropped = F.broadcast(dropped) if is_small(dropped) else dropped
    return numbered.join(dropped, "number", "left_anti").select("row.*")


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the passages of `benchmark` out of the texts; a document of nothing else goes."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, n_tokens, ids, ids_sha256, decoded_sha256."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", cut_benchmark_passages),
    ("byte_level_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, as a table in the shared folder; the tables before it are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = new_folder(spark, "pipeline")
    with scratch(spark):
        for name, function in STAGES:
            docs = function(spark, docs, sf_dir)
            if name != STAGES[-1][0]:
                docs = stage(docs, f"pipeline-{name}")
        docs.write.parquet(path)
    return spark.read.schema(docs.schema).parquet(path)

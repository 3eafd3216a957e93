"""Queries from files and literals."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from termspire import schemas
from termspire.plans.numbering import number_rows
from termspire.plans.staging import local_relation


def read_query_sample(spark: SparkSession, path: str) -> DataFrame:
    """CSV file with the header `QueryText`."""
    return (
        spark.read.schema(schemas.QUERY_SAMPLE)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
    )


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated log without a header: query id, query text, clicked document."""
    return (
        spark.read.schema(schemas.QUERY_LOG)
        .option("sep", "\t")
        .option("escape", '"')
        .csv(path)
    )


def number_queries(queries: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Add the query number `qno`, from 0, in the order of the given columns (all by default)."""
    return number_rows(queries, order or queries.columns, "qno")


def literal_queries(spark: SparkSession, queries: list[list[str]]) -> DataFrame:
    """(qno, qterm) from lists of terms; a term may be repeated within a query."""
    rows = [(qno, term) for qno, terms in enumerate(queries) for term in terms]
    table = pa.table(
        {
            "qno": pa.array([qno for qno, _ in rows], pa.int64()),
            "qterm": pa.array([term for _, term in rows], pa.string()),
        }
    )
    return local_relation(spark, table)

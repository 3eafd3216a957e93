"""Readers: index tables, partitioned folders, catalog tables, query files and literal queries."""

from termspire.sources.index_files import create_bucketed_tables, create_tables, read_impacts, read_index, read_tables, register_views
from termspire.sources.queries import literal_queries, number_queries, read_query_log, read_query_sample
from termspire.sources.tables import read_folder, read_parquet, store_session, temporary_table

__all__ = [
    "create_bucketed_tables",
    "create_tables",
    "literal_queries",
    "number_queries",
    "read_folder",
    "read_impacts",
    "read_index",
    "read_parquet",
    "read_query_log",
    "read_query_sample",
    "read_tables",
    "register_views",
    "store_session",
    "temporary_table",
]

"""Writers: index tables in their layouts, single tables, and query files."""

from termspire.sinks.index_files import drop_old_versions, write_dict, write_impacts, write_index, write_postings
from termspire.sinks.segments import append_documents, compact, drop_superseded, segment_report
from termspire.sinks.tables import write_csv, write_parquet
from termspire.sinks.views import drop_old_views, publish_views, read_views

__all__ = [
    "append_documents",
    "compact",
    "drop_old_versions",
    "drop_old_views",
    "drop_superseded",
    "publish_views",
    "read_views",
    "segment_report",
    "write_csv",
    "write_dict",
    "write_impacts",
    "write_index",
    "write_parquet",
    "write_postings",
]

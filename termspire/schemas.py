"""Fixed schemas of every table the package reads or writes; nothing is inferred."""

from pyspark.sql import types as T


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


POSTINGS = _struct(
    ("termid", T.LongType()),
    ("docid", T.LongType()),
    ("tf", T.IntegerType()),
)
# A layout may store the document length beside each posting (see sinks.index_files).
POSTING_LENGTH = T.StructField("len", T.LongType(), True)
# Partition key of laid-out postings. Int, because a byte overflows above bucket 127.
POSTING_BUCKET = T.StructField("thash", T.IntegerType(), True)

DICT = _struct(
    ("term", T.StringType()),
    ("termid", T.LongType()),
    ("df", T.LongType()),
    ("crange", T.IntegerType()),
)
DOCS = _struct(
    ("docid", T.LongType()),
    ("name", T.StringType()),
    ("len", T.LongType()),
)
STATS = _struct(
    ("num_docs", T.LongType()),
    ("avgdl", T.DoubleType()),
)
# Bounds of the postings of a term in a block of 2^bits docids (see operators.block_max).
IMPACTS = _struct(
    ("termid", T.LongType()),
    ("block", T.LongType()),
    ("postings", T.LongType()),
    ("max_tf", T.IntegerType()),
    ("min_len", T.LongType()),
    ("bits", T.IntegerType()),
)
# One row written beside the index, so that readers never guess how it was laid out.
LAYOUT = _struct(
    ("kind", T.StringType()),
    ("param", T.IntegerType()),
    ("has_lengths", T.BooleanType()),
    ("unique_docs", T.BooleanType()),
    ("version", T.StringType()),
    # Null in an index that was written at once: one segment, the version, with all tables.
    (
        "segments",
        T.ArrayType(
            _struct(
                ("folder", T.StringType()),
                ("tables", T.ArrayType(T.StringType())),
                ("dropped", T.ArrayType(T.IntegerType())),
            )
        ),
    ),
)

METADATA = _struct(
    ("id", T.StringType()),
    ("record_id", T.StringType()),
    ("title", T.StringType()),
)
QUERY_LOG = _struct(
    ("QueryID", T.StringType()),
    ("QueryText", T.StringType()),
    ("DocumentID", T.StringType()),
)
QUERY_SAMPLE = _struct(("QueryText", T.StringType()))

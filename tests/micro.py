"""A hand-worked index of five documents; the comments give the values worked out on paper."""

import pyarrow as pa

from termspire import Index, schemas

DICT = [
    ("a", 0, 4, 9),  # df = N - 1: idf log10(5/5) = 0
    ("b", 1, 5, 9),  # df = N: idf log10(5/6) = -0.0791812
    ("c", 2, 1, 9),  # idf log10(5/2) = 0.3979400
    ("d", 3, 1, 10),  # as c
    ("e", 4, 2, 10),  # idf log10(5/3) = 0.2218487
]
POSTINGS = [
    (0, 0, 1), (0, 1, 1), (0, 2, 1), (0, 3, 1),
    (1, 0, 1), (1, 1, 2), (1, 2, 1), (1, 3, 1), (1, 4, 1),
    (2, 0, 2),  # c and d have the same tf in document 0: equal term scores
    (3, 0, 2),
    (4, 3, 1), (4, 4, 1),  # documents 3 and 4 tie on e
]
DOCS = [(0, "d0", 10), (1, "d1", 10), (2, "d2", 20), (3, "d3", 5), (4, "d4", 5)]
# 0.3979400 * 2 * 2.5 / (2 + 1.5 * 1) = 0.5684857
C_IN_0 = 0.5684857
# 0.2218487 * 1 * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 0.5)) = 0.2862564
E_IN_3 = 0.2862564
# -0.0791812 * 2.5 / (1 + 1.5) = -0.0791812
B_IN_0 = -0.0791812


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def index(spark, docs=None, postings=None, unique=True):
    docs = DOCS if docs is None else docs
    lengths = [d[2] for d in docs]
    return Index(
        postings=frame(spark, POSTINGS if postings is None else postings, schemas.POSTINGS),
        dict=frame(spark, DICT, schemas.DICT),
        docs=frame(spark, docs, schemas.DOCS),
        stats=frame(spark, [(len(docs), sum(lengths) / len(docs))], schemas.STATS),
        unique_docs=unique,
    )


def queries(spark, *lists):
    from termspire.sources import literal_queries

    return literal_queries(spark, [list(terms) for terms in lists])


def corpus(spark, texts):
    table = pa.table(
        {"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}
    )
    return spark.createDataFrame(table)

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
import pytest
from awkward import ROWS, documents, empty

from comparison import connect, differences
from termspire.llm import lexical_search, registered

SF = "/root/testdata/sf0.01"


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, queries, k=10):
    """Every document scored for every query; rows of (item, rank, doc_id, score)."""
    counted = [(key, Counter(terms(t))) for key, t in docs]
    counted = [(key, c, c.total()) for key, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    rows = []
    for item, text in queries:
        scores = []
        for key, c, n in counted:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = 0
            for t in terms(text):
                if t in c:
                    w = floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        rows += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return rows


def got(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=repr)


def make(seed, n, queries):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    docs = [(i, " ".join(rng.choices(words, k=int(rng.paretovariate(0.5)) % 300))) for i in range(n)]
    return docs, [(i, " ".join(rng.choices(words, k=rng.randint(1, 20)))) for i in range(queries)]


def test_agrees_with_scoring_everything(spark):
    docs, queries = make(7, 700, 30)
    index = lexical_search.build(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3))
    assert index.n_docs == sum(bool(terms(t)) for _, t in docs)
    assert index.n_terms == sum(len(terms(t)) for _, t in docs)
    asked = spark.createDataFrame(queries, "item_id bigint, text string")
    assert got(lexical_search.search(index, asked)) == sorted(plain(docs, queries), key=repr)


@pytest.mark.parametrize(("block", "span"), [(128, 4096), (4, 16), (2, 3), (1, 1)])
def test_small_blocks_and_ranges(monkeypatch, block, span):
    """One shard, searched without Spark; small blocks make rejections frequent."""
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "RANGE", span)
    docs, queries = make(8, 400, 40)
    shard = lexical_search._Shard()
    for key, text in docs:
        shard.add(key, text.encode())
    rows = pa.Table.from_batches(list(shard.rows(0)))
    counted = [Counter(terms(t)) for _, t in docs]
    n_docs, n_terms = sum(bool(c) for c in counted), sum(c.total() for c in counted)
    df = Counter(t for c in counted for t in c)
    asked = {
        q: {t: n * lexical_search.weight(n_docs, df[t]) for t, n in Counter(terms(text)).items() if t in df}
        for q, text in queries
    }
    asked = {q: {t: w for t, w in x.items() if w > 0} for q, x in asked.items()}
    for k in (1, 3, 10, 1000):
        found = lexical_search._search_shard(rows, asked, k, n_docs, n_terms).to_pylist()
        want = [(item, doc, score) for item, _, doc, score in plain(docs, queries, k)]
        assert [(r["query"], r["doc_id"], r["score"]) for r in found] == want


def test_blocks_are_skipped(monkeypatch):
    """A frequent word of little weight beside a rare one: most of its blocks stay compressed."""
    monkeypatch.setattr(lexical_search, "RANGE", 256)
    rng = random.Random(1)
    shard = lexical_search._Shard()
    for key in range(8000):
        shard.add(key, b"common " + (b"rare " if key % 400 == 3 else b"") + b"x " * rng.randint(1, 40))
    rows = [r for b in shard.rows(0) for r in b.to_pylist()]
    lengths = np.frombuffer(rows[0]["postings"], np.int64)
    lists = {r["term"]: lexical_search._List(r, lengths, 8000, int(lengths.sum())) for r in rows[1:]}
    used = [(lists["common"], 1), (lists["rare"], 6000)]
    docs, scores = lexical_search.best(used, 8000, 5)
    assert all(d % 400 == 3 for d in docs) and sorted(scores, reverse=True) == list(scores)
    assert len(lists["common"].read) < len(lists["common"].lasts) / 2


def test_given_tables_agree_with_sql(spark):
    name = "op11_ranked_lexical_search"
    found = registered.queries()[name](spark, SF).toArrow()
    assert differences(found, connect(SF).sql(registered.oracle_sql()[name]).to_arrow_table()) is None


def test_queries_in_blocks(spark, monkeypatch):
    docs, queries = make(9, 200, 25)
    index = lexical_search.build(spark.createDataFrame(docs, "doc_id bigint, text string"))
    monkeypatch.setattr(lexical_search, "QUERY_BYTES", 300)
    asked = spark.createDataFrame(queries, "item_id bigint, text string")
    assert got(lexical_search.search(index, asked, 4)) == sorted(plain(docs, queries, 4), key=repr)


def test_awkward_rows(spark):
    queries = [(1, "The fox, a WORD"), (1, "The fox, a WORD"), (2, None), (3, ""), (None, "漢字かな交じり文 one"), (4, "zzz ..."), (5, "two " * 3000)]
    index = lexical_search.build(documents(spark))
    asked = spark.createDataFrame(queries, "item_id bigint, text string")
    found = lexical_search.search(index, asked)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(found) == sorted(plain(ROWS, queries), key=repr)


def test_empty_tables(spark):
    asked = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert lexical_search.search(lexical_search.build(empty(spark)), asked).count() == 0
    assert lexical_search.search(lexical_search.build(documents(spark)), asked.limit(0)).count() == 0

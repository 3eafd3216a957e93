import hashlib
import random

import numpy as np
from awkward import ROWS, documents, empty

from termspire.llm import decontaminate
from termspire.llm.decontaminate import contamination, passages_of, removal_spans, search, without, words_of
from termspire.llm.fm_index import FMIndex, suffix_order


def brute(texts, items, window=10):
    owners = {}
    for item, text in items:
        words = words_of((text or "").encode())
        size = min(window, len(words))
        for start in range(len(words) - size + 1 if size else 0):
            owners.setdefault(tuple(words[start : start + size]), set()).add(item)
    made = []
    for text in texts:
        words = words_of((text or "").encode())
        hit, found = [False] * len(words), set()
        for size in {len(o) for o in owners}:
            for start in range(len(words) - size + 1):
                own = owners.get(tuple(words[start : start + size]))
                if own is not None:
                    hit[start : start + size] = [True] * size
                    found |= own - {None}
        made.append((len(words), hit, found))
    return made


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(1)
    for _ in range(40):
        symbols = np.append(rng.integers(0, 4, rng.integers(1, 200)), 0).astype(np.int32)
        order = suffix_order(symbols)
        assert sorted(order.tolist()) == list(range(len(symbols)))
        index = FMIndex(symbols, 4)
        for size in (1, 2, 3, 5):
            patterns = rng.integers(1, 4, (20, size))
            low, high = index.search(patterns)
            for pattern, a, b in zip(patterns, low, high, strict=True):
                places = [n for n in range(len(symbols) - size + 1) if (symbols[n : n + size] == pattern).all()]
                assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == places


def test_agrees_with_brute_force():
    rng = random.Random(2)
    words = ["a", "b", "C", "dd", "é", "7"]
    for _ in range(150):
        items = [(str(k), rng.choice([" ", "-", "\n"]).join(rng.choices(words, k=rng.randint(0, 6)))) for k in range(4)]
        texts = [rng.choice([" ", ", "]).join(rng.choices(words + ["x", "zz"], k=rng.randint(0, 60))) for _ in range(5)]
        counts, hits, found = search([t.encode() for t in texts], passages_of(items, 3))
        for n, (size, hit, own) in enumerate(brute(texts, items, 3)):
            assert counts[n] == size and found[n] == own
            assert (hits[n].tolist() if hits[n] is not None else [False] * size) == hit


def test_spans_cut_whole_words():
    text = "Eins, zwei-drei é 漢字 VIER; fünf"
    hit = np.array([False, True, True, False, True, False, True])
    spans = removal_spans(text.encode(), hit)
    assert [text[a:b] for a, b in spans] == ["zwei-drei", "漢字", "fünf"]
    assert without(text, spans) == "Eins,  é  VIER; "


def test_awkward_rows_in_several_blocks(spark, monkeypatch):
    items = [(1, ROWS[0][1]), (2, "word"), (2, None), (3, ""), (None, "among the others"), (12, ROWS[0][1]), (4, "!!!")]
    benchmark = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id bigint, text string, key string")
    expected = []
    own = [(None if a is None else str(a), b) for a, b in items]
    for (key, _), (size, hit, found) in zip(ROWS, brute([t for _, t in ROWS], own), strict=True):
        listed = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        expected.append((key or 0, size, sum(hit), len(found), listed, any(hit)))
    for size in (1 << 20, 40):
        monkeypatch.setattr(decontaminate.blocks_of, "__defaults__", (size,))
        rows = contamination(documents(spark), benchmark).collect()
        assert sorted((r.doc_id or 0, *r[1:6]) for r in rows) == sorted(expected)
    assert contamination(empty(spark), benchmark).count() == 0
    assert contamination(documents(spark), benchmark.limit(0)).where("contaminated").count() == 0


def test_removal_keeps_columns_and_other_documents(spark):
    docs = documents(spark)
    benchmark = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven"), (2, "word")], "item_id int, text string")
    left = decontaminate.decontaminate(docs, benchmark)
    assert left.schema == docs.schema
    rows = {(r.doc_id, r.text, r.n_chars) for r in left.collect()}
    assert left.count() == len(ROWS) - 1  # the document of one hit word is gone
    assert (1, "one ", 4) in rows and (2, None, None) in rows and (3, "", 0) in rows
    assert {k for k, _, _ in rows} == {k for k, _ in ROWS} - {9}

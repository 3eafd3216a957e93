import itertools
import zlib

import numpy as np
from awkward import ROWS, documents, empty

from termspire.llm import language

SF = "/root/testdata/sf0.01"


def test_path_agrees_with_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        lengths = rng.integers(0, 6, 5)
        scores = rng.normal(0, 3, (int(lengths.sum()), 3)).astype(np.float32)
        labels, at = language.label_words(lengths, scores, 2.0), 0
        for size in lengths.tolist():
            own = scores[at : at + size]

            def value(path, own=own):
                return sum(own[n, s] for n, s in enumerate(path)) - 2 * sum(a != b for a, b in itertools.pairwise(path))

            best = max((value(p) for p in itertools.product(range(3), repeat=size)), default=0)
            assert abs(value(labels[at : at + size].tolist()) - best) < 1e-4
            at += size


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    held = {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    model = language.train(docs.where(~docs.doc_id.isin(list(held))))
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    right = [found[r.doc_id].lang_pred == r.lang for r in rows if r.doc_id in held]
    assert sum(right) / len(right) > 0.97
    assert all(0 < r.score <= 1 for r in found.values())


def test_mixed_texts_have_spans(spark):
    train = [(1, "the cat and the dog with this house " * 30, "en"), (2, "кошка и собака в этом доме " * 30, "ru")]
    train += [(3, "der hund und die katze im diesem haus " * 30, "de")]
    model = language.train(spark.createDataFrame(train, "doc_id int, text string, lang string"))
    text = "the cat and the dog " * 4 + "der hund und die katze " * 4 + "собака и кошка 12"
    [(name, share, spans)] = language.label_texts([text], model)
    assert name == "de" and 0.3 < share < 0.6
    assert [(s["first"], s["end"], s["lang"]) for s in spans] == [(0, 20, "en"), (20, 40, "de"), (40, 44, "ru")]


def test_awkward_rows(spark):
    docs = documents(spark)
    model = language.train(docs)
    rows = language.identify(docs, model).collect()
    assert len(rows) == len(ROWS)
    got = {(r.doc_id, r.lang_pred) for r in rows}
    assert {(2, "und"), (3, "und"), (4, "und"), (8, "und"), (None, "und"), (1, "en"), (7, "en")} <= got
    kept = language.keep_identified(docs, model)
    assert kept.schema == docs.schema
    letters = sum(any(c.isalpha() for c in t or "") for _, t in ROWS)
    assert kept.count() == letters
    nothing = language.train(empty(spark))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(empty(spark), model).count() == 0

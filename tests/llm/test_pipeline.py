import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from awkward import ROWS, documents, empty
from test_decontaminate import brute as brute_passages
from test_line_dedup import brute as brute_lines
from test_near_duplicates import brute as brute_groups

import corpus_pipeline
from termspire.llm import bpe, language
from termspire.llm.decontaminate import removal_spans, without
from termspire.plans import staging
from termspire.plans.staging import stage

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage, and what comes out of the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = [docs]
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SF), name)
        made.append(docs)
    return made


def rows(frame):
    return sorted((r.doc_id, r.text, r.source, r.n_chars) for r in frame.collect())


def test_columns_stay_until_the_last(stages):
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.columns == before.columns


def test_language(stages):
    """Against the decisions of `identify`, whose own tests compare them with brute force."""
    model = language.train(stages[0])
    found = {r.doc_id: r for r in language.identify(stages[0], model).collect()}
    kept = {k for k, r in found.items() if r.lang_pred != language.UNKNOWN and r.score >= language.LEAST_SHARE}
    assert rows(stages[1]) == [r for r in rows(stages[0]) if r[0] in kept]
    given = {r.doc_id: r.lang for r in stages[0].collect()}
    for r in stages[1].collect():
        assert r.lang == (given[r.doc_id] or found[r.doc_id].lang_pred)


def test_mixed_texts_go_and_labels_are_filled_in(spark):
    english = "the quick brown fox and the lazy dog went over there with that other thing "
    german = "der schnelle braune Fuchs und der faule Hund gingen nicht ohne ihre Freunde weg "
    rows = [(n, english * 3, "en") for n in range(20)] + [(20 + n, german * 3, "de") for n in range(20)]
    rows += [(50, german, None), (51, english, None), (52, "123 ... 456", "en"), (53, None, None)]
    rows += [(54, english * 4 + german * 4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    left = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, SF).collect()}
    assert left[50] == "de" and left[51] == "en" and set(range(40)) <= set(left)
    assert not {52, 53} & set(left)
    model = language.train(docs)
    strict = {r.doc_id for r in language.keep_identified(docs, model, least=0.9).collect()}
    assert strict == {*range(40), 50, 51}
    english_only = {r.doc_id for r in language.keep_identified(docs, model, languages=["en"], least=0.9).collect()}
    assert english_only == {*range(20), 51}


def test_without_labels_all_letters_go_on(spark):
    rows = [(1, "some words", None), (2, "42", None), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert [tuple(r) for r in corpus_pipeline.identify_language(spark, docs, SF).collect()] == rows[:1]


def test_lines(stages):
    before = rows(stages[1])
    left = brute_lines([(k, s, t) for k, t, s, _ in before], 0.1, 2)
    cut = {k: t for k, _, _, _, t in left}
    expected = []
    for key, text, source, n in before:
        if not cut[key].strip(" "):
            cut[key] = text  # nothing but common lines: it stays whole
        if cut[key].strip(" "):
            expected.append((key, cut[key], source, n if cut[key] == text else len(cut[key])))
    assert rows(stages[2]) == expected and expected != before


def test_groups(stages):
    before = rows(stages[2])
    kept = {k for k, _, component in brute_groups([r[:2] for r in before]) if k == component}
    assert rows(stages[3]) == [r for r in before if r[0] in kept] and len(kept) < len(before)


def test_passages(spark, stages):
    before = rows(stages[3])
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = []
    for (key, text, source, n), (size, hit, _) in zip(before, brute_passages([r[1] for r in before], items), strict=True):
        if any(hit) and sum(hit) < size:
            text = without(text, removal_spans(text.encode(), np.array(hit)))
            n = len(text)
        if not any(hit) or sum(hit) < size:
            expected.append((key, text, source, n))
    assert rows(stages[4]) == expected and expected != before


def test_tokens(stages):
    content = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(content), special_tokens={}
    )
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    found = stages[5].collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for row in found:
        own = np.array(library.encode_ordinary(texts[row.doc_id]), "<u4").tobytes()
        assert bytes(row.ids) == own and row.n_tokens == len(own) // 4
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_run_is_the_stages_in_order(spark, stages):
    before = len(staging._staged)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted(tuple(r) for r in stages[-1].collect())
    assert len(staging._staged) == before  # tables of the stages are deleted


def test_awkward_rows(spark):
    docs = documents(spark)
    for _, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SF), "awkward")
    keys = sorted((r.doc_id or 0) for r in docs.collect())
    letters = {k for k, t in ROWS if any(c.isalpha() for c in t or "")}
    assert keys == sorted({(k or 0) for k in letters} - {6})  # 6 repeats the text of 1
    docs = empty(spark)
    for _, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SF), "empty")
    assert docs.count() == 0


def test_rows_go_by_their_own_text(spark):
    a, b, c = (" ".join(f"{x}{n}" for n in range(60)) for x in "abc")
    near = lambda text: f"{text} more"
    rows = [(1, a), (1, b), (1, near(b)), (2, near(a)), (3, f"{a} {b} {c}"), (None, near(a)), (None, c), (None, c), (None, near(c))]
    frame = documents(spark, rows + [(4, None), (4, "")])
    left = corpus_pipeline.drop_near_duplicates(spark, frame, SF)
    assert left.schema == frame.schema
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    expected = [(1, a), (1, b), (3, f"{a} {b} {c}"), (None, c), (4, None), (4, "")]
    assert got == sorted(expected, key=repr)

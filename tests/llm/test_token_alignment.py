import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from awkward import ROWS, documents, empty
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from termspire.llm import registered, token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizers():
    return token_alignment.read_tokenizers(A, B)


@pytest.fixture(scope="module")
def plain():
    """What the contract asks of a list of texts, worked out token by token without the operator."""
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=B)
    byte_of = characters_of_bytes()

    def pieces(text):
        ids = first.encode(" " + text, add_special_tokens=False).ids
        a = [(n, bytes(byte_of[c] for c in first.id_to_token(n))) for n in ids]
        b = []
        for n in second.encode(text):
            p = second.id_to_piece(n)
            b.append((n, bytes([int(p[3:5], 16)]) if second.is_byte(n) else p.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        ok = text and b"".join(x for _, x in a) == whole and b"".join(x for _, x in b) == whole
        return (a, b) if ok else ([], [])

    def spans(tokens):
        found, at = [], 0
        for n, x in tokens:
            found.append((n, at, at + len(x)))
            at += len(x)
        return found

    def solve(values):
        rows = []
        for text in values:
            a, b = map(spans, pieces(text or ""))
            links = [(x[0], y[0]) for x in a for y in b if max(x[1], y[1]) < min(x[2], y[2])]
            common = sorted({x[2] for x in a} & {y[2] for y in b})
            groups, start = [], 0
            for end in common:
                inside = [",".join(str(x[0]) for x in side if start <= x[1] and x[2] <= end) for side in (a, b)]
                groups.append("|".join(inside))
                start = end
            rows.append((len(a), len(b), groups, links))
        held = Counter(p for row in rows for p in set(row[3]))
        top = defaultdict(int)
        for (x, _), n in held.items():
            top[x] = max(top[x], n)
        return [
            (
                n_a, n_b, len(groups), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links),
                hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "", ";".join(groups),
            )
            for n_a, n_b, groups, links in rows
        ]

    return solve


def characters_of_bytes():
    """The byte of each character of the byte-level alphabet; characters from 256 on stand for the other bytes."""
    from tokenizers.pre_tokenizers import ByteLevel

    shown = {c: ord(c) for c in ByteLevel.alphabet() if ord(c) < 256}
    hidden = sorted(c for c in ByteLevel.alphabet() if ord(c) >= 256)
    return shown | dict(zip(hidden, [n for n in range(256) if n not in shown.values()], strict=True))


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


def pool_texts(seed, n):
    rng = random.Random(seed)
    pool = ["the ", "tion", "Hello", " world", "\n", "  ", "é", "漢字", "😀", "<|endoftext|>", "<s>", "1234", "▁", "\t", "'ll", "a", "ﬁ", "\x00"]
    return ["".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(n)]


def test_random_texts_agree_with_every_pair_of_tokens(spark, tokenizers, plain, monkeypatch):
    monkeypatch.setattr(token_alignment, "WINDOW", 4)
    values = pool_texts(1, 300)
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string").repartition(5)
    found = token_alignment.align(docs, tokenizers).documents().orderBy("doc_id").collect()
    assert [tuple(r[c] or ("" if c == "groups" else r[c]) for c in COLUMNS) for r in found] == plain(values)


@pytest.mark.parametrize("window", [1, 2, 7, 1 << 16])
def test_windows_do_not_change_groups(tokenizers, window):
    pair = tokenizers.open()
    for text in [*pool_texts(2, 40), "a" * 5000, "supercalifragilistic " * 200]:
        for a, b in pair.encode([text]):
            whole = [g for groups, _, _ in token_alignment.Aligner(pair, a, b).windows(1 << 20) for g in groups]
            cut = [g for groups, _, _ in token_alignment.Aligner(pair, a, b).windows(window) for g in groups]
            assert whole == cut


def test_probing_finds_the_whole_run():
    rng = random.Random(4)
    for _ in range(500):
        n, extra = rng.randint(0, 70), rng.randint(0, 5)
        a = list(range(0, 3 * n, 3)) + [10_000 + k for k in range(extra)]
        b = [-5] * 3 + list(range(0, 3 * n, 3)) + [20_000 + k for k in range(rng.randint(0, 5))]
        assert token_alignment.one_to_one(a, b, 0, 3) == n


def test_given_documents(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    short = [r for r in docs if len(r.text or "") < 3000]
    found = {r.doc_id: r for r in registered.op12_cross_tokenizer_alignment(spark, SF).collect()}
    assert len(found) == len(docs)
    # Counts are over all documents, so only what a document's own tokens decide is compared here.
    for r, want in zip(short, plain([r.text for r in short]), strict=True):
        got = found[r.doc_id]
        assert (got.n_a, got.n_b, got.n_groups, got.n_links, got.groups_sha256) == (*want[:4], want[6])


def test_counts_over_given_documents(spark, tokenizers, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1200")
    values = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: r for r in token_alignment.align(docs, tokenizers).documents().collect()}
    for key, want in zip(values, plain(list(values.values())), strict=True):
        assert tuple(found[key][c] for c in COLUMNS) == want


def test_awkward_rows(spark, tokenizers):
    found = token_alignment.align(documents(spark), tokenizers).documents()
    assert found.columns == ["doc_id", *COLUMNS]
    rows = found.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r.doc_id in (2, 3):
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (0, 0, 0, 0, 0, 0, "")
        elif r.doc_id is not None:
            assert r.n_links == r.n_a + r.n_b - r.n_groups and r.n_best <= r.n_links <= r.count_sum
    assert len({tuple(r) for r in rows if r.doc_id == 6}) == 1
    assert token_alignment.align(empty(spark), tokenizers).documents().count() == 0


def test_pair_counts(spark, tokenizers):
    docs = spark.createDataFrame([(1, "hello world"), (2, "hello world"), (2, "hello")], "doc_id bigint, text string")
    counts = {(r.a, r.b): (r.documents, r.best) for r in token_alignment.align(docs, tokenizers).counts.collect()}
    # `hello` is one token of A and two of B.
    assert sorted(counts.values()) == [(2, True), (3, True), (3, True)]


def test_the_quick_library_agrees_with_the_tokenizer_file(tokenizers):
    pair = tokenizers.open()
    points = [c for c in range(0, 0x110000, 5) if not 0xD800 <= c < 0xE000]
    texts = [f" a{chr(c)}b 1{chr(c)}2 !{chr(c)}! {chr(c)} {chr(c)}\n" for c in points] + [" " + t for t in pool_texts(3, 2000)]
    for text, want in zip(texts, pair._whole.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert pair._first(text) == want.ids


@pytest.mark.parametrize("text", ["x" + " " * 1_000_000 + "y", "\n \t" * 400_000, " " * 9_999, "a" * 300_000, "漢" * 200_000, "a b " * 200_000])
def test_very_long_runs(tokenizers, text):
    pair = tokenizers.open()
    ((a, b),) = pair.encode([text])
    assert not a or a == pair._whole.encode(" " + text, add_special_tokens=False).ids
    aligner = token_alignment.Aligner(pair, a, b)
    links = sum(len(x) for _, x, _ in aligner.windows())
    assert links == len(a) + len(b) - aligner.n_groups

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from awkward import ROWS, documents, empty

from termspire.llm import bpe

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = bpe.parse_ranks(bpe.read_vocabulary(FILE))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.vocabulary(bpe.read_vocabulary(FILE)), public_tokenizers.PATTERN)


def ids(found):
    return np.frombuffer(found, "<u4").tolist()


def test_agrees_with_the_library_on_random_texts(encoder, library):
    rng = random.Random(5)
    pool = ["a", "b", "ab", "aaaa", " ", "  ", "\n", "\t ", "\x1c", "\x85", "\xa0 ", " ", "é", "漢", "😀"]
    pool += ["'s", "'ll", "1", "99", "!!!", "hello", "<|endoftext|>", "\r\n", "ß", "́", "The", " the"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(4000)]
    for text, found in zip(texts, encoder.encode(texts), strict=True):
        assert ids(found) == library.encode_ordinary(text)
        assert encoder.decode(found) == text.encode()


def test_long_words_and_repeats(encoder, library):
    rng = random.Random(6)
    texts = ["a" * 5000, "ab" * 3000, "".join(rng.choices("abcdefgh", k=20_000)), "x" * 4999 + " " * 501]
    for text, found in zip(texts, encoder.encode(texts), strict=True):
        assert ids(found) == library.encode_ordinary(text)


def test_the_memory_of_words_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = bpe.Encoder(bpe.vocabulary(bpe.read_vocabulary(FILE)), public_tokenizers.PATTERN)
    for batch in (["one two three four five"], ["two three six"], ["one six seven"]):
        assert [ids(x) for x in own.encode(batch)] == [library.encode_ordinary(t) for t in batch]


def test_awkward_rows(spark, library):
    found = bpe.encode(documents(spark), FILE, public_tokenizers.PATTERN).collect()
    got = sorted((r.doc_id or 0, r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) for r in found)
    expected = []
    for key, text in ROWS:
        own = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        digests = (hashlib.sha256(own).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        expected.append((key or 0, len(own) // 4, own, *digests))
    assert got == sorted(expected)
    assert bpe.encode(empty(spark), FILE, public_tokenizers.PATTERN).count() == 0

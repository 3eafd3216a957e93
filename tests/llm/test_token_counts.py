import math
import random
import time

import public_tokenizers
from awkward import ROWS, documents, empty

from termspire.llm.bpe import parse_ranks, read_vocabulary
from termspire.llm.token_counts import Counter, Unigrams, token_counts

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(word, model):
    """The best segmentation, over all of them by recursion from the end."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            own = model.scores.get(word[start:end])
            if own is not None:
                score, n = best[start]
                options.append((score + own, -(n + 1)))
        score, n = max(options)
        best.append((score, -n))
    return best[-1]


def test_shared_prefixes_do_not_change_a_word():
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {w: 256 + n for n, w in enumerate([b" a", b"ab", b"aba", b"ba", b" ab", b"bab", b"abab"])}
    model, rng = Unigrams(ranks), random.Random(3)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 12))).encode() for _ in range(400)}
    counter = Counter(model)
    counter.learn(words)
    for word in words:
        score, n = brute(b" " + word, model)
        assert counter.known[word][0] == n
        assert math.isclose(counter.known[word][1], score)


def test_awkward_rows(spark):
    model = Unigrams(parse_ranks(read_vocabulary(FILE)))
    got = sorted((r.doc_id or 0, r.n_words, r.n_tokens, r.log_prob) for r in token_counts(documents(spark), FILE).collect())
    expected = []
    for key, text in ROWS:
        words = (text or "").encode().split()
        known = {w: brute(b" " + w, model) for w in set(words)}
        expected.append((key or 0, len(words), sum(known[w][1] for w in words), sum(known[w][0] for w in words)))
    for a, b in zip(got, sorted(expected), strict=True):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], abs_tol=1e-6)
    assert token_counts(empty(spark), FILE).count() == 0


def test_long_words_take_time_by_their_length():
    model, rng = Unigrams(parse_ranks(read_vocabulary(FILE))), random.Random(4)
    for word in (bytes(rng.choices(range(33, 127), k=900_000)), b"a" * 300_000, "漢字".encode() * 100_000):
        counter, began = Counter(model), time.process_time()
        counter.learn({word})
        assert time.process_time() - began < 15
    words = {bytes(rng.choices(b"abcdetion", k=n)) for n in (4090, 4096, 4097, 5000)}
    counter = Counter(model)
    counter.learn(words)
    for word in words:
        score, n = 0.0, 0
        table = [(0.0, 0)]
        for end in range(1, len(word) + 2):
            whole = b" " + word
            options = [
                (table[s][0] + model.scores[whole[s:end]], -(table[s][1] + 1))
                for s in range(max(0, end - 40), end)
                if whole[s:end] in model.scores
            ]
            score, n = max(options)
            table.append((score, -n))
        assert counter.known[word][0] == -n and math.isclose(counter.known[word][1], score)

"""Token counts under a unigram model: best segmentations shared by the prefixes of a trie."""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from termspire.llm.batches import map_parts, raw_texts
from termspire.llm.bpe import parse_ranks, read_vocabulary

# Words whose counts a task remembers between parts; beyond it, the memory starts anew.
REMEMBERED = 400_000
PART_BYTES = 6 << 20
# A longer word is scored by itself, along an array of its prefixes, and isn't kept in a trie.
LONG = 1 << 12


class Unigrams:
    """A log probability for each token: Zipf's law over the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        norm = math.log(sum(1 / (r + 1) for r in ranks.values()))
        self.scores = {token: -math.log(r + 1) - norm for token, r in ranks.items()}
        # Every end of a token: its score if it is one itself, else None.
        self.ends: dict[bytes, float | None] = dict.fromkeys(t[n:] for t in ranks for n in range(len(t)))
        self.ends.update(self.scores)

    def last_token(self, word: bytes, end: int, score: list[float], count: list[int]) -> tuple[float, int]:
        """The best (score, tokens) of the first `end` bytes, from those of all shorter prefixes.

        The last token is sought from its end backwards, and as soon as no token ends so, none that
        is longer does: a few bytes are looked at, however long the word is.
        """
        best, fewest, ends = -math.inf, 0, self.ends
        for start in range(end - 1, -1, -1):
            piece = word[start:end]
            if piece not in ends:
                break
            own = ends[piece]
            if own is not None:
                value, n = score[start] + own, count[start] + 1
                if value > best or (value == best and n < fewest):
                    best, fewest = value, n
        return best, fewest

    def forward(self, word: bytes) -> tuple[int, float]:
        """Tokens and score of one word, without a trie."""
        score, count = [0.0], [0]
        for end in range(1, len(word) + 1):
            best, fewest = self.last_token(word, end, score, count)
            score.append(best)
            count.append(fewest)
        return count[-1], score[-1]


class Trie:
    """Distinct words, byte by byte; every node holds the best score of its prefix.

    The forward score of a prefix is the best sum of token scores over its segmentations; ties go to
    fewer tokens. It depends on nothing but the prefix, so words that share one share the work. A
    node where a word ends is its terminal count: the number of tokens of the word.
    """

    def __init__(self, model: Unigrams):
        self.model = model
        self.children: dict[int, int] = {}  # by 256 * node + byte
        self.score: list[float] = [0.0]
        self.count: list[int] = [0]

    def insert(self, word: bytes) -> int:
        """The node of a word; forward scores are computed for the prefixes that are new."""
        children = self.children
        node, scores, counts = 0, [0.0], [0]
        for depth, byte in enumerate(word, 1):
            edge = 256 * node + byte
            after = children.get(edge)
            if after is None:
                best, fewest = self.model.last_token(word, depth, scores, counts)
                after = children[edge] = len(self.score)
                self.score.append(best)
                self.count.append(fewest)
            node = after
            scores.append(self.score[node])
            counts.append(self.count[node])
        return node


class Counter:
    """Counts the tokens of texts, remembering the words it has met."""

    def __init__(self, model: Unigrams):
        self.model = model
        self.known: dict[bytes, tuple[int, float]] = {}

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        trie = Trie(self.model)
        for word in words:
            if word in self.known:
                continue
            if len(word) > LONG:
                self.known[word] = self.model.forward(b" " + word)
            else:
                node = trie.insert(b" " + word)
                self.known[word] = (trie.count[node], trie.score[node])

    def count(self, batch: list[bytes]) -> list[tuple[int, int, float]]:
        """For each text its words, tokens, and the log probability of the segmentation."""
        cut = [text.split() for text in batch]
        self.learn(set().union(*cut))
        made = []
        for words in cut:
            found = [self.known[w] for w in words]
            made.append((len(words), sum(n for n, _ in found), math.fsum(s for _, s in found)))
        return made


@lru_cache(maxsize=2)
def _model(content: bytes) -> Unigrams:
    return Unigrams(parse_ranks(content))


@lru_cache(maxsize=2)
def _counter(content: bytes) -> Counter:
    return Counter(_model(content))


def token_counts(
    docs: DataFrame, vocabulary_file: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Tokens of every whole text under a unigram model over a vocabulary of ranks.

    Returns key, `n_words`, `n_tokens`, `log_prob` (natural logarithm, of the best segmentation of
    each word). Words are cut at ASCII white space; each is scored with the space before it. A null
    or empty text, or one of white space only, has none of either and 0.0. Repeated rows and null
    keys stay; other columns are not looked at. No row is shuffled, the vocabulary is under a
    megabyte, and a task holds a trie over the distinct words of a bounded part.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_file))

    def run(part: pa.RecordBatch) -> dict:
        made = _counter(content.value).count(raw_texts(part, 1))
        return {
            "key": part.column(0),
            "n_words": pa.array([m[0] for m in made], pa.int64()),
            "n_tokens": pa.array([m[1] for m in made], pa.int64()),
            "log_prob": pa.array([m[2] for m in made], pa.float64()),
        }

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words bigint, n_tokens bigint, log_prob double"
    made = map_parts(docs, {"key": key, "text": text}, run, schema, PART_BYTES)
    return made.withColumnRenamed("key", key)

"""Byte-level BPE: encoding by replaying the merges over all distinct words of a part, and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from termspire.llm.batches import map_parts, texts

# Words whose encoding a task remembers between parts; beyond it, the memory starts anew.
REMEMBERED = 300_000
PART_BYTES = 2 << 20
_KEY = 1 << 20
_NONE = np.int32(2**31 - 1)


class Vocabulary:
    """The ranks of a tokenizer file, and for each pair of tokens the token that they merge to."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * _KEY + right] = rank
        self._keys = np.array(sorted(pairs), np.int64)
        self._ranks = np.array([pairs[k] for k in self._keys.tolist()], np.int32)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of tokens, _NONE for those that do not merge."""
        if not len(self._keys):
            return np.full(len(left), _NONE, np.int32)
        keys = left.astype(np.int64) * _KEY + right
        at = np.searchsorted(self._keys, keys).clip(max=len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], _NONE)


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks from the content of a file with lines of a base64 token and its rank."""
    rows = (line.split() for line in content.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in rows}


@lru_cache(maxsize=2)
def vocabulary(content: bytes) -> Vocabulary:
    return Vocabulary(parse_ranks(content))


def encode_words(words: list[bytes], vocab: Vocabulary) -> tuple[bytes, list[int]]:
    """The token ids of all words, as little-endian 32-bit integers, and where those of each end.

    An index from rank to the places where a pair of that rank stands is kept up to date: the merge
    of lowest rank that occurs anywhere is applied at all its places, from left to right where they
    overlap, and only the pairs beside a merged one are looked up again.
    """
    joined = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    total = len(joined)
    if not total:
        return b"", [0] * len(words)
    ends = np.cumsum(lengths)
    token = vocab.bytes[joined]
    following = np.arange(1, total + 1, dtype=np.int32)
    following[ends[lengths > 0] - 1] = -1
    before = np.arange(-1, total - 1, dtype=np.int32)
    before[(ends - lengths)[lengths > 0]] = -1
    alive = np.ones(total, bool)
    merging = np.zeros(total, bool)
    rank = np.full(total, _NONE, np.int32)

    places: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def look_up(at: np.ndarray) -> None:
        """Find the pairs that start at these places, and enter them in the index."""
        has = following[at] >= 0
        found = np.full(len(at), _NONE, np.int32)
        left = at[has]
        found[has] = vocab.merged(token[left], token[following[left]])
        rank[at] = found
        at, found = at[found != _NONE], found[found != _NONE]
        if not len(at):
            return
        order = np.argsort(found, kind="stable")
        at, found = at[order], found[order]
        cuts = np.flatnonzero(np.diff(found)) + 1
        starts = [0, *cuts.tolist(), len(at)]
        for first, end in zip(starts, starts[1:], strict=False):
            key = int(found[first])
            if key not in places:
                places[key] = []
                heapq.heappush(heap, key)
            places[key].append(at[first:end])

    look_up(np.arange(total, dtype=np.int32))
    while heap:
        now = heapq.heappop(heap)
        groups = places.pop(now)
        at = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
        at = at[alive[at] & (rank[at] == now)]
        if not len(at):
            continue
        at.sort()
        if len(at) > 1:
            # Of places that overlap in a row, the first, third, … merge and use up the others.
            overlap = following[at[:-1]] == at[1:]
            if overlap.any():
                index = np.arange(len(at))
                head = np.concatenate(([True], ~overlap))
                since = index - np.maximum.accumulate(np.where(head, index, 0))
                at = at[since % 2 == 0]
        second = following[at]
        after = following[second]
        token[at] = now
        alive[second] = False
        following[at] = after
        inner = after >= 0
        before[after[inner]] = at[inner]
        ahead = before[at]
        merging[at] = True
        ahead = ahead[(ahead >= 0) & ~merging[ahead]]
        merging[at] = False
        look_up(np.concatenate((at, ahead)))
    word = np.repeat(np.arange(len(words)), lengths)
    sizes = np.bincount(word[alive], minlength=len(words))
    return token[alive].astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()


# White space of the pattern that could stand before a space, so that the two belong together.
_DOUBLE = ["  ", "\n ", "\t ", "\r ", "\v ", "\f "]


class Splitter:
    """Cuts a text at single spaces, where no match of the pattern can pass, to meet words again.

    A match holds a space only at its start or among white space, so a text may be cut before each
    space that follows something else; the pieces are matched separately and only once.
    """

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        self.odd = regex.compile(r"\s ")
        self.cut = regex.compile(r"(?<=\S) ")

    def pieces(self, text: str) -> list[str]:
        if any(x in text for x in _DOUBLE) or (not text.isascii() and self.odd.search(text)):
            return self.cut.split(text)
        return text.split(" ")


class Encoder:
    """Encodes texts, remembering the ids of pieces that it has met."""

    def __init__(self, vocab: Vocabulary, pattern: str):
        self.vocab, self.split = vocab, Splitter(pattern)
        self.first: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def learn(self, wanted: set[str], table: dict[str, bytes], prefix: str) -> None:
        pieces = [p for p in wanted if p not in table]
        plain = [p.isascii() and p.isalpha() for p in pieces]  # one match each, seen without a search
        whole = {prefix + p for p, one in zip(pieces, plain, strict=True) if one}
        matches = {p: self.split.find(prefix + p) for p, one in zip(pieces, plain, strict=True) if not one}
        words = list(whole.union(*matches.values()))
        ids, ends = encode_words([w.encode() for w in words], self.vocab)
        coded = {w: ids[a:b] for w, a, b in zip(words, [0, *ends], ends, strict=False)}
        for piece, one in zip(pieces, plain, strict=True):
            if one:
                table[piece] = coded[prefix + piece]
            else:
                table[piece] = b"".join([coded[w] for w in matches[piece]])

    def encode(self, batch: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.first.clear()
        first: set[str] = set()
        wanted: set[str] = set()
        # Pieces are cut twice, rather than held for all texts.
        for text in batch:
            cut = self.split.pieces(text)
            first.add(cut[0])
            wanted.update(cut[1:])
        self.learn(first, self.first, "")
        self.learn(wanted, self.known, " ")
        known, made = self.known.__getitem__, []
        for text in batch:
            cut = self.split.pieces(text)
            made.append(self.first[cut[0]] + b"".join(map(known, cut[1:])))
        return made

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _encoder(content: bytes, pattern: str) -> Encoder:
    return Encoder(vocabulary(content), pattern)


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(
    docs: DataFrame,
    vocabulary_file: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Token ids of every whole text, and the check of the round trip.

    Returns key, `n_tokens`, `ids` (binary: little-endian unsigned 32-bit integers; left out without
    `with_ids`), `ids_sha256`, `decoded_sha256` (of the bytes the ids stand for). A null or empty
    text has no tokens. Rows keep their order and number, so repeated rows and null keys stay; other
    columns are not looked at. Each match of `pattern` is encoded by itself; special tokens are
    ordinary text. No row is shuffled; a task works on bounded parts of its rows, and remembers the
    words it has met. The vocabulary (a file of ranks, under a megabyte) is read once by the driver.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_file))

    def run(part: pa.RecordBatch) -> dict:
        encoder = _encoder(content.value, pattern)
        ids = encoder.encode(texts(part, 1))
        made = {
            "key": part.column(0),
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids],
        }
        return made | {"ids": pa.array(ids, pa.binary())} if with_ids else made

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens bigint, " + "ids binary, " * with_ids
    schema += "ids_sha256 string, decoded_sha256 string"
    made = map_parts(docs, {"key": key, "text": text}, run, schema, PART_BYTES)
    return made.withColumnRenamed("key", key)

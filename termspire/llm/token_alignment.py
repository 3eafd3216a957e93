"""Alignment of two tokenizers over the same texts: groups, links, and how usual each link is.

Both tokenizers cut the same bytes. Where a token of each ends at the same byte, a group ends. The
ends are compared at the current shift between the two arrays of ends in runs of doubling length, so
a stretch of one-to-one tokens is jumped over; between runs, the two arrays are walked token by token
until they meet, and the shift is what it is then.

Links are counted corpus-wide in two steps. A task numbers the pairs of a bounded part of its rows and
writes, for the part, how many of its documents hold each. The counts of all parts add up by pair,
and return to the parts that hold the pair, never to the documents one by one.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termspire.llm.batches import Numbers, parts, texts
from termspire.plans.staging import stage

# How byte-level BPE of this kind splits a text before it merges; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# A run of so much white space is given to the slower library.
SPACES = 10_000
_SPACES = re.compile(rf"\s{{{SPACES}}}")
# Ends that are compared first in a stretch of one-to-one tokens.
PROBE = 8
# Text of a part: its pairs are numbered together, and held in memory together.
PART_BYTES = 8 << 20
# Text that is given to a tokenizer at once; a longer text goes alone.
BATCH_BYTES = 1 << 20
# Tokens of a text that are Python numbers at once. A group that is longer doubles it.
WINDOW = 1 << 16


@dataclass(frozen=True)
class Tokenizers:
    """The files of a byte-level BPE tokenizer (A) and of a piece model (B)."""

    a: bytes
    b: bytes

    def open(self) -> Pair:
        return _opened(self.a, self.b)


@lru_cache(maxsize=1)
def _opened(a: bytes, b: bytes) -> Pair:
    """Opened once in a worker's life, not once a task: it takes a second and a hundred megabytes."""
    return Pair(a, b)


def read_tokenizers(a: str, b: str) -> Tokenizers:
    """Reads the files on the driver: a few megabytes, which tasks get by broadcast."""
    with open(a, "rb") as x, open(b, "rb") as y:
        return Tokenizers(x.read(), y.read())


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for
    themselves, the others follow from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [n for n in range(256) if n not in set(plain)]
    return {chr(n): n for n in plain} | {chr(256 + k): n for k, n in enumerate(rest)}


class Pair:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a: bytes, b: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_buffer(a)
        self._whole.encode_special_tokens = True
        self._b = SentencePieceProcessor(model_proto=b)
        alphabet = byte_alphabet()
        special = {x["content"] for x in json.loads(a)["added_tokens"]}
        vocabulary = json.loads(a)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, number in vocabulary.items():
            self.bytes_a[number] = b"" if token in special else bytes(alphabet[c] for c in token)
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self._b.is_byte(n) else p.replace("▁", " ").encode()
            for n, p in enumerate(map(self._b.id_to_piece, range(self._b.get_piece_size())))
        ]
        ranks = {x: n for n, x in enumerate(self.bytes_a) if x}
        # With every byte a token, tokens of A always give back the text.
        if any(bytes([n]) not in ranks for n in range(256)):
            raise ValueError("the first tokenizer must have a token for each byte")
        self._quick = Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.heads_a = [f"{n}|" for n in range(len(self.bytes_a))]
        self.names = [str(n) for n in range(max(len(self.bytes_a), len(self.bytes_b)))]

    def encode(self, values: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of both for each text; none where B doesn't give back space + text."""
        for text, b in zip(values, self._b.encode(values, num_threads=1), strict=True):
            spaced = " " + text
            if text and b"".join(map(self.bytes_b.__getitem__, b)) == spaced.encode():
                yield self._first(spaced), b
            else:
                yield [], []

    def _first(self, text: str) -> list[int]:
        # The quick library merges alike and is several times faster, but fails on very long white space.
        if len(text) > SPACES and _SPACES.search(text):
            return self._whole.encode(text, add_special_tokens=False).ids
        return self._quick.encode_ordinary(text)


def _numbers(values: list[int]) -> np.ndarray:
    return np.frombuffer(array("q", values), np.int64)


class Aligner:
    """Groups and links of one text, found from left to right."""

    def __init__(self, pair: Pair, a: list[int], b: list[int]) -> None:
        self.pair, self.n_groups = pair, 0
        self.ids_a, self.ids_b = a, b
        self.a, self.b = _numbers(a), _numbers(b)
        self.ends_a, self.ends_b = np.cumsum(pair.sizes_a[self.a]), np.cumsum(pair.sizes_b[self.b])

    def windows(self, size: int = WINDOW) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Parts of a text in order: groups as text, and the ids of linked tokens of A and of B (in
        any order)."""
        i = j = 0
        while i < len(self.a):
            a, b = self.a[i : i + size], self.b[j : j + size]
            ends = self.ends_a[i : i + size].tolist(), self.ends_b[j : j + size].tolist()
            groups, left, right, ni, nj = self._window(*ends, self.ids_a[i : i + size], self.ids_b[j : j + size])
            if ni == 0:
                size *= 2
                continue
            i, j, self.n_groups = i + ni, j + nj, self.n_groups + len(groups)
            yield groups, a[left], b[right]

    def _window(self, ends_a, ends_b, ids_a, ids_b):
        heads, names = self.pair.heads_a.__getitem__, self.pair.names.__getitem__
        groups: list[str] = []
        # Stretches of one-to-one tokens: where they start in A and B, and their lengths.
        start_a: list[int] = []
        start_b: list[int] = []
        length: list[int] = []
        # Links of the other groups.
        left: list[int] = []
        right: list[int] = []
        n_a, n_b = len(ends_a), len(ends_b)
        i = j = 0
        while i < n_a and j < n_b:
            x, y = ends_a[i], ends_b[j]
            if x == y:
                n = one_to_one(ends_a, ends_b, i, j)
                start_a.append(i)
                start_b.append(j)
                length.append(n)
                p, q = i + n, j + n
                groups.extend(map(add, map(heads, ids_a[i:p]), map(names, ids_b[j:q])))
                i, j = p, q
                continue
            mark, p, q = len(left), i, j
            left.append(p)
            right.append(q)
            try:
                while x != y:
                    if x < y:
                        p += 1
                        x = ends_a[p]
                    else:
                        q += 1
                        y = ends_b[q]
                    left.append(p)
                    right.append(q)
            except IndexError:
                # The group goes on behind the window and is found again in the next.
                del left[mark:], right[mark:]
                break
            if p == i + 1 and q == j:
                groups.append(f"{ids_a[i]},{ids_a[p]}|{ids_b[j]}")
            elif p == i and q == j + 1:
                groups.append(f"{ids_a[i]}|{ids_b[j]},{ids_b[q]}")
            else:
                groups.append(",".join(map(names, ids_a[i : p + 1])) + "|" + ",".join(map(names, ids_b[j : q + 1])))
            i, j = p + 1, q + 1
        n = _numbers(length)
        steps = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        both = (
            np.append(np.repeat(_numbers(s), n) + steps, _numbers(rest))
            for s, rest in ((start_a, left), (start_b, right))
        )
        return groups, *both, i, j


def one_to_one(a: list[int], b: list[int], i: int, j: int) -> int:
    """How many ends from a[i] and b[j] on are equal: the compared lengths double until a part differs,
    then halve; the last PROBE ends are looked at one by one."""
    start, step = i, PROBE
    while (part := a[i : i + step]) and part == b[j : j + step]:
        i, j = i + len(part), j + len(part)
        step *= 2
    while step > PROBE:
        step //= 2
        if (part := a[i : i + step]) and part == b[j : j + step]:
            i, j = i + len(part), j + len(part)
    last = min(len(a), len(b) - j + i)
    while i < last and a[i] == b[j]:
        i, j = i + 1, j + 1
    return i - start


def _batches(values: list[str]) -> Iterator[list[str]]:
    batch, size = [], 0
    for text in values:
        if batch and size + len(text) > BATCH_BYTES:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += len(text)
    if batch:
        yield batch


_ROW = [
    ("part", pa.int64()),
    ("n_a", pa.int64()),
    ("n_b", pa.int64()),
    ("n_groups", pa.int64()),
    ("n_links", pa.int64()),
    ("groups_sha256", pa.string()),
    ("groups", pa.string()),
    # Numbers of the document's pairs within the part, and how many of its links are of each.
    ("places", pa.binary()),
    ("times", pa.binary()),
    # Only in the one row of a part: its pairs, and how many of its documents hold each.
    ("pairs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("held", pa.int64())]))),
]
_ROW_SCHEMA = (
    "part bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, "
    "places binary, times binary, pairs array<struct<a: int, b: int, held: bigint>>"
)


def _align_part(pair: Pair, values: list[str], number: int, with_groups: bool) -> Iterator[dict[str, list]]:
    """The rows of a part's documents, then the row of its pairs."""
    made: dict[str, list] = {name: [] for name, _ in _ROW}
    width = len(pair.bytes_b)
    keys, times = [], []
    # Copies within a part are aligned once.
    same = Numbers()
    of = [same[text] for text in values]
    for batch in _batches(list(same)):
        for a, b in pair.encode(batch):
            aligner, digest, own = Aligner(pair, a, b), hashlib.sha256(), []
            said: list[str] = []
            for groups, left, right in aligner.windows():
                text = ("" if not own else ";") + ";".join(groups)
                digest.update(text.encode())
                if with_groups:
                    said.append(text)
                own.append(left * width + right)
            links = np.concatenate(own) if own else np.zeros(0, np.int64)
            key, count = np.unique(links, return_counts=True)
            keys.append(key)
            times.append(count.astype(np.int32))
            made["n_a"].append(len(a))
            made["n_b"].append(len(b))
            made["n_groups"].append(aligner.n_groups)
            made["n_links"].append(len(links))
            made["groups_sha256"].append(digest.hexdigest() if a else "")
            made["groups"].append("".join(said) if with_groups else None)
    for name in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"):
        made[name] = [made[name][n] for n in of]
    keys, times = [keys[n] for n in of], [times[n] for n in of]
    sizes = [len(k) for k in keys]
    every = np.concatenate(keys)
    distinct, place, held = np.unique(every, return_inverse=True, return_counts=True)
    cuts = np.cumsum(sizes)[:-1]
    made["places"] = [x.tobytes() for x in np.split(place.astype(np.int32), cuts)]
    made["times"] = [x.tobytes() for x in times]
    made["part"] = [number] * len(values)
    made["pairs"] = [None] * len(values)
    yield made
    fields = [pa.array((distinct // width).astype(np.int32)), pa.array((distinct % width).astype(np.int32)), pa.array(held)]
    pairs = pa.StructArray.from_arrays(fields, ["a", "b", "held"])
    yield {name: [None] for name, _ in _ROW} | {
        "part": [number],
        "pairs": pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs),
    }


@dataclass(frozen=True)
class Alignment:
    """`rows`: a staged row per document, by part. `counts` (a, b, documents, best): every linked pair
    of ids, how many documents hold it linked, and whether no other pair of its `a` has more."""

    key: str
    rows: DataFrame
    part_pairs: DataFrame
    counts: DataFrame

    def documents(self) -> DataFrame:
        """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups of each document."""
        # A pair is at most once in a part, so no pair has more than one in some ten thousand rows here.
        counted = self.part_pairs.join(self.counts, ["a", "b"]).select(
            F.col("part").alias("own_part"), "place", "documents", "best"
        )
        kept = [f"`{c}`" for c in ("part", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "places", "times")]
        rows = self.rows.where("pairs IS NULL").select(*kept)
        kind = self.rows.schema["id"].dataType.simpleString()
        schema = (
            f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
            "count_sum bigint, groups_sha256 string, groups string"
        )
        found = rows.groupBy("part").cogroup(counted.groupBy("own_part")).applyInArrow(_summed, schema)
        return found.withColumnRenamed("id", self.key)


def _summed(rows: pa.Table, counted: pa.Table) -> pa.Table:
    """Adds up a part's counts over the links of its documents."""
    size = counted.num_rows
    place = counted["place"].to_numpy()
    documents, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    documents[place] = counted["documents"].to_numpy()
    best[place] = counted["best"].to_numpy(zero_copy_only=False)
    sums = []
    for places, times in zip(rows["places"].to_pylist(), rows["times"].to_pylist(), strict=True):
        at, n = np.frombuffer(places, np.int32), np.frombuffer(times, np.int32).astype(np.int64)
        sums.append((int(n @ best[at]), int(n @ documents[at])))
    made = rows.select(["id", "n_a", "n_b", "n_groups", "n_links"])
    for k, name in enumerate(("n_best", "count_sum")):
        made = made.append_column(name, pa.array([x[k] for x in sums], pa.int64()))
    for name in ("groups_sha256", "groups"):
        made = made.append_column(name, rows[name])
    return made


def align(
    docs: DataFrame, tokenizers: Tokenizers, key: str = "doc_id", text: str = "text", with_groups: bool = True
) -> Alignment:
    """Aligns the tokens of both tokenizers in every text, and counts the linked pairs of ids.

    A encodes a space and the text, B the text, to which it adds a space itself; strings of special
    tokens are plain text. A text that is null or empty, or whose tokens of B don't give back space +
    text byte by byte (those of A do), has no tokens: zeros, and '' as `groups_sha256`. `groups` is text like
    `a1,a2|b1;a3|b2,b3` (null if `with_groups` is off). Rows keep their number, repeated keys count as
    documents of their own, keys may be null, and other columns aren't looked at.
    """
    kind = docs.schema[key].dataType
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = shared.value.open()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in parts(batch, 1, PART_BYTES):
                ids = part.column(0)
                for made in _align_part(pair, texts(part, 1), number, with_groups):
                    own = ids if made["pairs"][0] is None else pa.nulls(1, ids.type)
                    arrays = [own, *(made[n] if isinstance(made[n], pa.Array) else pa.array(made[n], t) for n, t in _ROW)]
                    yield pa.RecordBatch.from_arrays(arrays, ["id", *(n for n, _ in _ROW)])
                number += 1

    source = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = stage(source.mapInArrow(run, f"id {kind.simpleString()}, {_ROW_SCHEMA}"), "aligned")
    listed = rows.where("pairs IS NOT NULL").select("part", F.posexplode("pairs").alias("place", "pair"))
    part_pairs = listed.select("part", "place", "pair.a", "pair.b", "pair.held")
    sums = part_pairs.groupBy("a", "b").agg(F.sum("held").alias("documents"))
    # At most one row per id of B is in a window.
    most = F.max("documents").over(Window.partitionBy("a"))
    counts = stage(sums.withColumn("best", F.col("documents") == most), "pair-counts")
    return Alignment(key, rows, part_pairs.drop("held"), counts)

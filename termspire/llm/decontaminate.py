"""Benchmark decontamination: passages of benchmark items found in documents by an FM-index."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspire.llm.batches import parts, raw_texts
from termspire.llm.fm_index import FMIndex

WINDOW = 10
# Text of one shard, whose words are indexed together.
SHARD_BYTES = 4 << 20
# Benchmark text that the driver and a task hold at once. More of it is searched in further passes.
BLOCK_BYTES = 64 << 20

# A word is a run of bytes outside the ASCII separators; A-Z count as a-z.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass
class Passages:
    """The distinct windows of some benchmark items, as numbers of words."""

    vocabulary: dict[bytes, int]
    windows: dict[int, np.ndarray]  # by length, one row each
    owners: dict[int, list[list[str]]]  # the items of each window
    shortest: int


def passages_of(rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> Passages:
    vocabulary: dict[bytes, int] = {}
    found: dict[int, dict[tuple, set]] = {}
    for item, text in rows:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of((text or "").encode())]
        size = min(window, len(ids))
        for start in range(len(ids) - size + 1 if size else 0):
            owners = found.setdefault(size, {}).setdefault(tuple(ids[start : start + size]), set())
            if item is not None:
                owners.add(item)
    return Passages(
        vocabulary,
        {n: np.array(list(w), np.int64) for n, w in found.items()},
        {n: [sorted(o) for o in w.values()] for n, w in found.items()},
        min(found, default=0),
    )


def search(shard: list[bytes], passages: Passages) -> tuple[list[int], list, list[set[str]]]:
    """For each text its number of words, the words hit (an array of flags or None), and the items.

    Words that no item has cannot be in a passage, so the index holds only the runs of the others
    that are as long as the shortest window; each run ends with a 0.
    """
    get = passages.vocabulary.get
    numbers, counts = [], []
    for text in shard:
        words = words_of(text)
        counts.append(len(words))
        numbers.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
        numbers.append(np.zeros(1, np.int32))
    hits: list = [None] * len(shard)
    items: list[set[str]] = [set() for _ in shard]
    if not passages.windows or not shard:
        return counts, hits, items
    flat = np.concatenate(numbers)
    change = np.flatnonzero(np.diff(np.concatenate(([False], flat > 0, [False])).view(np.int8)))
    starts, ends = change[::2], change[1::2]
    long = ends - starts >= passages.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return counts, hits, items
    cover = np.zeros(len(flat) + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, ends + 1, -1)  # the 0 after the run stays with it
    place = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    index = FMIndex(flat[place], len(passages.vocabulary) + 1)
    document = np.repeat(np.arange(len(shard)), np.array(counts) + 1)
    cover[:] = 0
    for size, windows in passages.windows.items():
        low, high = index.search(windows)
        times = (high - low).clip(0)
        which = np.repeat(np.arange(len(windows)), times)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + low[which]
        at = place[index.locate(rows)]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
        pairs = np.unique(document[at] * len(windows) + which)
        owners = passages.owners[size]
        for text, window in zip((pairs // len(windows)).tolist(), (pairs % len(windows)).tolist(), strict=True):
            items[text].update(owners[window])
    hit = np.cumsum(cover[:-1]) > 0
    first = np.cumsum(np.array(counts) + 1) - np.array(counts) - 1
    for text in np.unique(document[hit]).tolist():
        hits[text] = hit[first[text] : first[text] + counts[text]]
    return counts, hits, items


def removal_spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Merged spans of the words hit, as code points [start, end) of the text."""
    words = [m.span() for m in _WORD.finditer(text.lower())]
    edges = np.diff(np.concatenate(([False], hit, [False])).view(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [
        (int(points[words[s][0]]), int(points[words[e - 1][1]]))
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True)
    ]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    kept, last = [], 0
    for start, end in spans:
        kept.append(text[last:start])
        last = end
    return "".join([*kept, text[last:]])


def blocks_of(benchmark: DataFrame, item: str, text: str, window: int, size: int = BLOCK_BYTES) -> list:
    """The benchmark as broadcasts of passages, each of about `size` bytes of text at most."""
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // size + 1
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    context = benchmark.sparkSession.sparkContext
    return [
        context.broadcast(passages_of([tuple(r) for r in rows.where(block == n).collect()], window))
        for n in range(blocks)
    ]


def _search_blocks(shard: list[bytes], blocks: list) -> tuple[list[int], list, list[set[str]]]:
    counts, hits, items = search(shard, blocks[0].value)
    for block in blocks[1:]:
        _, more_hits, more_items = search(shard, block.value)
        hits = [b if a is None else a if b is None else a | b for a, b in zip(hits, more_hits, strict=True)]
        items = [a | b for a, b in zip(items, more_items, strict=True)]
    return counts, hits, items


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """Where windows of benchmark items occur in documents; one row per document.

    Returns key, `n_words`, `n_hit`, `n_items`, `items_sha256`, `contaminated`, `items` (sorted as
    strings), `spans` (code points to remove, merged). A window is `window` consecutive words of an
    item, or all of a shorter one. A null text has no words; neither have items without words, which
    occur nowhere. Rows keep their number: repeated rows and null keys are judged like others. Items
    with the same id count once, those without an id only mark words. Empty tables give no rows, or
    no hits. Other columns are not looked at. Nothing is shuffled; a shard is a bounded part of a
    task's rows, and the benchmark is broadcast in blocks of bounded size.
    """
    blocks = blocks_of(benchmark, item, item_text, window)

    def run(batches):
        for batch in batches:
            for part in parts(batch, 1, SHARD_BYTES):
                shard = raw_texts(part, 1)
                counts, hits, items = _search_blocks(shard, blocks)
                listed = [sorted(i) for i in items]
                n_hit = [0 if h is None else int(h.sum()) for h in hits]
                spans = [
                    [] if h is None else [{"start": a, "end": b} for a, b in removal_spans(t, h)]
                    for t, h in zip(shard, hits, strict=True)
                ]
                span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(counts, pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array([len(i) for i in listed], pa.int64()),
                        pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in listed]),
                        pa.array([n > 0 for n in n_hit]),
                        pa.array(listed, pa.list_(pa.string())),
                        pa.array(spans, pa.list_(span)),
                    ],
                    names,
                )

    names = "key n_words n_hit n_items items_sha256 contaminated items spans".split()
    schema = (
        f"key {docs.schema[key].dataType.simpleString()}, n_words bigint, n_hit bigint, "
        "n_items bigint, items_sha256 string, contaminated boolean, items array<string>, "
        "spans array<struct<start:int,end:int>>"
    )
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    length: str | None = "n_chars",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """The documents without the spans that `contamination` marks; all columns stay.

    A document of which no word is left after a removal goes; documents without hits are unchanged,
    empty and null texts too. `length`, where the frame has it, becomes the new number of code points.
    """
    blocks = blocks_of(benchmark, item, item_text, window)
    at = docs.columns.index(text)
    sizes = docs.columns.index(length) if length in docs.columns else None

    def run(batches):
        for batch in batches:
            for part in parts(batch, at, SHARD_BYTES):
                shard = raw_texts(part, at)
                counts, hits, _ = _search_blocks(shard, blocks)
                cut = {
                    n: without(shard[n].decode(), removal_spans(shard[n], h))
                    for n, h in enumerate(hits)
                    if h is not None
                }
                columns = list(part.columns)
                values = columns[at].to_pylist()
                for n, left in cut.items():
                    values[n] = left
                columns[at] = pa.array(values, columns[at].type)
                if sizes is not None:
                    numbers = columns[sizes].to_pylist()
                    for n, left in cut.items():
                        numbers[n] = len(left)
                    columns[sizes] = pa.array(numbers, columns[sizes].type)
                keep = [h is None or int(h.sum()) < c for h, c in zip(hits, counts, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)

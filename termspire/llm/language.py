"""Language ID: scripts narrow the candidates, word scores and a switching penalty label spans."""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspire.llm.batches import Numbers, map_parts, parts, texts

BUCKETS = 1 << 15
SIZES = (2, 3, 4)
SWITCH = 8.0
# A language is a candidate for a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.005
UNKNOWN = "und"
# A document is of a language if at least this share of its letters is.
LEAST_SHARE = 0.5
PART_BYTES = 3 << 20

# First code points of script ranges, and the scripts that start there.
SCRIPTS = [
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "devanagari"),
    (0x0980, "bengali"),
    (0x0A00, "indic"),
    (0x0E00, "thai"),
    (0x0E80, "southeast"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "ethiopic"),
    (0x13A0, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "latin"),
    (0x2C00, "other"),
    (0x3040, "kana"),
    (0x3100, "han"),
    (0x3130, "hangul"),
    (0x3190, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD800, "other"),
    (0xF900, "han"),
    (0xFB00, "latin"),
    (0xFB13, "other"),
    (0x20000, "han"),
    (0x32000, "other"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_CODES = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def letters_of(word: str) -> str:
    """The letters of a word with the marks on them, in lower case; empty if it has no letter."""
    if word.isalpha():
        return word.lower()
    if not any(map(str.isalpha, word)):
        return ""
    return "".join(c for c in word if c.isalpha() or unicodedata.combining(c)).lower()


def script_of(letters: str) -> int:
    """The script of most letters; of several as frequent, the first in the word."""
    if letters.isascii() or max(letters) < _SECOND:
        return _LATIN
    codes = _CODES[np.searchsorted(_STARTS, [ord(c) for c in letters], "right") - 1].tolist()
    return Counter(codes).most_common(1)[0][0]


_LATIN = _NAMES.index("latin")
_SECOND = chr(SCRIPTS[1][0])


def grams_of(letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of each word and of its character n-grams, its borders marked."""
    joined = "".join([f"<{w}>" for w in letters]).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(joined, np.uint32)
    sizes = np.fromiter(map(len, letters), np.int64, len(letters)) + 2
    word = np.repeat(np.arange(len(letters), dtype=np.int32), sizes)
    whole = [zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in letters]
    words, buckets = [np.arange(len(letters), dtype=np.int32)], [np.array(whole, np.int32)]
    value = points
    for size in range(2, max(SIZES) + 1):
        value = value[:-1] * np.uint32(0x01000193) ^ points[size - 1 :]
        inside = word[: len(value)] == word[size - 1 :]
        if size in SIZES:
            mixed = (value[inside] + np.uint32(size)) * np.uint32(0x9E3779B1)
            words.append(word[: len(value)][inside])
            buckets.append((mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32))
    return np.concatenate(words), np.concatenate(buckets)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # log probability by bucket and language
    scripts: np.ndarray  # by script and language: whether it is a candidate


def count_grams(
    docs: DataFrame, language: str = "lang", text: str = "text"
) -> DataFrame:
    """(language, kind, bucket, n): counts of n-gram buckets and of letters by script.

    Every text with a language counts, null and empty ones with nothing. A task adds up a part of
    its rows first; there are at most BUCKETS rows per language from a part.
    """

    def run(part: pa.RecordBatch) -> dict:
        words: dict[str, Counter] = {}
        for name, value in zip(part.column(0).to_pylist(), texts(part, 1), strict=True):
            words.setdefault(name, Counter()).update(value.split())
        made: list[list] = [[], [], [], []]
        for name, counts in words.items():
            spelled = [(x, n) for x, n in zip(map(letters_of, counts), counts.values(), strict=True) if x]
            scripts: Counter = Counter()
            for letters, n in spelled:
                scripts[script_of(letters)] += n * len(letters)
            word, bucket = grams_of([x for x, _ in spelled])
            times = np.array([n for _, n in spelled], np.float64)
            total = np.bincount(bucket, times[word], minlength=BUCKETS)
            held = np.flatnonzero(total)
            made[0] += [name] * (len(held) + len(scripts))
            made[1] += ["gram"] * len(held) + ["script"] * len(scripts)
            made[2] += held.tolist() + list(scripts)
            made[3] += total[held].astype(np.int64).tolist() + list(scripts.values())
        kinds = {"language": pa.string(), "kind": pa.string(), "bucket": pa.int32(), "n": pa.int64()}
        return {n: pa.array(m, kind) for (n, kind), m in zip(kinds.items(), made, strict=True)}

    labelled = docs.where(F.col(f"`{language}`").isNotNull())
    schema = "language string, kind string, bucket int, n bigint"
    found = map_parts(labelled, {"language": language, "text": text}, run, schema, PART_BYTES)
    return found.groupBy("language", "kind", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, language: str = "lang", text: str = "text") -> Model:
    """Naive Bayes over hashed n-grams, with counts over all labelled documents.

    The driver gets BUCKETS counts per language at most; the number of languages is that of a list
    of languages, not of the documents. Without any labelled letter there are no languages.
    """
    rows = count_grams(docs, language, text).collect()
    languages = sorted({r.language for r in rows})
    counts = np.zeros((BUCKETS, len(languages)))
    scripts = np.zeros((len(_NAMES), len(languages)))
    for r in rows:
        (counts if r.kind == "gram" else scripts)[r.bucket, languages.index(r.language)] += r.n
    scores = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS))
    share = scripts / scripts.sum(0).clip(1)
    return Model(languages, scores.astype(np.float32), share >= SCRIPT_SHARE)


def word_scores(words: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each word its log probability by language, and its letters; words without are neutral.

    A language that the word's script rules out gets a score below all others, unless the script
    belongs to none of the languages: then the word says nothing.
    """
    scores = np.zeros((len(words), len(model.languages)), np.float32)
    letters = list(map(letters_of, words))
    weights = np.fromiter(map(len, letters), np.int64, len(words))
    rows = np.flatnonzero(weights)
    spelled = [x for x in letters if x]
    if spelled and model.languages:
        word, bucket = grams_of(spelled)
        sizes = np.bincount(word, minlength=len(spelled))
        # The mean over the n-grams, times a root of their number: those that overlap repeat much.
        own = np.stack(
            [np.bincount(word, model.scores[bucket, n], len(spelled)) for n in range(len(model.languages))], 1
        ) / np.sqrt(sizes)[:, None]
        allowed = model.scripts[[script_of(x) for x in spelled]]
        own = np.where(allowed, own, own.min(1, keepdims=True) - 4 * SWITCH)
        scores[rows] = np.where(allowed.any(1, keepdims=True), own, 0)
    return scores, weights


def label_words(lengths: np.ndarray, scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best path of languages through the words of each text, a change costing `switch`.

    All texts advance together, one word at a time, the longest first, so that those still running
    are a prefix. `scores` holds the words of the texts one after the other.
    """
    languages = scores.shape[1]
    labels = np.zeros(len(scores), np.int16)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts with a word at each step
    stays = np.zeros((len(scores), languages), bool)
    leaders = np.zeros(len(scores), np.int16)
    path = np.zeros((len(sizes), languages), np.float32)
    for step in range(longest):
        n = running[step]
        at = starts[:n] + step
        if step:
            best = path[:n].argmax(1)
            jump = path[np.arange(n), best][:, None] - switch
            stays[at] = path[:n] >= jump
            leaders[at] = best
            path[:n] = np.maximum(path[:n], jump)
        path[:n] += scores[at]
        path[:n] -= path[:n].max(1, keepdims=True)
    state = path.argmax(1)
    for step in range(longest - 1, -1, -1):
        n = running[step]
        at = starts[:n] + step
        labels[at] = state[:n]
        if step:
            state[:n] = np.where(stays[at, state[:n]], state[:n], leaders[at])
    return labels


def label_texts(batch: list[str], model: Model, switch: float = SWITCH) -> list[tuple]:
    """For each text its language, the share of its letters in it, and spans (first, end, language)."""
    if not model.languages:
        return [(UNKNOWN, 0.0, []) for _ in batch]
    number = Numbers()
    numbers = [np.fromiter(map(number.__getitem__, t.split()), np.int32) for t in batch]
    lengths = np.array([len(n) for n in numbers], np.int64)
    words = np.concatenate([*numbers, np.zeros(0, np.int32)])
    scores, weights = word_scores(list(number), model)
    labels = label_words(lengths, scores[words], switch)
    made, end = [], 0
    for size in lengths.tolist():
        start, end = end, end + size
        own, weight = labels[start:end], weights[words[start:end]]
        shares = np.bincount(own, weight, minlength=len(model.languages))
        if not shares.any():
            made.append((UNKNOWN, 0.0, []))
            continue
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), size]
        spans = [
            {"first": a, "end": b, "lang": model.languages[own[a]]}
            for a, b in zip(cuts, cuts[1:], strict=False)
        ]
        top = int(shares.argmax())
        made.append((model.languages[top], float(shares[top] / shares.sum()), spans))
    return made


def identify(
    docs: DataFrame,
    model: Model,
    key: str = "doc_id",
    text: str = "text",
    switch: float = SWITCH,
) -> DataFrame:
    """The language of every whole text, and the spans of mixed texts; one row per document.

    Returns key, `lang_pred`, `score` (share of the letters that are in spans of that language) and
    `spans` (white-space words [first, end) and their language). A null text, or one without a
    letter, is `und` with 0.0 and no spans; so is every text if nothing was learned. Of languages
    with as many letters the first by name wins. Repeated rows and null keys stay; no other column
    is looked at. No row is shuffled, and the broadcast model has BUCKETS numbers per language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> dict:
        made = label_texts(texts(part, 1), shared.value, switch)
        span = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
        return {
            "key": part.column(0),
            "lang_pred": [m[0] for m in made],
            "score": pa.array([m[1] for m in made], pa.float64()),
            "spans": pa.array([m[2] for m in made], pa.list_(span)),
        }

    schema = (
        f"key {docs.schema[key].dataType.simpleString()}, lang_pred string, score double, "
        "spans array<struct<first:int,end:int,lang:string>>"
    )
    made = map_parts(docs, {"key": key, "text": text}, run, schema, PART_BYTES)
    return made.withColumnRenamed("key", key)


def keep_identified(
    docs: DataFrame,
    model: Model,
    text: str = "text",
    lang: str = "lang",
    languages: list[str] | None = None,
    least: float = LEAST_SHARE,
) -> DataFrame:
    """The documents in one of some languages (default: all that were learned), with all their columns.

    A document goes if its text has no letter, if the language of most of its letters is not among
    `languages`, or if less than `least` of its letters are in spans of it: too mixed to be of a
    language. A null `lang` becomes the language that was found; others stay as they are. With no
    language learned nothing tells languages apart, and only texts without a letter go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, own = docs.columns.index(text), docs.columns.index(lang)
    wanted = frozenset(model.languages if languages is None else languages)

    def run(batches):
        for batch in batches:
            for part in parts(batch, at, PART_BYTES):
                values = texts(part, at)
                if shared.value.languages:
                    made = label_texts(values, shared.value)
                    kept = pa.array([m[0] in wanted and m[1] >= least for m in made])
                    found = pa.array([m[0] for m in made], part.schema.field(own).type)
                    part = part.set_column(own, part.schema.field(own), pc.coalesce(part.column(own), found))
                else:
                    kept = pa.array([any(map(str.isalpha, v)) for v in values])
                yield part.filter(kept)

    return docs.mapInArrow(run, docs.schema)

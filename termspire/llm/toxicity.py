"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text becomes the set of its hashed words, pairs of neighbours, and pairs with one word between.
Training reads a bounded sample of labelled documents in a fixed order; L1 leaves few weights, which
are broadcast. Scoring looks each feature up in the weights and never shuffles a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspire.llm.batches import Numbers, map_parts, texts
from termspire.plans.staging import stage

# Features are numbers of this many bits, so weights take 12 MB at most, whatever the data.
BITS = 20
# Documents that are learned from, at most: those whose ids have the smallest hashes. One task reads
# their features one after another, EPOCHS times; nothing else depends on the bound.
SAMPLE = 12_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 0.1
# A toxic text counts as so many others, since texts of that label are few.
TOXIC_WEIGHT = 4.0

# Text of which a task holds all features at once.
PART_BYTES = 4 << 20

_WORD = re.compile(r"\w+")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@dataclass(frozen=True)
class Weights:
    """The features with a weight, ascending, their weights, and the bias (None: nothing was learned)."""

    features: np.ndarray
    values: np.ndarray
    bias: float | None

    def table(self) -> np.ndarray:
        full = np.zeros(1 << BITS)
        full[self.features] = self.values
        return full


def hashed(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each word, pair and skip-gram of some texts, with repeats."""
    words, numbers, sizes = Numbers(), [], np.zeros(len(values), np.int64)
    for row, text in enumerate(values):
        found = [words[w] for w in _WORD.findall(text.lower())]
        sizes[row] = len(found)
        numbers.append(np.array(found, np.int32))
    row = np.repeat(np.arange(len(values), dtype=np.int32), sizes)
    if not len(row):
        return row, np.zeros(0, np.int32)
    own = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    word = own[np.concatenate(numbers)]
    rows, features = [row], [word * _MULTIPLIERS[0]]
    for gap in (1, 2):
        inside = row[gap:] == row[:-gap]
        pair = (word[:-gap] * _MULTIPLIERS[gap]) ^ (word[gap:] >> np.uint64(7))
        rows.append(row[gap:][inside])
        features.append(pair[inside] * _MULTIPLIERS[0])
    return np.concatenate(rows), (np.concatenate(features) >> np.uint64(64 - BITS)).astype(np.int32)


def once_each(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs without repeats, by row and feature."""
    both = np.unique((row.astype(np.int64) << BITS) | feature)
    return both >> BITS, (both & ((1 << BITS) - 1)).astype(np.int32)


class Proximal:
    """The state of FTRL-proximal: a learning rate for each coordinate and lazily shrunk weights.

    The bias is the last coordinate and isn't shrunk.
    """

    def __init__(self) -> None:
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)
        self.l1 = np.full((1 << BITS) + 1, L1)
        self.l1[-1] = 0.0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n, l1 = self.z[at], self.n[at], self.l1[at]
        shrunk = np.sign(z) * l1 - z
        return np.where(np.abs(z) > l1, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, 1 << BITS)
        weights = self.weights(at)
        gradient = (sigmoid(weights.sum()) - label) * (TOXIC_WEIGHT if label else 1.0)
        n = self.n[at]
        grown = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * weights
        self.n[at] = grown


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500.0, 500.0)))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model, seen = Proximal(), 0
    for batch in batches:
        for label, features in zip(batch["label"].to_pylist(), batch["features"], strict=True):
            model.learn(np.frombuffer(features.as_buffer(), np.int32), label)
            seen += 1
    if seen:
        weights = model.weights(slice(None))
        kept = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(weights[kept])], ["feature", "weight"])


def _features(part: pa.RecordBatch) -> dict:
    row, feature = once_each(*hashed(texts(part, 2)))
    ends = np.searchsorted(row, np.arange(part.num_rows + 1))
    found = [feature[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
    return {"id": part.column(0), "label": part.column(1), "features": pa.array(found, pa.binary())}


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = SAMPLE,
) -> Weights:
    """Weights learned from at most `sample` labelled documents, the same however tables are split.

    Labels other than 0 and 1, labels or documents without key, and labels of unknown documents are
    not learned from. A key with several labels counts as 1 if one of them is; of several documents
    with one key the one with the smallest feature list is learned from.
    """
    known = labels.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    # Labels without a document are sorted out before the sample is taken, by ids alone.
    ids = docs.select(F.col(f"`{key}`").cast("string").alias("id")).distinct()
    place = F.xxhash64("id")
    chosen = stage(known.join(ids, "id", "left_semi").orderBy(place, "id").limit(sample), "labelled")
    rows = docs.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))
    # At most `sample` rows of an id and a number.
    labelled = rows.join(F.broadcast(chosen), "id")
    found = map_parts(labelled, {"id": "id", "label": "label", "text": "text"}, _features, "id string, label int, features binary", PART_BYTES)
    found = found.groupBy("id", "label").agg(F.min("features").alias("features"))
    found = stage(found, "labelled-features")
    epochs = found.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))))
    ordered = epochs.coalesce(1).sortWithinPartitions("epoch", F.xxhash64("id"), "id")
    learned = ordered.select("label", "features").mapInArrow(_learn, "feature bigint, weight double").toArrow()
    at = learned["feature"].to_numpy()
    weights = learned["weight"].to_numpy()
    if not found.head(1):
        return Weights(np.zeros(0, np.int64), np.zeros(0), None)
    bias = weights[at == 1 << BITS]
    inner = at < 1 << BITS
    return Weights(at[inner], weights[inner], float(bias[0]) if len(bias) else 0.0)


def scores(values: list[str], table: np.ndarray, bias: float | None) -> np.ndarray:
    if bias is None:
        return np.zeros(len(values))
    row, feature = hashed(values)
    kept = table[feature] != 0
    row, feature = once_each(row[kept], feature[kept])
    return sigmoid(bias + np.bincount(row, table[feature], len(values)))


def score(docs: DataFrame, weights: Weights, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, `score` (0 to 1, higher: likelier toxic) and `predicted` (1 from 0.5 on) of each document.

    The whole text counts, each feature once. A null or empty text has the score of the bias; weights
    learned from nothing give 0 to all. Rows keep their number; other columns are not looked at.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    held: dict[str, np.ndarray] = {}

    def judge(part: pa.RecordBatch) -> dict:
        if "table" not in held:
            held["table"] = shared.value.table()
        found = scores(texts(part, 1), held["table"], shared.value.bias)
        return {"id": part.column(0), "score": found, "predicted": (found >= 0.5).astype(np.int32)}

    made = map_parts(docs, {"id": key, "text": text}, judge, f"id {kind}, score double, predicted int", PART_BYTES)
    return made.withColumnRenamed("id", key)

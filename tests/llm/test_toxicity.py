import zlib
from math import exp

import numpy as np
import pytest
from awkward import documents, empty

from termspire.llm import registered, toxicity

SF = "/root/testdata/sf0.1"


def fold(key):
    return zlib.crc32(str(key).encode()) % 5


def plain_features(text):
    """Every word, pair and skip-gram of one text, hashed one at a time."""
    words = toxicity._WORD.findall(text.lower())
    singles = [(w,) for w in words]
    pairs = [(a, b, 1) for a, b in zip(words, words[1:])]
    skips = [(a, b, 2) for a, b in zip(words, words[2:])]
    mask = (1 << 64) - 1
    odd = [int(x) for x in toxicity._MULTIPLIERS]

    def own(word):
        return toxicity.xxhash.xxh64_intdigest(word.encode())

    features = {(own(w) * odd[0] & mask) >> (64 - toxicity.BITS) for (w,) in singles}
    for a, b, gap in pairs + skips:
        mixed = (own(a) * odd[gap] & mask) ^ (own(b) >> 7)
        features.add((mixed * odd[0] & mask) >> (64 - toxicity.BITS))
    return features


def test_features_agree_with_one_at_a_time():
    values = ["a b c d", "", "One two, ONE two one", "x", "x y", "漢字 ñandú é_é 12 a", "a a a a"]
    row, feature = toxicity.once_each(*toxicity.hashed(values))
    for n, text in enumerate(values):
        assert set(feature[row == n].tolist()) == plain_features(text)


def test_the_state_follows_the_published_update():
    rng = np.random.default_rng(3)
    model = toxicity.Proximal()
    z, n = {}, {}

    def weight(i):
        l1 = 0.0 if i == 1 << toxicity.BITS else toxicity.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * l1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(300):
        features = np.unique(rng.integers(0, 30, 8)).astype(np.int32)
        label = int(3 in features)
        model.learn(features, label)
        at = [*features.tolist(), 1 << toxicity.BITS]
        weights = [weight(i) for i in at]
        gradient = 1 / (1 + exp(-sum(weights))) - label
        gradient *= toxicity.TOXIC_WEIGHT if label else 1
        for i, w in zip(at, weights):
            before = n.get(i, 0.0)
            n[i] = before + gradient**2
            z[i] = z.get(i, 0.0) + gradient - (n[i] ** 0.5 - before**0.5) / toxicity.ALPHA * w
    for i in [*range(30), 1 << toxicity.BITS]:
        assert model.weights(np.array([i]))[0] == pytest.approx(weight(i), abs=1e-9)
    assert weight(3) > 0


def test_held_out_documents(spark):
    found = registered.op13_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert all(fold(r.doc_id) == 0 and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    toxic = sorted(r.score for r in rows if r.toxic)
    clean = sorted(r.score for r in rows if not r.toxic)
    above = sum(np.searchsorted(clean, s) for s in toxic) / len(toxic) / len(clean)
    assert above > 0.95
    assert sum(s >= 0.5 for s in clean) / len(clean) < 0.01
    assert sum(s >= 0.5 for s in toxic) / len(toxic) > 0.7
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_weights_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 2000")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    one = toxicity.train(docs.coalesce(1), labels.coalesce(1), sample=500)
    many = toxicity.train(docs.repartition(13), labels.repartition(7), sample=500)
    assert one.bias == many.bias and len(one.values) < 5000
    assert np.array_equal(one.features, many.features) and np.array_equal(one.values, many.values)


def test_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (6, 0), (7, None), (None, 1), (2, 0), (3, 1), (5, 7), (99, 1)], "doc_id bigint, toxic int"
    )
    weights = toxicity.train(docs, labels)
    assert weights.bias is not None
    found = toxicity.score(docs, weights)
    assert found.columns == ["doc_id", "score", "predicted"]
    rows = found.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    bias = toxicity.sigmoid(weights.bias)
    assert {r.score for r in rows if r.doc_id in (2, 3, 4)} == {bias}
    assert len({r.score for r in rows if r.doc_id == 6}) == 1


def test_nothing_to_learn_from_and_nothing_to_score(spark):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    weights = toxicity.train(documents(spark), labels)
    assert weights.bias is None
    assert {(r.score, r.predicted) for r in toxicity.score(documents(spark), weights).collect()} == {(0.0, 0)}
    assert toxicity.train(empty(spark), labels).bias is None
    assert toxicity.score(empty(spark), weights).count() == 0


def test_one_key_with_many_copies_is_learned_from_once(spark):
    docs = documents(spark, [(1, "bad words here")] * 500 + [(2, "good words here")])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    single = documents(spark, [(1, "bad words here"), (2, "good words here")])
    assert toxicity.train(docs, labels).bias == toxicity.train(single, labels).bias

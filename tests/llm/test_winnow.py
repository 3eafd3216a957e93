import hashlib
import random

import pytest
from awkward import ROWS, documents, empty

from termspire.llm import winnow

M = winnow.PRIME


def picks_of(units):
    """Places and hashes of the fingerprint, window by window."""
    values = [int(hashlib.md5(u.encode()).hexdigest()[:8], 16) % M for u in units]
    grams = []
    for start in range(max(len(values) - winnow.GRAM + 1, min(len(values), 1))):
        value = 0
        for unit in values[start : start + winnow.GRAM]:
            value = (value * winnow.BASE + unit) % M
        grams.append(value)
    found = []
    for start in range(max(len(grams) - winnow.WINDOW + 1, min(len(grams), 1))):
        window = grams[start : start + winnow.WINDOW]
        place = start + max(n for n, g in enumerate(window) if g == min(window))
        if not found or found[-1][0] != place:
            found.append((place, grams[place]))
    return found


def picks(text):
    """The fingerprint by words, long ones cut, and that by code points of a short text."""
    words = "".join(" " if c in "\t\n\v\f\r" else c for c in text.lower()).split(" ")
    words = [w for w in words if w]
    units = [u for w in words for u in (w if len(w) > winnow.LONG else [w])]
    return picks_of(units), picks_of("".join(words)) if len(text) < winnow.SHORT else []


def brute(rows):
    mark = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, mark(r[1])), reverse=True)
    made = []
    for n, (key, text) in enumerate(order):
        text, after = text or "", order[(n + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, changed, other = (picks(t) for t in (text, edited, after))

        def near(a, b):
            a, b = ({h for kind in x for _, h in kind} for x in (a, b))
            return len(a & b) / len(a | b) if a | b else 1.0

        def as_text(found):
            listed = [",".join(f"{place}:{h}" for place, h in kind) for kind in found]
            return ";".join(listed if listed[1] else listed[:1])

        digest = hashlib.sha256(edited.encode()).hexdigest()
        made.append((key, len(text), digest, as_text(own), as_text(changed), near(own, changed), near(own, other)))
    return made


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted(map(tuple, winnow.fingerprints(docs).collect()), key=order)
    assert got == sorted(brute(rows), key=order)


def test_awkward_rows(spark):
    order = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted(map(tuple, winnow.fingerprints(documents(spark)).collect()), key=order)
    assert got == sorted(brute(ROWS), key=order)
    assert winnow.fingerprints(empty(spark)).count() == 0


@pytest.mark.parametrize("spread", ["dense", "sparse", "one", "wide", "hot"])
def test_successors_across_buckets(spark, monkeypatch, spread):
    monkeypatch.setattr(winnow, "BUCKET_ROWS", 3)
    monkeypatch.setattr(winnow, "BUCKETS_PER_GROUP", 2)
    rng = random.Random(1)
    monkeypatch.setattr(winnow, "RANGES", 4)
    wide = [0, 2**62, 2**63 - 1, -(2**63), *range(100, 130), 10**15]
    hot = [7] * 25 + [None] * 15 + [1, 2, 3, 8, 9, 10]
    keys = {"wide": wide, "hot": hot, "dense": range(60), "sparse": rng.sample(range(-(10**12), 10**12), 40) + [5, 6, 7], "one": [3]}[spread]
    check(spark, [(k, " ".join(rng.choices("abcdefg", k=rng.randint(0, 25)))) for k in keys])


def test_shared_runs_leave_a_common_hash():
    rng = random.Random(7)
    for _ in range(300):
        run = [f"r{rng.randrange(10**6)}" for _ in range(winnow.GRAM + winnow.WINDOW - 1)]
        texts = [" ".join(rng.choices("abcd", k=9) + run + rng.choices("efgh", k=9)) for _ in range(2)]
        first, second = ({h for _, h in picks(t)[0]} for t in texts)
        assert first & second


@pytest.mark.parametrize("odd", [[10**15], [0, 2**62, 2**63 - 1], [-(2**63)] + [None] * 3000, [5000] * 3000])
def test_no_bucket_holds_much_of_the_rows(spark, odd):
    rows = [(k, f"text {n}") for n, k in enumerate([*range(10_000), *odd])]
    placed = winnow.in_buckets(spark.createDataFrame(rows, "id bigint, text string"))
    sizes = [r["count"] for r in placed.groupBy("bucket").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 4 * winnow.BUCKET_ROWS
    # Buckets rise with ids.
    ends = placed.where("id IS NOT NULL").groupBy("bucket").agg({"id": "min"}).orderBy("bucket").collect()
    assert [r[1] for r in ends] == sorted(r[1] for r in ends)


def test_two_thirds_of_a_text_leave_a_mark(spark):
    rng = random.Random(9)
    pools = ["abcdefghij", "漢字仮名交文章", "xyz "]
    rows = [(n, "".join(rng.choices(pools[n % 3], k=rng.randint(21, 2000 if n % 2 else 120)))) for n in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert all(r.near_edited > 0 for r in winnow.fingerprints(docs).collect())


def test_given_texts_leave_a_mark(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    low = winnow.fingerprints(docs).where("n_chars > 20 AND near_edited = 0")
    assert low.count() == 0

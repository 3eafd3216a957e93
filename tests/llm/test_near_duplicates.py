import random

import numpy as np
import pytest
from awkward import ROWS, documents, empty

from termspire.llm import near_duplicates as nd
from termspire.llm.components import components


def shingles(text):
    words = [w for w in (text or "").translate(str.maketrans({c: " " for c in "\t\n\v\f\r"})).split(" ") if w]
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    return {tuple(words[n : n + 5]) for n in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    """(key, size, component) per row, links found by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    least = {}
    for n, (key, _) in enumerate(rows):
        if key is not None:
            least[root(n)] = min(key, least.get(root(n), key))
    return [(key, len(sets[n]), least.get(root(n), key)) for n, (key, _) in enumerate(rows)]


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in nd.near_duplicates(docs).collect()]
    order = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=order) == sorted(brute(rows), key=order)


def variants(rng, words, n, edits):
    """Near copies of a text: some words replaced by words that no other text has."""
    made = []
    for _ in range(n):
        own = list(words)
        for place in rng.sample(range(len(own)), rng.randint(*edits)):
            own[place] = f"w{rng.randrange(10**9)}"
        made.append(" ".join(own))
    return made


def test_sets_and_links_are_exact():
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(120)]
    sets = nd.shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    similar = nd.linked(sets)
    for a, first in enumerate(texts):
        for b, second in enumerate(texts[:a]):
            x, y = shingles(first), shingles(second)
            assert similar[a, b] == (100 * len(x & y) >= 75 * len(x | y))


def test_groups_of_all_kinds(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)
    rng = random.Random(2)
    base = [f"b{n}" for n in range(120)]
    other = [f"c{n}" for n in range(60)]
    shared = " ".join(f"p{n}" for n in range(30))
    texts = variants(rng, base, 90, (1, 6)) + variants(rng, other, 12, (0, 2))
    texts += [f"{shared} {' '.join(f'x{k}y{n}' for n in range(rng.randint(0, 30)))}" for k in range(25)]
    texts += [" ".join(base)] * 20 + [" ".join(other).upper()] * 3 + ["a b", "A  b", "a b c", ""]
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_a_link_at_the_threshold_counts(spark):
    words = [f"t{n}" for n in range(104)]  # 100 shingles
    exact = " ".join(words[:79])  # 75 of them
    below = " ".join(words[:78])
    check(spark, [(5, " ".join(words)), (9, exact)])
    check(spark, [(5, " ".join(words)), (9, below)])


def test_awkward_rows(spark):
    rows = nd.near_duplicates(documents(spark)).collect()
    order = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in rows], key=order)
    assert got == sorted(brute(ROWS), key=order)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert nd.near_duplicates(empty(spark)).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    rng = np.random.default_rng(3)
    edges = [(n, n + 1) for n in range(100, 160)] + [(500, n) for n in range(501, 600)] + [(7, 7), (8, 7)]
    edges += [(int(a), int(b)) for a, b in rng.integers(1000, 1060, (40, 2))]
    frame = spark.createDataFrame(edges + edges[:5] + [(None, 3)], "a bigint, b bigint")
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = [(r.node, r.component) for r in components(frame, "a", "b").collect()]
    assert sorted(got) == sorted((n, root(n)) for n in linked)


def meet(a, b):
    """Whether two sets share a table entry: a key of each collection."""
    keys = nd.slots([np.sort(a), np.sort(b)])
    same = keys[0] == keys[1]
    return same[: nd.KEYS].any() and same[nd.KEYS :].any()


def pair(rng, similarity, size=400):
    union = rng.integers(0, 1 << 63, size, np.uint64)
    common = round(similarity * size)
    rest = (size - common) // 2
    return union[: common + rest], np.append(union[:common], union[common + rest :])


@pytest.mark.parametrize(("similarity", "least", "most"), [(0.75, 0.99, 1), (0.8, 0.995, 1), (0.3, 0, 0.3), (0.2, 0, 0.06)])
def test_pairs_meet_by_their_similarity(similarity, least, most):
    rng = np.random.default_rng(12)
    share = np.mean([meet(*pair(rng, similarity)) for _ in range(400)])
    assert least <= share <= most


def test_a_chain_of_weak_neighbours_stays_in_small_groups(spark):
    """Neighbours are about 0.4 alike and no link; candidates that reach on through them stay few."""
    width, step = 700, 300
    texts = [" ".join(f"w{n}" for n in range(k * step, k * step + width)) for k in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = nd.signatures(docs, "doc_id", "text")
    groups = nd.candidate_groups(rows.select("id", "slots"))
    sizes = [r["count"] for r in groups.groupBy("component").count().collect()]
    assert max(sizes, default=1) <= 40
    assert nd.near_duplicates(docs).where("NOT kept").count() == 0

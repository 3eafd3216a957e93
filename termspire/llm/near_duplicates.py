"""Near duplicates by word shingles: tensored MinHash tables, checked on full sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspire.llm.batches import Numbers, map_parts, raw_texts
from termspire.llm.components import components
from termspire.plans.skew import frequent_keys, spread_join
from termspire.plans.staging import is_small, stage

SHINGLE = 5
SIMILARITY = 75  # per cent
# Two collections of so many keys, each key of so many minhashes; a table is a pair of keys, one of
# each, so 120 minhashes serve 400 tables of six minhashes. At a similarity of 0.75 a pair is in none of
# them with probability 2 * (1 - 0.75 ** 3) ** 20 = 3.5e-5; at 0.3 it is in one with 0.18, at 0.2 with 0.02.
KEYS = 20
HASHES = 3
# Documents whose sets are compared with one another in one task at a time.
BLOCK = 256
COLUMNS = 4096
PART_BYTES = 4 << 20

_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\x09\x0a\x0b\x0c\x0d\x20" else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_rng = np.random.default_rng(20_240_229)
_FACTORS = _rng.integers(0, 1 << 63, 2 * KEYS * HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, 2 * KEYS * HASHES, np.uint64)
_SALTS = _rng.integers(0, 1 << 63, 2 * KEYS, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(batch: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles of `size` words.

    Words are cut at ASCII white space, A-Z count as a-z. A text of fewer words has one shingle, all
    of them; a text without words has none.
    """
    number = Numbers()
    numbers = []
    for text in batch:
        words = text.translate(_TABLE).split()
        numbers.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
    del number
    sets = []
    for own in numbers:
        n = len(own)
        if n < size:
            whole = xxhash.xxh64_intdigest(hashes[own].tobytes(), n)
            sets.append(np.array([whole] if n else [], np.uint64))
            continue
        words = hashes[own]
        value = np.zeros(n - size + 1, np.uint64)
        for at in range(size):
            value = value * _ODD + words[at : n - size + 1 + at]
        value = np.sort(_mix(value))
        sets.append(value[np.concatenate(([True], value[1:] != value[:-1]))])
    return sets


def slots(sets: list[np.ndarray]) -> np.ndarray:
    """The keys of both collections for sets that are not empty, one row for each set."""
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    made = []
    for k, salt in enumerate(_SALTS):
        key = np.full(len(sets), salt)
        for n in range(k * HASHES, (k + 1) * HASHES):
            key = _mix(key ^ np.minimum.reduceat(flat * _FACTORS[n] + _SHIFTS[n], starts))
        made.append(key)
    return np.stack(made, 1).view(np.int64)


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n_shingles, same, slots): `same` is equal for equal sets, null for an empty one."""

    def run(part: pa.RecordBatch) -> dict:
        sets = shingle_sets(raw_texts(part, 1))
        full = [s for s in sets if len(s)]
        rows = iter(slots(full).tolist() if full else [])
        return {
            "id": part.column(0),
            "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "same": pa.array(
                [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                pa.binary(),
            ),
            "slots": pa.array([next(rows) if len(s) else None for s in sets], pa.list_(pa.int64())),
        }

    schema = "id bigint, n_shingles bigint, same binary, slots array<bigint>"
    return map_parts(docs, {"id": key, "text": text}, run, schema, PART_BYTES)


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(node, component): classes that share a table entry, directly or through others.

    An entry is shared only if its halves are, so halves that stand alone go first: of a document
    without near duplicates hardly anything is left to pair.
    """
    halves = classes.select("id", F.posexplode("slots").alias("at", "value"))
    shared = halves.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value")
    mine = halves.join(shared, "value").groupBy("id").agg(
        F.collect_list(F.when(F.col("at") < KEYS, F.col("value"))).alias("left"),
        F.collect_list(F.when(F.col("at") >= KEYS, F.col("value"))).alias("right"),
    )
    entries = stage(
        mine.select("id", "right", F.explode("left").alias("one"))
        .select("id", "one", F.explode("right").alias("other"))
        .select("id", F.xxhash64("one", "other").alias("entry")),
        "entries",
    )
    leaders = entries.groupBy("entry").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n"))
    edges = entries.join(leaders.where("n > 1").drop("n"), "entry").where("id != leader")
    return components(edges.select("id", "leader").distinct(), "id", "leader")


def linked(sets: list[np.ndarray], similarity: int = SIMILARITY) -> np.ndarray:
    """Which pairs of sets are similar enough, counted on the full sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate(([True], flat[1:] != flat[:-1]))
    number = np.cumsum(fresh) - 1
    several = (np.bincount(number) > 1)[number]
    column = np.cumsum(fresh & several)[several] - 1
    owner = owner[several]
    common = np.zeros((len(sets), len(sets)), np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        table = np.zeros((len(sets), COLUMNS), np.float32)
        table[owner[a:b], column[a:b] - first] = 1
        common += table @ table.T
    common = np.rint(common).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    return 100 * common >= similarity * union


def forest(ids: np.ndarray, similar: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links connect: (smallest id, id) within each component."""
    left, edges = np.ones(len(ids), bool), []
    for start in np.argsort(ids, kind="stable"):
        if not left[start]:
            continue
        reached = np.zeros(len(ids), bool)
        wave = np.array([start])
        while len(wave):
            reached[wave] = True
            wave = np.flatnonzero(similar[wave].any(0) & ~reached)
        left &= ~reached
        edges += [(int(ids[start]), int(ids[n])) for n in np.flatnonzero(reached) if n != start]
    return edges


def links(members: DataFrame) -> DataFrame:
    """(a, b): links that connect the similar members of each group.

    `members` has node, component and text. A group of over BLOCK members is cut into blocks, and
    each pair of blocks is compared in a task of its own; small groups share a task. No task gets
    more than two blocks, and only connecting links come out of it.
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bins = total // BLOCK + 1
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    plan = sizes.select("component", parts.alias("parts"))
    plan = F.broadcast(plan) if is_small(plan) else plan
    block = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    placed = members.join(plan, "component").withColumn("block", block)

    def sets_of(part: pa.RecordBatch) -> dict:
        found = shingle_sets(raw_texts(part, 4))
        columns = dict(zip(("component", "parts", "block", "node"), part.columns, strict=False))
        return columns | {"set": pa.array([s.tobytes() for s in found], pa.binary())}

    columns = {c: c for c in ("component", "parts", "block", "node", "text")}
    schema = "component bigint, parts int, block int, node bigint, set binary"
    sets = map_parts(placed, columns, sets_of, schema, PART_BYTES).withColumn("other", other)
    unit = [
        F.when(F.col("parts") == 1, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")),
        F.when(F.col("parts") == 1, F.lit(-1)).otherwise(F.least("block", "other")),
        F.when(F.col("parts") == 1, F.lit(-1)).otherwise(F.greatest("block", "other")),
    ]
    units = sets.select("component", "node", "set", *[c.alias(n) for c, n in zip(unit, "xyz", strict=True)])

    def compare(table: pa.Table) -> pa.Table:
        groups = table.column("component").to_numpy()
        ids = table.column("node").to_numpy()
        values = table.column("set").to_pylist()
        edges: list[tuple[int, int]] = []
        order = np.argsort(groups, kind="stable")
        cuts = np.flatnonzero(np.diff(groups[order])) + 1
        for rows in np.split(order, cuts):
            if len(rows) > 1:
                similar = linked([np.frombuffer(values[r], np.uint64) for r in rows])
                edges += forest(ids[rows], similar)
        arrays = [pa.array([e[n] for e in edges], pa.int64()) for n in (0, 1)]
        return pa.table(arrays, ["a", "b"])

    return units.groupBy("x", "y", "z").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of near duplicates; one row per document.

    Returns key, `n_shingles`, `component_id`, `kept`. Documents are linked if the sets of their
    distinct shingles of SHINGLE words have a similarity of SIMILARITY per cent or more; a component
    is what links connect, and its smallest key is kept. A null or empty text, or one of white space
    only, has no shingle and no link. Equal sets are one class from the start, so copies cost one
    row each. A document without key is in a component but never its name, and is kept if the
    component has no other. Rows keep their number; documents with one key are one node. Other
    columns are not looked at; the key must be an integer.
    """
    rows = stage(signatures(docs, key, text), "signatures")
    full = rows.where(F.col("same").isNotNull())
    classes = stage(
        full.groupBy("same").agg(
            F.min("id").alias("id"), F.first("slots").alias("slots"), F.count(F.lit(1)).alias("copies")
        ),
        "classes",
    )
    grouped = candidate_groups(classes.where(F.col("id").isNotNull()))
    grouped = stage(grouped, "groups")
    members = F.broadcast(grouped) if is_small(grouped) else grouped
    named = docs.select(F.col(f"`{key}`").cast("bigint").alias("node"), F.col(f"`{text}`").alias("text"))
    edges = stage(links(named.join(members, "node")), "edges")
    found = components(edges, "a", "b")
    classes = classes.join(found, classes["id"] == found["node"], "left").select(
        "same", "copies", F.coalesce("component", "id").alias("component")
    )
    frequent = frequent_keys(classes, "same", "copies", full.count())
    placed = spread_join(full, classes.drop("copies"), "same", frequent, ["id"])
    result = placed.select("id", "n_shingles", "component").union(
        rows.where(F.col("same").isNull()).select("id", "n_shingles", F.col("id").alias("component"))
    )
    return result.select(
        F.col("id").cast(docs.schema[key].dataType).alias(key),
        "n_shingles",
        F.col("component").cast(docs.schema[key].dataType).alias("component_id"),
        (F.col("id").eqNullSafe(F.col("component"))).alias("kept"),
    )

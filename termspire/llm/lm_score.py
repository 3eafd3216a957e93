"""LM scoring: a log-bilinear model trained by noise-contrastive estimation, and smoothed counts."""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termspire.llm.batches import parts, raw_texts
from termspire.plans.staging import stage

# Words whose counts and vectors every task holds; the counts of others are joined.
FREQUENT = 200_000
# First outputs of the model: the most frequent words, and classes of the others by their last two bytes.
# Inside a class a tree tells its frequent words apart.
WORDS = 512
TAILS = 128
SIZE = 16
CONTEXT = 2
NOISE = 32
BATCH = 2048
RATE = 0.2
# Where the squares of AdaGrad start for rows of frequent words and nodes, which few tokens change.
SQUARE = 1.0
SEED = 20_240_229
# Tokens of the sample that the model starts from, and of each shard of all training rows, about.
TRAIN_TOKENS = 8_000_000
PART_BYTES = 4 << 20
FLUSH = 300_000
# Numbers of words whose pairs are normalised once for all texts of a task.
PAIRS = 2048
# Rows of a group that are added up one after the other.
FEW = 8
# Rows of parameters that a task returns together.
ROWS = 1024

END = b"\n"  # no word holds white space
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\x09\x0a\x0b\x0c\x0d\x20" else b for b in range(256))


def tokens_of(text: bytes) -> list[bytes]:
    words = text.translate(_TABLE).split()
    words.append(END)
    return words


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


def words_of(batch: list[bytes]) -> pa.LargeBinaryArray:
    """The tokens of all texts, as `tokens_of` gives them, one text after the other."""
    data = b" \n ".join([*(text.translate(_TABLE) for text in batch), b""])
    letters = np.frombuffer(data, np.uint8)
    gaps = letters == 32
    sizes = np.diff(np.flatnonzero(gaps), prepend=-1) - 1
    ends = np.cumsum(np.concatenate(([0], sizes[sizes > 0])))
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(letters[~gaps])])


def word_bytes(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends, and the bytes of all."""
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1]
    return ends, np.frombuffer(data or b"", np.uint8)


@cache
def _tails() -> tuple[np.ndarray, np.ndarray]:
    """The classes of words of one byte, and of words by their last two."""
    one = [tail_of(bytes((b,))) for b in range(256)]
    return np.array(one, np.int32), np.array([tail_of(bytes((a, b))) for a in range(256) for b in range(256)], np.int32)


def tails_of(words: pa.LargeBinaryArray) -> np.ndarray:
    """`tail_of` each word."""
    (ends, data), (one, two) = word_bytes(words), _tails()
    last = data.take(ends[1:] - 1).astype(np.int32)
    # Before a word of one byte may be nothing at all.
    return np.where(np.diff(ends) > 1, two.take((data.take(ends[1:] - 2, mode="wrap").astype(np.int32) << 8) | last), one.take(last))


@dataclass
class Counts:
    """What the training tokens say: frequent words with their counts, and totals of all."""

    frequent: dict[bytes, int]  # by falling count
    tokens: int
    distinct: int
    tail_tokens: np.ndarray  # of the words outside the model's own, by class
    tail_distinct: np.ndarray

    def base(self) -> float:
        return math.log10(self.tokens + 0.5 * (self.distinct + 1))


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, tail, n): counts over all texts, added up in each task before the shuffle."""

    def run(batches):
        counts = None

        def rows():
            words = counts["word"].combine_chunks()
            made = [words.cast(pa.binary()), pa.array(tails_of(words)), counts["n"].combine_chunks()]
            return pa.RecordBatch.from_arrays(made, ["word", "tail", "n"])

        for batch in batches:
            for part in parts(batch, 0, PART_BYTES):
                found = pa.table(words_of(raw_texts(part, 0)).value_counts().flatten(), ["word", "n"])
                if counts is not None:
                    both = pa.concat_tables([counts, found]).group_by("word", use_threads=False)
                    found = both.aggregate([("n", "sum")]).rename_columns(["word", "n"])
                counts = found
                if len(counts) > FLUSH:
                    yield rows()
                    counts = None
        if counts is not None:
            yield rows()

    found = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "word binary, tail int, n bigint")
    return found.groupBy("word", "tail").agg(F.sum("n").alias("n"))


def collect_counts(counts: DataFrame, frequent: int = FREQUENT) -> Counts:
    """The frequent words and the totals: at most `frequent` + TAILS rows reach the driver.

    A histogram of counts on a log scale, of bounded size, tells from which count on words are few
    enough. If even the rarest are, all words are frequent.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, room = 0, frequent
    for row in sorted(steps, key=lambda r: -r.step):
        room -= row.words
        if room < 0:
            least = row.step + 1
            break
    table = counts.where(step >= least).select("word", "n").toArrow()
    rows = sorted(zip(table["n"].to_pylist(), table["word"].to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
    known = {word: n for n, word in rows}
    tokens, distinct = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for row in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        tokens[row.tail], distinct[row.tail] = row.n, row.words
    made = Counts(known, int(tokens.sum()), int(distinct.sum()), tokens, distinct)
    for word in list(known)[:WORDS]:
        made.tail_tokens[tail_of(word)] -= known[word]
        made.tail_distinct[tail_of(word)] -= 1
    return made


OUTPUTS = WORDS + TAILS
START = OUTPUTS  # stands before the first word


class Classes(dict):
    """The model's number of a word: its own if it is frequent, or that of the rest of its class."""

    def __init__(self, counts: Counts):
        words = list(counts.frequent)
        super().__init__(zip(words[:WORDS], range(WORDS), strict=False))
        self.update(zip(words[WORDS:], range(START + 1, START + 1 + len(words)), strict=False))

    def __missing__(self, word: bytes) -> int:
        return WORDS + tail_of(word)

    @cached_property
    def listed(self) -> pa.LargeBinaryArray:
        return pa.array(self, pa.large_binary())

    def numbers(self, words: pa.LargeBinaryArray) -> np.ndarray:
        """The model's number of each word."""
        place = pc.index_in(words, self.listed)
        rare = np.flatnonzero(place.is_null().to_numpy(False))
        found = place.fill_null(0).to_numpy().copy()
        found[found >= WORDS] += START + 1 - WORDS
        found[rare] = WORDS + tails_of(words.take(pa.array(rare)))
        return found


def rest_of(counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each class that are not frequent."""
    tokens, distinct = counts.tail_tokens.copy(), counts.tail_distinct.copy()
    for word in list(counts.frequent)[WORDS:]:
        tokens[tail_of(word)] -= counts.frequent[word]
        distinct[tail_of(word)] -= 1
    return tokens, distinct


@dataclass
class Tree:
    """By number: the first output, and the way to the word inside its class, empty for an output alone.

    The leaves of a class are its frequent words and the rest of it, in a Huffman tree, so a way is
    about as long as the word is rare and the probabilities of a class add up to one.
    """

    output: np.ndarray
    up: np.ndarray  # of a number, then of a node: twice the node above, and 1 for its second side; -1 at the top
    odds: np.ndarray  # of each node, by the counts
    rest: np.ndarray  # by number: the logarithm of the smoothed tokens of a class's rest, else 0

    def __post_init__(self) -> None:
        at, found = self.up[: len(self.output)].copy(), []
        while (at >= 0).any():
            found.append(at)
            at = np.where(at >= 0, self.up[len(self.output) + (at >> 1)], -1)
        steps = np.stack(found, 1) if found else np.empty((len(self.output), 0), np.int32)
        self.size = (steps >= 0).sum(1).astype(np.int16)
        self.first = (np.cumsum(self.size, dtype=np.int64) - self.size).astype(np.int32)
        self.steps = steps[steps >= 0]

    def __reduce__(self) -> tuple:
        return Tree, (self.output, self.up, self.odds, self.rest)  # ways are longer than what they follow from

    def falling(self, numbers: np.ndarray) -> np.ndarray:
        """Places of the words, the one with the longest way first."""
        return np.argsort(-self.size.take(numbers), kind="stable")

    def levels(self, numbers: np.ndarray) -> tuple[list[tuple[int, slice]], np.ndarray, np.ndarray]:
        """The nodes and sides of the first steps of all words, whose ways get no longer, then of their
        second ones and so on; and how many words have each step, with its part of these arrays.
        """
        sizes = self.size.take(numbers)
        many = np.searchsorted(-sizes, -np.arange(sizes.max(initial=0), dtype=np.int16)).tolist()
        ends, first = np.cumsum(many).tolist(), self.first.take(numbers)
        at = [self.steps.take(first[:n] + level) for level, n in enumerate(many)]
        up = np.concatenate(at) if at else np.empty(0, np.int32)
        return [(n, slice(end - n, end)) for n, end in zip(many, ends, strict=True)], up >> 1, (up & 1).astype(np.float32)


def new_tree(counts: Counts) -> Tree:
    words = list(counts.frequent)[WORDS:]
    output = np.concatenate((np.arange(START + 1), [WORDS + tail_of(w) for w in words])).astype(np.int32)
    tokens, distinct = rest_of(counts)
    members: list[list] = [[(float(n) + 0.5, WORDS + c)] for c, n in enumerate(tokens.tolist())]
    for number, word in enumerate(words, START + 1):
        members[output[number] - WORDS].append((counts.frequent[word] + 0.5, number))
    up = np.full(len(output) + len(words), -1, np.int32)
    odds: list[float] = []
    for heap in members:
        heapq.heapify(heap)
        while len(heap) > 1:
            (none, left), (one, right) = heapq.heappop(heap), heapq.heappop(heap)
            up[left], up[right] = 2 * len(odds), 2 * len(odds) + 1
            heapq.heappush(heap, (none + one, len(output) + len(odds)))
            odds.append(math.log(one / none))
    rest = np.zeros(len(output))
    rest[WORDS:OUTPUTS] = np.log10(tokens + 0.5 * (distinct + 1))
    return Tree(output, up, np.array(odds, np.float32), rest)


@dataclass
class Model:
    """Score of an output: its bias, and its vector times the sum of the weighted context vectors.

    The context vector of a frequent word is that of its class and its own difference from it. A node
    inside a class goes to side 1 with the logistic function of its bias and such a product.
    """

    context: np.ndarray  # OUTPUTS + 1 vectors
    weight: np.ndarray  # one vector per context position
    output: np.ndarray  # OUTPUTS vectors
    bias: np.ndarray
    words: np.ndarray  # a difference per frequent word outside the first outputs, after one of zeros
    inner: np.ndarray  # a vector and a bias per node
    tree: Tree

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.weight, self.output, self.bias]

    def vectors(self, numbers: np.ndarray) -> np.ndarray:
        return self.context.take(self.tree.output.take(numbers), 0) + self.words.take(np.maximum(numbers - START, 0), 0)

    def predicted(self, histories: np.ndarray) -> np.ndarray:
        return sum(self.weight[p] * self.vectors(histories[:, p]) for p in range(CONTEXT))

    def inside(self, ahead: np.ndarray, levels: list[tuple[int, slice]], inner: np.ndarray) -> np.ndarray:
        """Scores of the nodes of all levels, `ahead` being predictions with a one after them."""
        return np.concatenate([np.einsum("ij,ij->i", inner[rows], ahead[:n]) for n, rows in levels])

    def __reduce__(self) -> tuple:
        inner = self.inner.copy()
        inner[:, SIZE] -= self.tree.odds
        return read_model, (self.arrays(), self.words.astype(np.float16), inner.astype(np.float16), self.tree)

    def rows(self) -> list[np.ndarray]:
        """All parameters as rows of SIZE + 1 values, `words` and `inner` last."""
        wide = lambda a: np.hstack((a, np.zeros((len(a), 1), np.float32)))
        output = np.hstack((self.output, self.bias[:, None]))
        return [wide(self.context), wide(self.weight), output, wide(self.words), self.inner]


def read_model(arrays: list[np.ndarray], words: np.ndarray, inner: np.ndarray, tree: Tree) -> Model:
    """A model that was sent: rows of words and nodes go in half precision."""
    inner = inner.astype(np.float32)
    inner[:, SIZE] += tree.odds
    return Model(*arrays, words.astype(np.float32), inner, tree)


def log_unigrams(counts: Counts) -> np.ndarray:
    """Log probabilities of the outputs without context."""
    n = np.zeros(OUTPUTS)
    own = list(counts.frequent.values())[:WORDS]
    n[: len(own)] = own
    n[WORDS:] = counts.tail_tokens
    return np.log((n + 0.5) / (n + 0.5).sum()).astype(np.float32)


def new_model(counts: Counts) -> Model:
    return start_model(new_tree(counts), log_unigrams(counts))


def start_model(tree: Tree, unigrams: np.ndarray) -> Model:
    """Inside classes the model starts from the shares of the counts."""
    rng = np.random.default_rng(SEED)
    vectors = lambda n: rng.normal(0, 0.1, (n, SIZE)).astype(np.float32)
    inner = np.zeros((len(tree.odds), SIZE + 1), np.float32)
    inner[:, SIZE] = tree.odds
    return Model(
        vectors(OUTPUTS + 1),
        np.ones((CONTEXT, SIZE), np.float32),
        vectors(OUTPUTS),
        unigrams.copy(),
        np.zeros((len(tree.output) - START, SIZE), np.float32),
        inner,
        tree,
    )


def numbered(batch: list[bytes], classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.LargeBinaryArray]:
    """The numbers of all tokens, their histories, the number of tokens of each text, and the tokens."""
    words = words_of(batch)
    ends, data = word_bytes(words)
    sizes = np.diff(np.flatnonzero(data.take(ends[:-1]) == END[0]), prepend=-1)
    numbers, first = classes.numbers(words), np.cumsum(sizes) - sizes
    histories = np.full((len(numbers), CONTEXT), START, np.int32)
    for p in range(CONTEXT):
        histories[p + 1 :, p] = numbers[: max(len(numbers) - p - 1, 0)]
        for q in range(p + 1):
            histories[first[sizes > q] + q, p] = START
    return numbers, histories, sizes, words


def logistic(score: np.ndarray) -> np.ndarray:
    """The logistic function, in the array that is given."""
    np.clip(score, -30, 30, out=score)
    np.negative(score, out=score)
    np.exp(score, out=score)
    score += 1
    return np.reciprocal(score, out=score)


def add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add each row to the row of `total` that it belongs to."""
    at = at.astype(np.intp)
    for cells, column in zip(total.T, np.ascontiguousarray(rows.T, np.float64), strict=True):
        cells += np.bincount(at, column, len(total))


def put_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Put rows in places of `total`, each as one item, which is faster than cell by cell."""
    kind = np.dtype((np.void, total.itemsize * total.shape[1]))
    total.view(kind)[:, 0][at] = np.ascontiguousarray(rows, total.dtype).view(kind)[:, 0]


def sum_groups(rows: np.ndarray, sizes: np.ndarray, first: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Sums of the rows in `order` from each place of `first` on, as many as `sizes`, which fall.

    Most groups are small: they are added up place by place, all that are long enough at once.
    """
    total = rows.take(order.take(first), 0)
    for k in range(1, min(FEW, sizes.max(initial=0))):
        left = first[: np.searchsorted(-sizes, -k)]
        total[: len(left)] += rows.take(order.take(left + k), 0)
    left = np.searchsorted(-sizes, -FEW)
    if left:
        more = sizes[:left] - FEW
        start = np.cumsum(more) - more
        at = np.repeat(first[:left] + FEW - start, more) + np.arange(more.sum())
        total[:left] += np.add.reduceat(rows.take(order.take(at), 0), start, axis=0)
    return total


class Trainer:
    """Steps of noise-contrastive estimation with rates that fall by AdaGrad.

    A batch shares its noise, drawn from the unigrams, so a step is a few matrix products: each token
    is told from NOISE others, and the scores tend to log probabilities. Inside a class each node on
    the way to the word is a decision of its own, and only the rows that a batch has are changed.
    """

    def __init__(self, model: Model, noise: np.ndarray, seed: int):
        self.model, self.rng = model, np.random.default_rng(seed)
        self.noise = noise + np.float32(math.log(NOISE))
        self.draw = np.cumsum(np.exp(noise.astype(np.float64)))
        self.squares = [np.full_like(a, 1e-3) for a in model.arrays()]
        # One square for each row.
        self.sparse = [(a, np.full(len(a), SQUARE, np.float32)) for a in (model.words, model.inner)]

    def step(self, words: np.ndarray, histories: np.ndarray) -> None:
        model, output = self.model, self.model.tree.output
        order = model.tree.falling(words)
        numbers, histories = words.take(order), histories.take(order, 0)
        words = output.take(numbers)
        others = np.searchsorted(self.draw, self.rng.random(NOISE) * self.draw[-1]).clip(max=OUTPUTS - 1)
        vectors = [model.vectors(histories[:, p]) for p in range(CONTEXT)]
        ones = np.ones((len(words), SIZE + 1), np.float32)
        predicted = ones[:, :SIZE]
        predicted[:] = sum(model.weight[p] * vectors[p] for p in range(CONTEXT))
        outputs = model.output.take(words, 0)
        score = np.einsum("ij,ij->i", predicted, outputs) + model.bias.take(words)
        miss = logistic(self.noise.take(words) - score)
        false = predicted @ model.output[others].T
        false += model.bias[others] - self.noise[others]
        false = logistic(false)
        steps = [np.zeros_like(a) for a in model.arrays()]
        change = np.empty((len(words) + NOISE, SIZE + 1), np.float32)
        np.multiply(ones, miss[:, None], out=change[: len(words)])
        np.negative(false.T @ ones, out=change[len(words) :])
        sums = np.zeros((OUTPUTS, SIZE + 1), np.float32)
        add_rows(sums, np.concatenate((words, others)), change)
        steps[2][:], steps[3][:] = sums[:, :SIZE], sums[:, SIZE]
        back = miss[:, None] * outputs
        back -= false @ model.output[others]
        levels, nodes, sides = model.tree.levels(numbers)
        if levels:
            inner = model.inner.take(nodes, 0)
            wrong = (sides - logistic(model.inside(ones, levels, inner)))[:, None]
            inner *= wrong
            for n, rows in levels:
                back[:n] += inner[rows, :SIZE]
                np.multiply(ones[:n], wrong[rows], out=inner[rows])
            self.change(1, nodes, inner)
        changes = np.concatenate([back * model.weight[p] for p in range(CONTEXT)])
        at = histories.T.ravel()
        for p in range(CONTEXT):
            steps[1][p] = np.einsum("ij,ij->j", back, vectors[p])
        add_rows(steps[0], output.take(at), changes)
        frequent = np.flatnonzero(at > START)
        if len(frequent):
            self.change(0, at.take(frequent) - START, changes.take(frequent, 0))
        for array, change, square in zip(model.arrays(), steps, self.squares, strict=True):
            change /= len(words)
            square += change * change
            array += RATE * change / np.sqrt(square)

    def change(self, which: int, at: np.ndarray, rows: np.ndarray) -> None:
        array, square = self.sparse[which]
        bits = len(at).bit_length()
        order = np.sort((at.astype(np.int64) << bits) | np.arange(len(at)))
        at = order >> bits
        order &= (1 << bits) - 1
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        sizes = np.concatenate((first[1:], [len(at)])) - first
        falling = np.argsort(-sizes.astype(np.int16), kind="stable")
        sizes, first = sizes.take(falling), first.take(falling)
        change, ids = sum_groups(rows, sizes, first, order), at.take(first)
        squares = square.take(ids) + np.einsum("ij,ij->i", change, change) / change.shape[1]
        square[ids] = squares
        change *= (RATE / np.sqrt(squares))[:, None]
        change += array.take(ids, 0)
        put_rows(array, ids, change)

    def learn(self, batches: Iterator[pa.RecordBatch], classes: Classes) -> None:
        """Steps over the first column's texts, part by part."""
        for batch in batches:
            for part in parts(batch, 0, PART_BYTES):
                words, histories, _, _ = numbered(raw_texts(part, 0), classes)
                order = self.rng.permutation(len(words))
                for at in range(0, len(order), BATCH):
                    rows = order[at : at + BATCH]
                    self.step(words[rows], histories[rows])

    def rows(self) -> list[np.ndarray]:
        """The model's rows, each with its square if it has one, and the squares of the first arrays."""
        context, weight, output, words, inner = self.model.rows()
        squares = Model(*self.squares, self.model.words, self.model.inner, self.model.tree).rows()[:3]
        plain = lambda a: np.hstack((a, np.zeros((len(a), 1), np.float32)))
        own = [np.hstack((a, square[:, None])) for a, (_, square) in zip((words, inner), self.sparse, strict=True)]
        return [plain(a) for a in (context, weight, output, *squares)] + own

    def put(self, whole: np.ndarray) -> None:
        """Take over what `rows` returned, as one array."""
        sizes = [OUTPUTS + 1, CONTEXT, OUTPUTS] * 2 + [len(self.model.words)]
        *dense, words, inner = np.split(whole, np.cumsum(sizes))
        for arrays, made in ((self.model.arrays(), dense[:3]), (self.squares, dense[3:])):
            for array, new in zip(arrays, (*(a[:, :SIZE] for a in made), made[2][:, SIZE]), strict=True):
                array[:] = new
        for (array, square), new in zip(self.sparse, (words, inner), strict=True):
            array[:], square[:] = new[:, : array.shape[1]], new[:, SIZE + 1]


def sample_texts(docs: DataFrame, text: str, counts: Counts, tokens: int = TRAIN_TOKENS) -> DataFrame:
    """(text) that the model starts from: distinct texts of about `tokens` tokens, by their hashes.

    Which texts these are doesn't depend on ids, nor on how the table is split. A text that occurs
    often is one text, so copies don't crowd out the others; `train` then goes through all rows.
    """
    steps = 1 << 20
    share = steps if counts.tokens <= tokens else steps * tokens // counts.tokens
    source = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    chosen = source.where(F.pmod(F.xxhash64("text"), F.lit(steps)) < share)
    return stage(chosen.distinct(), "trained-on")


def changed_rows(before: np.ndarray, after: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(base, met, values): the rows that differ, ROWS at a time."""
    for base in range(0, len(after), ROWS):
        met = np.flatnonzero((after[base : base + ROWS] != before[base : base + ROWS]).any(1))
        if len(met):
            row = [base], [met.astype(np.int16).tobytes()], [after[base + met].tobytes()]
            made = [pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(made, ["base", "met", "values"])


def mean_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one base, each the mean of the shards that changed it."""
    total, shards = np.zeros((ROWS, SIZE + 2)), np.zeros(ROWS)
    for batch in batches:
        bases = batch.column(0)
        for met, values in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            at = np.frombuffer(met, np.int16)
            total[at] += np.frombuffer(values, np.float32).reshape(-1, SIZE + 2)
            shards[at] += 1
    met = np.flatnonzero(shards)
    values = (total[met] / shards[met, None]).astype(np.float32)
    made = [bases[:1], pa.array([met.astype(np.int16).tobytes()]), pa.array([values.tobytes()])]
    yield pa.RecordBatch.from_arrays(made, ["base", "met", "values"])


def train(docs: DataFrame, text: str, counts: Counts, tokens: int = TRAIN_TOKENS, key: str = "doc_id") -> Model:
    """The model, learned from all rows.

    It starts from a sample of about `tokens` tokens, which one task goes through in the order of the
    texts' hashes. All rows, copies and those of the sample too, are then dealt by hashes of key and
    text to shards of about `tokens` tokens. A task goes through each shard from that start, and each
    row of parameters becomes its mean over the shards that changed it. So the result is the same
    however the table is split, and no task grows with the table.
    """
    spark = docs.sparkSession
    trainer = Trainer(new_model(counts), log_unigrams(counts), SEED)
    whole = np.concatenate(trainer.rows())
    common = spark.sparkContext.broadcast((trainer.model.tree, log_unigrams(counts), Classes(counts)))
    sample = sample_texts(docs, text, counts, tokens).select("text", F.lit(0).alias("shard"), F.xxhash64("text").alias("hash"))
    count = max(1, -(-counts.tokens // tokens))
    number = F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))
    every = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), number.alias("hash"))
    every = every.select("text", F.pmod("hash", F.lit(count)).cast("int").alias("shard"), "hash")
    for given in (sample.coalesce(1), every.repartitionById(count, "shard")):
        before = spark.sparkContext.broadcast(whole)

        def run(batches, before=before):
            tree, noise, classes = common.value
            for first in batches:
                learned = Trainer(start_model(tree, noise), noise, SEED + first.column(1)[0].as_py())
                learned.put(before.value)
                learned.learn(chain([first], batches), classes)
                yield from changed_rows(before.value, np.concatenate(learned.rows()))

        ordered = given.sortWithinPartitions("hash", "text").select("text", "shard")
        found = ordered.mapInArrow(run, "base int, met binary, values binary").groupBy("base").applyInArrow(
            mean_rows, "base int, met binary, values binary"
        ).toArrow()
        before.destroy()
        whole = whole.copy()
        for base, met, values in zip(*(c.to_pylist() for c in found.columns), strict=True):
            at = base + np.frombuffer(met, np.int16).astype(np.int64)
            whole[at] = np.frombuffer(values, np.float32).reshape(-1, SIZE + 2)
    common.destroy()
    trainer.put(whole)
    return trainer.model


def distinct_histories(histories: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All distinct histories, their predictions, and which of them each history has."""
    key = histories[:, 0].astype(np.int64)
    for p in range(1, CONTEXT):
        key = key * len(model.tree.output) + histories[:, p]
    bits = len(key).bit_length()
    if len(model.tree.output) ** CONTEXT >= 1 << (63 - bits):
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        return histories[first], model.predicted(histories[first]).astype(np.float32), which
    # Sorted together with their places, in one word each, which is faster than an index sort.
    order = np.sort((key << bits) | np.arange(len(key)))
    key = order >> bits
    order &= (1 << bits) - 1
    new = np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    histories = histories.take(order[new], 0)
    return histories, model.predicted(histories).astype(np.float32), which


def pair_norms(model: Model) -> np.ndarray:
    """`log_norms` of all histories of two numbers below PAIRS.

    What two words add to a score is added, so the exponentials of each are taken once, and the sums over
    outputs are one matrix product. It is not a number where all of them are too small for that.
    """
    vectors = model.vectors(np.arange(min(PAIRS, len(model.tree.output))))
    one, other = ((vectors * model.weight[p]) @ model.output.T + (1 - p) * model.bias for p in range(2))
    tops = one.max(1, keepdims=True), other.max(1, keepdims=True)
    sums = np.exp(one - tops[0]) @ np.exp(other - tops[1]).T
    sums[sums < 1e-25] = np.nan
    np.log(sums, out=sums)
    sums += tops[0]
    sums += tops[1].T
    return sums


def known_norms(histories: np.ndarray, pairs: np.ndarray | None) -> np.ndarray:
    """The norms of histories that `pairs` has, else not a number."""
    norms = np.full(len(histories), np.nan, np.float32)
    if pairs is not None:
        at = np.flatnonzero(histories.max(1, initial=0) < len(pairs))
        norms[at] = pairs[histories[at, 0], histories[at, 1]]
    return norms


def log_norms(predicted: np.ndarray, model: Model) -> np.ndarray:
    """The logarithms of the sums over all outputs."""
    norms = np.empty(len(predicted), np.float32)
    longest = np.sqrt(np.einsum("ij,ij->i", model.output, model.output)).max(initial=0)
    highest, ones = model.bias.max(initial=0), np.ones(len(model.bias), np.float32)
    output = np.vstack((model.output.T, model.bias))
    ahead, room = np.ones((256, SIZE + 1), np.float32), np.empty((256, len(model.bias)), np.float32)
    for at in range(0, len(predicted), 256):
        some = predicted[at : at + 256]
        ahead[: len(some), :SIZE] = some
        scores = np.matmul(ahead[: len(some)], output, out=room[: len(some)])
        # No score is above this; only one that could overflow is taken off.
        top = np.sqrt(np.einsum("ij,ij->i", some, some)) * longest + highest
        top[top < 60] = 0
        high = np.flatnonzero(top)
        if len(high):
            top[high] = scores[high].max(1)
            scores[high] -= top[high, None]
        norms[at : at + 256] = np.log(np.exp(scores, out=scores) @ ones) + top
    return norms


def log_outputs(words: np.ndarray, predicted: np.ndarray, which: np.ndarray, model: Model, norms: np.ndarray) -> np.ndarray:
    """Natural log probabilities of outputs; `norms` of predictions that are not yet known are worked out."""
    left = np.flatnonzero(np.isnan(norms))
    norms[left] = log_norms(predicted.take(left, 0), model)
    score = np.empty(len(words), np.float64)
    for at in range(0, len(words), 1 << 13):
        rows = slice(at, at + (1 << 13))
        score[rows] = np.einsum("ij,ij->i", predicted.take(which[rows], 0), model.output.take(words[rows], 0))
    return score + model.bias.take(words) - norms.take(which)


def log_probabilities(words: np.ndarray, histories: np.ndarray, model: Model) -> np.ndarray:
    """Normalised natural log probabilities of outputs after their histories.

    The sum over all outputs is computed once for each distinct history, in batches of matrix products.
    """
    histories, predicted, which = distinct_histories(histories, model)
    return log_outputs(words, predicted, which, model, known_norms(histories, None))


def log_words(numbers: np.ndarray, histories: np.ndarray, model: Model, pairs: np.ndarray | None = None) -> np.ndarray:
    """Natural log probabilities of words by number: of the output, then of the way inside the class."""
    histories, predicted, which = distinct_histories(histories, model)
    logs = log_outputs(model.tree.output.take(numbers), predicted, which, model, known_norms(histories, pairs))
    ahead = np.ones((1 << 12, SIZE + 1), np.float32)
    for at in range(0, len(numbers), 1 << 12):
        order = at + model.tree.falling(numbers[at : at + (1 << 12)])
        levels, nodes, sides = model.tree.levels(numbers.take(order))
        if levels:
            ahead[: len(order), :SIZE] = predicted.take(which.take(order), 0)
            taken = model.inside(ahead, levels, model.inner.take(nodes, 0))
            taken *= 1 - 2 * sides
            taken = np.log1p(np.exp(np.clip(taken, -80, 80, out=taken), out=taken), out=taken)
            total = np.zeros(len(order))
            for n, rows in levels:
                total[:n] += taken[rows]
            logs[order] -= total
    return logs


class Scorer:
    """Scores of texts, as far as the frequent words go, and the words that are left to join."""

    def __init__(self, counts: Counts, model: Model):
        self.model, self.classes = model, Classes(counts)
        # By number: what a frequent word adds to the base, and whether it is one.
        self.log, self.known = np.zeros(len(model.tree.output)), np.zeros(len(model.tree.output), bool)
        numbers = np.fromiter(self.classes.values(), np.int64, len(self.classes))
        self.log[numbers] = np.log10(np.fromiter(counts.frequent.values(), np.int64, len(numbers)) + 0.5)
        self.known[numbers] = True
        self.pairs: np.ndarray | None = None

    def score(self, batch: list[bytes]) -> list[pa.Array]:
        """Tokens, known ones, base, model and the other words with their counts, of each text."""
        words, histories, sizes, listed = numbered(batch, self.classes)
        if self.pairs is None and len(words) > PAIRS:
            self.pairs = pair_norms(self.model)
        logs = log_words(words, histories, self.model, self.pairs) / math.log(10) - self.model.tree.rest.take(words)
        text, known = np.repeat(np.arange(len(batch)), sizes), self.known.take(words)
        sums = [np.bincount(text, x, len(batch)) for x in (known, self.log.take(words), logs)]
        at = np.flatnonzero(~known)
        found = pa.table([pa.array(text.take(at)), listed.take(pa.array(at))], ["text", "word"])
        rare = found.group_by(["text", "word"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
        own = np.bincount(rare["text"].to_numpy(), minlength=len(batch))  # texts are met in order
        pairs = [rare["word"].combine_chunks().cast(pa.binary()), rare["count_all"].combine_chunks()]
        ends = pa.array(np.concatenate(([0], np.cumsum(own))), pa.int32())
        return [
            pa.array(sizes, pa.int64()),
            pa.array(sums[0].astype(np.int64)),
            *map(pa.array, sums[1:]),
            pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(pairs, ["word", "n"])),
        ]


def score(
    docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT
) -> DataFrame:
    """Log10 probabilities of all whole texts; one row per document.

    Counts and the model are learned from the rows where `learn` holds. Returns key, `n_tokens`,
    `n_known` (tokens that the training texts have), `train_tokens`, `base_score` (of the smoothed
    counts) and `score` (of the log-bilinear model, which `train` learns from all of them, as are the
    counts). The `frequent` words have vectors of their own, as outputs and as context. A token outside them has the probability of the rest of its class times its
    smoothed share of that rest, so probabilities of tokens add up to one.
    A null or empty text is one end. Without training rows every token is unknown. Repeated rows and
    null keys stay; other columns are not looked at. Broadcast are `frequent` words and the model;
    the counts of rarer words are joined, a row per document and such word.
    """
    training = docs.where(learn)
    table = stage(count_words(training, text), "word-counts")
    counts = collect_counts(table, frequent)
    model = train(training, text, counts, key=key)
    shared = docs.sparkSession.sparkContext.broadcast((counts, model))

    def run(batches):
        scorer = Scorer(*shared.value)
        for batch in batches:
            for part in parts(batch, 2, PART_BYTES):
                arrays = [part.column(0), part.column(1), *scorer.score(raw_texts(part, 2))]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "key", "n_tokens", "known", "base", "model", "rare"])

    schema = (
        f"row bigint, key {docs.schema[key].dataType.simpleString()}, n_tokens bigint, known bigint, "
        "base double, model double, rare array<struct<word:binary,n:bigint>>"
    )
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")
    )
    rows = stage(source.mapInArrow(run, schema), "scores")
    log = F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.5))
    rare = (
        rows.select("row", F.explode("rare").alias("r"))
        .select("row", "r.word", "r.n")
        .join(table.select("word", F.col("n").alias("c")), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("n") * log).alias("more"),
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        )
    )
    more = F.coalesce("more", F.lit(0.0))
    return rows.drop("rare").join(rare, "row", "left").select(
        F.col("key").alias(key),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(counts.base())).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )

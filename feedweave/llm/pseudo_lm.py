"""Language-model scoring by masked pseudo-likelihood.

Each word is predicted from two words on either side by a network: the neighbours'
embeddings, one table for each place, are summed and passed through tanh, and softmaxes
down a tree of words, of BRANCHES branches at each of three levels, give every word of
the vocabulary its own probability.  Words outside the vocabulary are further branches of
the root by length, in which each word has its share of the occurrences in all other
documents.  The summed conditional log-probabilities score a document.

What is gathered grows with the corpus: the counts of all its words, in a table that is
partitioned by word.  The network is trained on every window of the corpus: about TRAIN of
them make a beginning on the driver, from which parts of the corpus go on, each in a task,
and the means of what they learn make the network.  Tasks get the network and the counts of the KNOWN most
frequent words; rarer words meet their counts in a join, and none of them is frequent
enough to be a hot key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.llm import text as tx
from feedweave.llm.session import cut

#: Branches of the tree of words; a word needs LEAST occurrences to be in the vocabulary.
BRANCHES, LEAST = 26, 5
VOCABULARY = BRANCHES**3
#: Bits of a hash by which its place is looked up.
FIRST = 18
#: The words whose counts tasks hold.
KNOWN = 1 << 18
#: Words outside the vocabulary: shorter than the first number of bytes, than the second, longer.
LENGTHS = (8, 12)
TAILS = len(LENGTHS) + 1
#: Embeddings of words outside the vocabulary as neighbours, by their last two bytes.
ENDINGS = 2048
#: Windows that the network begins with, about; width of the embeddings; rate of the steps.
TRAIN, WIDTH, RATE = 300_000, 16, 0.25
#: Words of a part, about, windows of one of its steps, and the unit in which its moves are added up.
PART, STEP, SCALE = 1 << 22, 1 << 16, 1 << 24
#: Rows below one node that go through its softmaxes together, and rows that fill a processor's cache.
BLOCK, ROWS = 64, 4096
#: Logits whose exponentials and their sums are safe in single precision.
SAFE = 60
#: What is added to the occurrences of a word outside the vocabulary elsewhere.
SMOOTHING = 0.1
#: The place of the edge of a document among the embeddings.
EDGE = VOCABULARY + ENDINGS


def _slices(batches: Iterator[pa.RecordBatch], column: int):
    for batch in batches:
        data, offsets = tx.buffers(batch.column(column))
        for low, high in tx.slices(offsets):
            yield batch, low, high, data, tx.words(data, offsets[low : high + 1])


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, tail, n): occurrences of each word, by its hash and length class, in all of
    `docs`.  Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        size = 0

        def summed() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate([k for k, _, _ in kept]), return_inverse=True)
            counts = np.bincount(n, np.concatenate([c for _, _, c in kept]), len(keys)).astype(np.int64)
            tails = np.zeros(len(keys), np.int64)
            tails[n] = np.concatenate([x for _, x, _ in kept])
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(tails), pa.array(counts)], ["word", "tail", "n"])

        for *_, w in _slices(batches, 0):
            keys, first, counts = np.unique(w.hashes, return_index=True, return_counts=True)
            kept.append((keys, np.searchsorted(LENGTHS, (w.ends - w.starts)[first], "right"), counts))
            size += len(keys)
            if size > 1_500_000:
                yield summed()
                kept, size = [], 0
        if size:
            yield summed()
        tx.release()

    return docs.select(text).mapInArrow(run, "word long, tail long, n long").groupBy("word", "tail").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """`hashes` are the sorted hashes of the words with a place in the network, `places`
    these places; `known` are sorted hashes of the most frequent words, `times` their
    occurrences.  By length class: occurrences and number of the words outside."""

    hashes: np.ndarray
    places: np.ndarray
    occurrences: np.ndarray  # by place
    known: np.ndarray
    times: np.ndarray
    tail_occurrences: np.ndarray
    tail_types: np.ndarray

    def __post_init__(self) -> None:
        """`starts` are where the hashes of each beginning of FIRST bits start, `most` of which have the same."""
        self.starts = np.searchsorted(self.hashes, np.arange(1 << FIRST, dtype=np.uint64) << np.uint64(64 - FIRST)).astype(np.int32)
        self.most = int(np.diff(np.append(self.starts, len(self.hashes))).max())

    def place(self, data: np.ndarray, w: tx.Words) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word among the embeddings, below VOCABULARY for the words of the tree,
        and its branch of the root, BRANCHES + length class for words outside."""
        size = w.ends - w.starts
        tail = BRANCHES + np.searchsorted(LENGTHS, size, "right")
        last = data[w.ends - 1].astype(np.int64) if len(size) else np.zeros(0, np.int64)
        before = np.where(size > 1, data[np.maximum(w.ends - 2, 0)], 0) if len(size) else last
        place = VOCABULARY + (last * 263 + before) % ENDINGS
        if len(self.hashes):
            at = self.starts.take((w.hashes >> np.uint64(64 - FIRST)).astype(np.int64))
            for _ in range(self.most):
                at += self.hashes.take(at, mode="clip") < w.hashes
            at = np.minimum(at, len(self.hashes) - 1)
            mine = self.hashes.take(at) == w.hashes
            place = np.where(mine, self.places[at], place)
            tail = np.where(mine, self.places[at] // BRANCHES**2, tail)
        return place.astype(np.int32), tail.astype(np.int32)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the counts of all words.  Words of equal counts are all in or all out."""
    bucket = F.round(F.log("n") * 256)
    sizes = counts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("words"), F.min("n").alias("least"), F.max("n").alias("most")).orderBy(F.desc("bucket")).collect()
    limits = {}
    for room in (VOCABULARY, KNOWN):
        held, limits[room] = 0, 1 << 62
        for r in sizes:  # a row for each of some thousand sizes
            held += r["words"]
            if held > room:
                break
            limits[room] = r["least"]
    least = max(LEAST, limits[VOCABULARY])
    # at most KNOWN rows by the choice of the limit; a vocabulary word is always known
    got = counts.where(F.col("n") >= min(limits[KNOWN], least)).toArrow()
    words, n = got["word"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(words)
    known, times = words[order], n[order]
    chosen = np.flatnonzero(times >= least)
    by_count = chosen[np.lexsort((known[chosen], -times[chosen]))]
    places = np.full(len(known), -1)
    places[by_count] = np.arange(len(by_count))
    outside = counts.where(F.col("n") < least).groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()
    tails = {r["tail"]: (r["n"], r["types"]) for r in outside}
    totals = np.array([tails.get(k, (0, 0)) for k in range(TAILS)], np.float64)
    return Vocabulary(known[chosen], places[chosen], times[by_count].astype(np.float64), known, times, totals[:, 0], totals[:, 1])


def windows(place: np.ndarray, bounds: np.ndarray, some: np.ndarray | None = None) -> np.ndarray:
    """Places of the words two and one before and one and two after each word, or after `some` of them."""
    first, last = np.repeat(bounds[:-1], np.diff(bounds)), np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(len(place))
    if some is not None:
        at, first, last = some, first[some], last[some]
    out = np.full((len(at), 4), EDGE, np.int32)
    for k, step in enumerate((-2, -1, 1, 2)):
        there = at + step
        inside = (there >= first) & (there < last)
        out[inside, k] = place[there[inside]]
    return out


def sampled_windows(docs: DataFrame, words: Vocabulary, share: float, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(neighbours, branch, place) of the windows of a share of all words, chosen by a hash
    of the row and the word's number in it."""
    limit = np.uint64(min((1 << 64) - 1, int(share * float(1 << 64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, low, high, data, w in _slices(batches, 1):
            counts = np.diff(w.bounds)
            seed = np.repeat(np.asarray(batch.column(0))[low:high].view(np.uint64), counts)
            number = np.arange(len(seed)) - np.repeat(w.bounds[:-1], counts)
            some = np.flatnonzero(tx.pair(seed, number.astype(np.uint64)) <= limit)
            if len(some):
                beside = np.unique(np.clip(some[:, None] + np.arange(-2, 3), 0, len(seed) - 1))
                place, branch = np.empty(len(seed), np.int32), np.empty(len(seed), np.int32)
                place[beside], branch[beside] = words.place(data, tx.Words(w.bounds, w.starts[beside], w.ends[beside], w.hashes[beside], w.ranges))
                near = windows(place, w.bounds, some)
                yield pa.RecordBatch.from_arrays([*(pa.array(near[:, k]) for k in range(4)), pa.array(branch[some]), pa.array(place[some])], ["a", "b", "c", "d", "branch", "place"])
        tx.release()

    # the number of rows is about TRAIN by the choice of the share
    got = docs.select(F.xxhash64(key, text), text).mapInArrow(run, "a int, b int, c int, d int, branch int, place int").toArrow()
    columns = [got[c].to_numpy() for c in got.column_names]
    order = np.lexsort(columns)  # the order in which tasks end must not matter
    order = order[np.random.default_rng(7).permutation(len(order))]
    return np.stack(columns[:4], 1)[order], columns[4][order], columns[5][order]


@dataclass
class Network:
    """Embeddings by place of the neighbour; weights and biases of the root's branches and,
    level by level, of the nodes below, in order of the words under them."""

    tables: np.ndarray
    root: np.ndarray
    root_bias: np.ndarray
    levels: list[np.ndarray]
    biases: list[np.ndarray]

    def parts(self) -> list[np.ndarray]:
        return [self.tables, self.root, self.root_bias, *self.levels, *self.biases]

    def rows(self) -> np.ndarray:
        """All parameters: embeddings, branches of the root and nodes below, a row each, with the bias last."""
        tables = self.tables.reshape(-1, self.tables.shape[2])
        pairs = [(tables, np.zeros(len(tables), np.float32)), (self.root.T, self.root_bias), *zip(self.levels, self.biases, strict=True)]
        return np.concatenate([np.concatenate([x, b[:, None]], 1) for x, b in pairs])

    def copy(self, rows: np.ndarray | None = None) -> Network:
        """A network of its own with the same parameters, or with those of `rows`."""
        rows = self.rows() if rows is None else rows
        tables, root, one, two = np.split(rows, np.cumsum([self.tables.shape[0] * self.tables.shape[1], self.root.shape[1], len(self.levels[0])]))
        own = np.ascontiguousarray
        return Network(own(tables[:, :-1]).reshape(self.tables.shape), own(root[:, :-1].T), own(root[:, -1]), [own(x[:, :-1]) for x in (one, two)], [own(x[:, -1]) for x in (one, two)])

    def hidden(self, near: np.ndarray) -> np.ndarray:
        """What comes out of tanh for each window, and a column of ones for the biases; a last row, for blocks that aren't full, is 0."""
        n, width = len(near), self.tables.shape[2]
        out = np.zeros((n + 1, width + 1), self.tables.dtype)
        for low in range(0, n, ROWS):
            some = near[low : low + ROWS]
            total = self.tables[0].take(some[:, 0], 0)
            for k in range(1, 4):
                total += self.tables[k].take(some[:, k], 0)
            np.tanh(total, out=out[low : low + len(some), :width])
        out[:n, width] = 1
        return out

    def _root(self) -> np.ndarray:
        """Weights of the root's branches, a row each, with the bias last."""
        return np.concatenate([self.root.T, self.root_bias[:, None]], 1)

    def _below(self, place: np.ndarray, hidden: np.ndarray, rows: np.ndarray, node: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(blocks, inputs, weights, logits, picked) for the `blocks` of _blocks, some at a time.  Weights and logits are those
        of the branches of the node before the last and of the last; `picked` are the two places of each row's branches in
        the flattened logits.
        """
        one, two = (np.concatenate([w, b[:, None]], 1).reshape(-1, BRANCHES, w.shape[1] + 1) for w, b in zip(self.levels, self.biases, strict=True))
        place = np.append(place, 0)
        many = max(1, ROWS // BLOCK)
        first = (np.arange(many) * 2 * BRANCHES * BLOCK)[:, None] + np.arange(BLOCK)
        for low in range(0, len(node), many):
            some, at = rows[low : low + many], node[low : low + many]
            weights = np.concatenate([one[at // BRANCHES], two[at]], 1)
            inputs, words = hidden.take(some, 0), place.take(some)
            logits = (weights @ inputs.transpose(0, 2, 1)).reshape(len(at), 2, BRANCHES, BLOCK)
            picked = np.stack([words // BRANCHES % BRANCHES, words % BRANCHES + BRANCHES], 1) * BLOCK + first[: len(at), None]
            yield slice(low, low + len(at)), inputs, weights, logits, picked

    def log_probabilities(self, near: np.ndarray, branch: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each word, or for words outside the vocabulary of their branch."""
        out = np.empty(len(near), np.float32)
        hidden, root = self.hidden(near), self._root()
        for low in range(0, len(near), ROWS):
            part = slice(low, min(low + ROWS, len(near)))
            logits = root @ hidden[part].T
            out[part] = logits[branch[part], np.arange(logits.shape[1])]
            out[part] -= _exp(logits)[1]
        rows, node, at = _blocks(place)
        below = np.zeros((len(node) + 1, BLOCK), np.float32)
        for blocks, _, _, logits, picked in self._below(place, hidden, rows, node):
            got = logits.ravel().take(picked)
            got -= _exp(logits)[1]
            got.sum(1, out=below[blocks])
        out += below.ravel().take(at)
        return out

    def slopes(self, near: np.ndarray, branch: np.ndarray, place: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Mean loss of some windows, and its gradients by what goes into tanh, by the root's branches and, level by level,
        (nodes, gradients) below.  Those of weights are rows with the bias last."""
        n, root = len(near), self._root()
        hidden = self.hidden(near)
        width = hidden.shape[1] - 1
        back, by_root, loss = np.empty((n, width), hidden.dtype), np.zeros_like(root), 0.0
        for low in range(0, n, ROWS):
            part = slice(low, min(low + ROWS, n))
            h, mine = hidden[part], (branch[part], np.arange(part.stop - low))
            error = root @ h.T
            loss -= float(error[mine].sum())
            sums, logs = _exp(error)
            loss += float(logs.sum())
            error *= 1 / (n * sums)
            error[mine] -= 1 / n
            back[part] = error.T @ root[:, :width]
            by_root += error @ h
        rows, node, at = _blocks(place)
        backs = np.zeros((len(node) + 1, BLOCK, width), hidden.dtype)
        found = np.empty((len(node), 2 * BRANCHES, width + 1), hidden.dtype)
        for blocks, inputs, weights, error, picked in self._below(place, hidden, rows, node):
            flat = error.ravel()
            lost = -flat.take(picked)
            sums, logs = _exp(error)
            lost += logs
            loss += float(lost.sum(1)[rows[blocks] < n].sum())
            error *= 1 / (n * sums[:, :, None])
            flat[picked] -= 1 / n
            error = error.reshape(-1, 2 * BRANCHES, BLOCK)
            np.matmul(error.transpose(0, 2, 1), weights[:, :, :width], out=backs[blocks])
            np.matmul(error, inputs, out=found[blocks])  # nothing from rows of zeros
        backs = backs.reshape(-1, width)
        for low in range(0, n, ROWS):
            part = slice(low, min(low + ROWS, n))
            back[part] += backs.take(at[part], 0)
            back[part] *= 1 - hidden[part, :width] ** 2
        last, below = node, []
        for level in (1, 0):
            nodes, summed = _summed(last, found)
            below.insert(0, (nodes, summed[:, level * BRANCHES :]))
            last, found = nodes // BRANCHES, summed[:, :BRANCHES]
        return loss / n, back, by_root, below

    def gradients(self, near: np.ndarray, branch: np.ndarray, place: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int, np.ndarray, np.ndarray]]]:
        """Mean loss of some windows, and its gradients by what goes into tanh, by the root's
        weights and biases, and (level, first node, last node) by (weights, biases) below."""
        loss, back, by_root, below = self.slopes(near, branch, place)
        each = [(level, k * BRANCHES, (k + 1) * BRANCHES, g[:, :-1], g[:, -1]) for level, (nodes, found) in enumerate(below) for k, g in zip(nodes.tolist(), found, strict=True)]
        return loss, back, by_root[:, :-1].T, by_root[:, -1], each


def _blocks(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of vocabulary words, BLOCK of them below one node of the last level and len(place) where a block isn't full; the
    node of each block, in order; where each row is in the flattened blocks, behind the last for words outside."""
    inside = np.flatnonzero(place < VOCABULARY)
    node = (place[inside] // BRANCHES).astype(np.uint16)
    order = np.argsort(node, kind="stable")
    counts = np.bincount(node, minlength=1)
    blocks = -(-counts // BLOCK)
    slots = np.arange(len(order)) + np.repeat((np.cumsum(blocks) - blocks) * BLOCK - (np.cumsum(counts) - counts), counts)
    rows = np.full(blocks.sum() * BLOCK, len(place))
    rows[slots] = inside[order]
    at = np.full(len(place), len(rows))
    at[inside[order]] = slots
    return rows.reshape(-1, BLOCK), np.repeat(np.arange(len(counts)), blocks), at


def _summed(nodes: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of some nodes in order, and the sums of what was found for each."""
    nodes, first, counts = np.unique(nodes, return_index=True, return_counts=True)
    out = found.take(first, 0)
    for i in np.flatnonzero(counts > 1):
        found[first[i] : first[i] + counts[i]].sum(0, out=out[i])
    return nodes, out


def _exp(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the logits of softmaxes, along the last axis but one: exponentials, in place, over the largest where single
    precision needs it; their sums, and the logarithms of the sums of all exponentials."""
    most = 0.0
    if logits.max(initial=0) > SAFE or logits.min(initial=0) < -SAFE:
        most = logits.max(-2)
        logits -= most[..., None, :]
    np.exp(logits, out=logits)
    sums = (np.ones((1, logits.shape[-2]), logits.dtype) @ logits)[..., 0, :]
    return sums, np.log(sums) + most


class Adagrad:
    """Steps of a network; `squares` are the sums of squared gradients of its parameters."""

    def __init__(self, network: Network, squares: list[np.ndarray] | None = None, rate: float = RATE):
        self.network, self.rate = network, rate
        self.parts = network.parts()
        self.squares = [np.full(x.shape, 1e-6, np.float32) for x in self.parts] if squares is None else squares

    def _move(self, part: int, gradient: np.ndarray, at=...) -> None:
        x, square = self.parts[part], self.squares[part]
        square[at] += gradient * gradient
        x[at] -= self.rate * gradient / np.sqrt(square[at])

    def step(self, near: np.ndarray, branch: np.ndarray, place: np.ndarray) -> None:
        _, back, by_root, below = self.network.slopes(near, branch, place)
        columns = np.ascontiguousarray(back.T, np.float64)
        for k in range(4):
            beside = np.ascontiguousarray(near[:, k], np.int64)
            touched = np.flatnonzero(np.bincount(beside))
            self._move(0, np.stack([np.bincount(beside, x)[touched] for x in columns], 1).astype(back.dtype), (k, touched))
        self._move(1, by_root[:, :-1].T)
        self._move(2, by_root[:, -1])
        for level, (nodes, found) in enumerate(below):
            rows = (nodes[:, None] * BRANCHES + np.arange(BRANCHES)).ravel()
            found = found.reshape(len(rows), found.shape[2])
            self._move(3 + level, found[:, :-1], rows)
            self._move(5 + level, found[:, -1], rows)


def untrained(words: Vocabulary, width: int = WIDTH, seed: int = 1) -> Network:
    """A network that gives every word its share of all occurrences, whatever the neighbours."""
    mass = np.full(VOCABULARY, 1e-9)
    mass[: len(words.occurrences)] += words.occurrences
    shares = [np.log(mass.reshape(-1, BRANCHES**k).sum(1)).astype(np.float32) for k in range(3)]
    return Network(
        np.random.default_rng(seed).normal(0, 0.1, (4, EDGE + 1, width)).astype(np.float32),
        np.zeros((width, BRANCHES + TAILS), np.float32),
        np.append(shares[2], np.log(words.tail_occurrences + 1e-9)).astype(np.float32),
        [np.zeros((VOCABULARY // below, width), np.float32) for below in (BRANCHES, 1)],
        [shares[1], shares[0]],
    )


def _epochs(learner: Adagrad, near: np.ndarray, branch: np.ndarray, place: np.ndarray, epochs: int, batch: int, seed: int = 1) -> None:
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(near))
        for low in range(0, len(order), batch):
            some = order[low : low + batch]
            learner.step(near[some], branch[some], place[some])


def train(words: Vocabulary, near: np.ndarray, branch: np.ndarray, place: np.ndarray, width: int = WIDTH, epochs: int = 2, batch: int = 4096, rate: float = RATE, seed: int = 1) -> Network:
    """A network trained on windows by Adagrad, from the untrained one on."""
    learner = Adagrad(untrained(words, width, seed), rate=rate)
    _epochs(learner, near, branch, place, epochs, batch, seed)
    return learner.network


def trained_on_all(docs: DataFrame, words: Vocabulary, start: Adagrad, total: float, key: str = "doc_id", text: str = "text") -> Network:
    """The network of `start` trained on, by one pass over every window of `docs`.

    Rows are dealt by a hash over parts of about PART words, in its order.  Each part goes through its windows from the same
    start, STEP at a time; a row of parameters then moves by the mean of its moves in the parts that moved it.
    Moves are added up as whole numbers, so the order of tasks makes no difference.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((words, start.network, start.squares))  # bounded by VOCABULARY, KNOWN and ENDINGS
    width = start.network.tables.shape[2]
    names = [f"v{i}" for i in range(width + 1)]

    def learned(batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch:
        """How the rows of parameters move that one part moves."""
        vocabulary, network, squares = shared.value
        before = network.rows()
        learner = Adagrad(network.copy(), [x.copy() for x in squares])
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def learn() -> None:
            near, branch, place = (np.concatenate(x) for x in zip(*held, strict=True))
            for low in range(0, len(near), STEP):
                learner.step(near[low : low + STEP], branch[low : low + STEP], place[low : low + STEP])

        for _, _, _, data, w in _slices(batches, 1):
            place, branch = vocabulary.place(data, w)
            held.append((windows(place, w.bounds), branch, place))
            size += len(place)
            if size >= STEP:
                learn()
                held, size = [], 0
        if size:
            learn()
        moved = np.rint((learner.network.rows() - before).astype(np.float64) * SCALE).astype(np.int64)
        rows = np.flatnonzero(moved.any(1))
        return pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *(pa.array(moved[rows, i]) for i in range(width + 1))], ["row", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cuts() -> Iterator[tuple[int, pa.RecordBatch]]:
            for batch in batches:
                part = batch.column(0).to_numpy()
                ends = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
                yield from ((int(part[a]), batch.slice(a, b - a)) for a, b in pairwise(ends) if b > a)

        for _, mine in groupby(cuts(), lambda x: x[0]):
            yield learned(b for _, b in mine)
        tx.release()

    parts = max(1, math.ceil(total / PART))
    h = F.xxhash64(key, text)
    dealt = docs.select(F.pmod(h, F.lit(parts)).cast("int").alias("part"), text, h.alias("h")).repartition(parts, "part").sortWithinPartitions("part", "h")
    moves = dealt.mapInArrow(run, ", ".join(["row int", *(f"{n} long" for n in names)]))
    summed = moves.groupBy("row").agg(F.count("*").alias("n"), *(F.sum(n).alias(n) for n in names)).toArrow()  # at most a row for each of the network's
    rows, n = summed["row"].to_numpy(), summed["n"].to_numpy()
    every = start.network.rows().astype(np.float64)
    for i, name in enumerate(names):
        every[rows, i] += summed[name].to_numpy() / n / SCALE
    return start.network.copy(every.astype(np.float32))


@dataclass
class Model:
    words: Vocabulary
    network: Network
    counts: DataFrame = field(repr=False)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Counts of all words of `docs`, and the network.  Without documents, or where no word
    occurs LEAST times, the vocabulary is empty and all words are known by length alone."""
    counts = cut(word_counts(docs, text))
    words = vocabulary(counts)
    total = words.occurrences.sum() + words.tail_occurrences.sum()
    start = Adagrad(untrained(words))
    _epochs(start, *sampled_windows(docs, words, TRAIN / max(total, 1), key, text), epochs=2, batch=4096)
    return Model(words, trained_on_all(docs, words, start, total, key, text) if total > TRAIN else start.network, counts)  # a small corpus was read whole


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, log_likelihood, per_word, n_alone) of each row of `docs`.

    log_likelihood is the sum over the words of the natural logarithm of their probability
    given both sides; per_word is its mean.  A word outside the vocabulary has the share
    (n - own + SMOOTHING) / (all + SMOOTHING * types) of its length class, where n are its
    occurrences in the corpus and own those in this row; words that the corpus doesn't
    have count as 0 there.  n_alone is the number of words of the row that occur nowhere
    else in the corpus.  A null or empty text has n_words 0, log_likelihood 0, per_word
    null and n_alone 0.  Rows with null or repeated keys are each scored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.network))  # bounded by VOCABULARY, KNOWN and ENDINGS
    below = np.log(np.maximum(model.words.tail_occurrences + SMOOTHING * model.words.tail_types, SMOOTHING))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, network = shared.value
        for batch, low, high, data, w in _slices(batches, 1):
            counts = np.diff(w.bounds)
            place, branch = words.place(data, w)
            total = np.concatenate([[0.0], np.cumsum(network.log_probabilities(windows(place, w.bounds), branch, place), dtype=np.float64)])
            sums = total[w.bounds[1:]] - total[w.bounds[:-1]]
            rare = np.flatnonzero(branch >= BRANCHES)
            row, hashes = np.repeat(np.arange(high - low), counts)[rare], w.hashes[rare]
            order = np.lexsort((hashes, row))
            row, hashes, tail = row[order], hashes[order], branch[rare][order] - BRANCHES
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
            first = np.flatnonzero(new)
            own = np.diff(np.append(first, len(row)))
            row, hashes, tail = row[first], hashes[first], tail[first]
            here = np.zeros(len(row), bool)
            if len(words.known):
                at = np.minimum(np.searchsorted(words.known, hashes), len(words.known) - 1)
                here = words.known[at] == hashes
                n = words.times[at[here]]
                others = np.maximum(n - own[here], 0)
                sums += np.bincount(row[here], own[here] * (np.log(others + SMOOTHING) - below[tail[here]]), high - low)
                alone = np.bincount(row[here], own[here] * (others == 0), high - low).astype(np.int64)
            else:
                alone = np.zeros(high - low, np.int64)
            row, hashes, own, tail = row[~here], hashes[~here], own[~here], tail[~here]
            sums -= np.bincount(row, own * below[tail], high - low)
            bounds = pa.array(np.searchsorted(row, np.arange(high - low + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(low, high - low),
                    pa.array(counts),
                    pa.array(sums),
                    pa.array(alone),
                    pa.ListArray.from_arrays(bounds, pa.array(hashes.view(np.int64))),
                    pa.ListArray.from_arrays(bounds, pa.array(own.astype(np.int32))),
                ],
                ["key", "n_words", "sum", "alone", "words", "own"],
            )
        tx.release()

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text).mapInArrow(run, f"key {kind}, n_words long, sum double, alone long, words array<long>, own array<int>")
    rows = cut(rows.withColumn("id", F.monotonically_increasing_id()))  # kept, so that the ids stay what they are
    listed = rows.select("id", F.explode(F.arrays_zip("words", "own")).alias("w")).select("id", F.col("w.words").alias("word"), F.col("w.own").alias("own"))
    met = listed.join(model.counts.select("word", "n"), "word", "left")
    others = F.greatest(F.coalesce("n", F.lit(0)) - F.col("own"), F.lit(0))
    rest = met.groupBy("id").agg(F.sum(F.col("own") * F.log(others + SMOOTHING)).alias("more"), F.sum(F.when(others == 0, F.col("own")).otherwise(0)).alias("lone"))
    joined = rows.drop("words", "own").join(rest, "id", "left")
    scored = joined.select(F.col("key").alias(key), "n_words", (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("log_likelihood"), (F.col("alone") + F.coalesce("lone", F.lit(0))).cast("long").alias("n_alone"))
    return scored.select(key, "n_words", "log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("per_word"), "n_alone")

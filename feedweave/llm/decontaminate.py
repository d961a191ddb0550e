"""Benchmark decontamination: edit distance by CGK embedding and bit-sampling LSH.

A benchmark item of n words leaks where some passage of a document is within
k = ratio * n word edits of it.  Windows of an item's size are embedded by a CGK random
walk, which maps edit distance to Hamming distance: a pointer copies the word it
stands on and then moves on or stays, as a random bit for the step and the word says.
Sampled coordinates of several walks are the hash tables that windows and items meet
in; walks are added until simulated edits at the limit are found with the target
recall.  Candidates are verified by exact edit distance.  Where MOST_WALKS walks don't
reach the recall for some size of items, windows of that size are verified against every
item that shares a word sequence with them instead.

Only windows that can match are embedded: within k edits, n - g + 1 - k * g of an
item's g-word sequences survive, so a window with fewer sequences of any item is no
leak.  The items, in blocks of bounded size, go to every task; the documents are read
in place and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedweave.llm import text as tx

#: Benchmark items that tasks hold at once; more are taken block by block.
BLOCK_ITEMS = 20_000
#: Hash tables of a walk, coordinates of a table, most walks.
TABLES, COORDINATES, MOST_WALKS = 8, 4, 64
#: Windows that wait to be embedded together.
MOST_WINDOWS = 50_000


def sequences(h: np.ndarray, g: int) -> np.ndarray:
    """Hashes of the sequences of g words that start at each word."""
    if len(h) < g:
        return np.zeros(0, np.uint64)
    out = tx.mix(h[: len(h) - g + 1] + np.uint64(g))
    for i in range(1, g):
        out = tx.pair(out, h[i : len(h) - g + 1 + i])
    return out


def _walks(n: int, walk: int) -> tuple[np.ndarray, np.ndarray]:
    """Random moves of one walk for items of n words, and its tables' coordinates."""
    rng = np.random.default_rng([n, walk, 77])
    return rng.integers(0, 2, (3 * n, 256)).astype(np.int64), rng.integers(0, 3 * n, (TABLES, COORDINATES))


def embed(windows: np.ndarray, n: int, walk: int) -> np.ndarray:
    """Table keys (rows x TABLES) of windows (rows x n word hashes, 0 beyond the end)."""
    moves, coordinates = _walks(n, walk)
    rows = len(windows)
    padded = np.concatenate([windows, np.zeros((rows, 1), np.uint64)], axis=1)
    at, every = np.zeros(rows, np.int64), np.arange(rows)
    out = np.empty((3 * n, rows), np.uint64)
    for j in range(3 * n):
        out[j] = padded[every, at]
        at = np.minimum(at + moves[j, (out[j] >> np.uint64(7)).astype(np.uint8)], n)
    keys = np.empty((rows, TABLES), np.uint64)
    for t in range(TABLES):
        key = np.full(rows, (walk * TABLES + t + 1), np.uint64)
        for c in coordinates[t]:
            key = tx.pair(key, out[c])
        keys[:, t] = key
    return keys


def walks_for(n: int, k: int, recall: float) -> int:
    """Walks after which items of n words with k random edits are found with `recall`; 0 if
    MOST_WALKS don't reach it."""
    rng = np.random.default_rng([n, k, 5])
    trials = 300
    originals = rng.integers(1, 1 << 63, (trials, n), dtype=np.uint64)
    edited = np.empty_like(originals)
    for i, words in enumerate(originals):
        row = list(words)
        for _ in range(k):
            p, kind, new = rng.integers(0, max(1, len(row))), rng.integers(0, 3), rng.integers(1, 1 << 63, dtype=np.uint64)
            if kind == 0 and row:
                row[p] = new
            elif kind == 1 and row:
                del row[p]
            else:
                row.insert(p, new)
        edited[i] = [*row, *rng.integers(1, 1 << 63, n, dtype=np.uint64)][:n]
    found = np.zeros(trials, bool)
    for walk in range(MOST_WALKS):
        found |= (embed(originals, n, walk) == embed(edited, n, walk)).any(1)
        if found.mean() >= recall:
            return walk + 1
    return 0


def edit_distance_in(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the passage of `text` nearest to `item` in word edits;
    the first end among equals, and from there the shortest passage."""

    def last_row(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        step = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else step.copy()
        for i, word in enumerate(a):
            best = np.empty_like(row)
            best[0] = i + 1
            best[1:] = np.minimum(row[:-1] + (b != word), row[1:] + 1)
            row = np.minimum.accumulate(best - step) + step
        return row

    ends = last_row(item, text, True)
    end = int(np.argmin(ends))
    starts = last_row(item[::-1], text[:end][::-1], False)
    return int(ends[end]), end - int(np.argmin(starts)), end


@dataclass
class _Class:
    """Items of one length."""

    n: int
    k: int
    g: int
    need: int
    walks: int = 0
    items: list[int] = field(default_factory=list)
    grams: np.ndarray | None = None
    keys: np.ndarray | None = None
    owners: np.ndarray | None = None


class Items:
    """Benchmark items of one block, with the sequences and tables that find them."""

    def __init__(self, ids: list, texts: list[str], ratio: float, recall: float):
        self.ids, self.hashes = ids, tx.word_hashes(texts)
        self.classes: dict[int, _Class] = {}
        grams: dict[int, list[np.ndarray]] = {}
        for i, h in enumerate(self.hashes):
            n = len(h)
            if not n:
                continue
            k = int(ratio * n + 1e-9)
            g = max(1, min(3, n // (k + 1)))
            c = self.classes.setdefault(n, _Class(n, k, g, max(1, n - g + 1 - k * g)))
            c.items.append(i)
            grams.setdefault(g, []).append(sequences(h, g))
        self.grams = {g: np.unique(np.concatenate(x)) for g, x in grams.items()}
        self.rough = {g: _rough(x) for g, x in self.grams.items()}
        for c in self.classes.values():
            c.walks = walks_for(c.n, c.k, recall) if c.k else 1
            rows = np.stack([self.hashes[i] for i in c.items])
            parts = np.stack([sequences(r, c.g) for r in rows])
            c.grams = np.unique(parts)
            # without walks, an item's sequences are its keys
            keys = np.concatenate([embed(rows, c.n, w) for w in range(c.walks)], axis=1) if c.walks else parts
            owners = np.repeat(np.array(c.items), keys.shape[1])
            order = np.argsort(keys.ravel(), kind="stable")
            c.keys, c.owners = keys.ravel()[order], owners[order]

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, distance, start, end) of each leak, start and end in words of the row."""
        self.open: dict[int, list[tuple[int, int]]] = {}  # by class: (row, start) of windows
        self.rows: dict[int, np.ndarray] = {}  # words of the rows with windows
        self.near: dict[tuple[int, int], list[int]] = {}
        for low, high in tx.slices(offsets):
            self._windows(tx.words(data, offsets[low : high + 1]), low)
            if sum(map(len, self.open.values())) > MOST_WINDOWS:
                self._meet()
        self._meet()
        out = []
        for (row, item), places in self.near.items():
            wanted, h = self.hashes[item], self.rows[row]
            k = self.classes[len(wanted)].k
            best = None
            for low, high in _joined(sorted(places), len(wanted) + 2 * k):
                low = max(0, low - k)
                d, start, end = edit_distance_in(wanted, h[low : high + len(wanted) + k])
                if d <= k and (best is None or d < best[2]):
                    best = (row, item, d, low + start, low + end)
            if best:
                out.append(best)
        return sorted(out)

    def _windows(self, w: tx.Words, first_row: int) -> None:
        """Note the windows of some rows that hold enough sequences of items of their size."""
        h = w.hashes
        hits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for g, wanted in self.grams.items():
            s = sequences(h, g)
            here = np.flatnonzero(self.rough[g][s >> np.uint64(44)])
            row = np.searchsorted(w.bounds, here, "right") - 1
            here = here[here + g <= w.bounds[row + 1]]
            found = s[here]
            hits[g] = here[_among(found, wanted)], found[_among(found, wanted)]
        for c in self.classes.values():
            at, grams = hits[c.g]
            if len(at) < c.need:
                continue
            at = at[_among(grams, c.grams)]
            row = np.searchsorted(w.bounds, at, "right") - 1
            # need sequences in a row of them that one window, k words longer, can hold
            i = np.arange(len(at) - c.need + 1)
            j = i + c.need - 1
            wide = c.n + c.k - c.g
            for x in i[(row[i] == row[j]) & (at[j] - at[i] <= wide)] if len(i) else ():
                r = int(row[x])
                a = int(w.bounds[r])
                known = self.open.setdefault(c.n, [])
                low = max(0, int(at[x + c.need - 1]) - wide - a)
                if known and known[-1][0] == first_row + r:
                    low = max(low, known[-1][1] + 1)
                known += [(first_row + r, p) for p in range(low, int(at[x]) - a + 1)]
                if first_row + r not in self.rows:
                    self.rows[first_row + r] = h[a : int(w.bounds[r + 1])].copy()

    def _meet(self) -> None:
        """Find the items that share a table's key with the windows noted."""
        for n, known in self.open.items():
            c = self.classes[n]
            for low in range(0, len(known), 8192):
                part = known[low : low + 8192]
                windows = np.zeros((len(part), n), np.uint64)
                for i, (row, start) in enumerate(part):
                    words = self.rows[row][start : start + n]
                    windows[i, : len(words)] = words
                for keys in (embed(windows, n, walk) for walk in range(c.walks)) if c.walks else (np.stack([self._sequences(row, start, c) for row, start in part]),):
                    first = np.searchsorted(c.keys, keys)
                    hit = c.keys[np.minimum(first, len(c.keys) - 1)] == keys
                    for i, t in zip(*np.nonzero(hit), strict=True):
                        end = np.searchsorted(c.keys, keys[i, t], "right")
                        for item in set(c.owners[first[i, t] : end].tolist()):
                            self.near.setdefault((part[i][0], item), []).append(part[i][1])
        self.open = {}


    def _sequences(self, row: int, start: int, c: _Class) -> np.ndarray:
        """Sequences of a passage as long as any within the limit of an item there; 0 beyond
        the row's end."""
        found = sequences(self.rows[row][start : start + c.n + c.k], c.g)
        return np.append(found, np.zeros(c.n + c.k - c.g + 1 - len(found), np.uint64))


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def _rough(values: np.ndarray) -> np.ndarray:
    """A bit for each value's high bits, to rule out most values without a search."""
    out = np.zeros(1 << 20, bool)
    out[values >> np.uint64(44)] = True
    return out


def _joined(places: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """Ranges of sorted places that are at most `gap` apart."""
    low = high = places[0]
    for p in places[1:]:
        if p - high > gap:
            yield low, high
            low = p
        high = p
    yield low, high


def _blocks(benchmark: DataFrame, key: str, text: str, ratio: float, recall: float) -> Iterator[Items]:
    items = benchmark.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    blocks = -(-items.count() // BLOCK_ITEMS)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)) == b).collect() if blocks > 1 else items.collect()
        yield Items([r["key"] for r in rows], [r["text"] for r in rows], ratio, recall)


def leaks(docs: DataFrame, benchmark: DataFrame, ratio: float = 0.2, recall: float = 0.99, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item key, distance, n_words, word_start, word_end) of each document and item
    such that a passage of the document is within ratio * n_words word edits of the item.

    A document's words are its runs of bytes other than white space, A-Z in lower case.
    The passage given is the nearest, the first among equals; its end is exclusive.
    Null or empty documents and items leak nothing; rows with null or repeated keys are
    each searched and give rows with their keys.  Where both keys have one name, the
    item's is item_<name>.  Empty tables give no rows.
    """
    docs = docs.select(key, text)
    if item_key == key:
        benchmark, item_key = benchmark.withColumnRenamed(item_key, f"item_{item_key}"), f"item_{item_key}"
    spark = docs.sparkSession
    columns = [T.StructField(x, T.LongType()) for x in ("distance", "n_words", "word_start", "word_end")]
    schema = T.StructType([docs.schema[key], T.StructField(item_key, benchmark.schema[item_key].dataType), *columns])
    item_type = schema[item_key].dataType
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, item_key, item_text, ratio, recall):
        shared = spark.sparkContext.broadcast(block)  # BLOCK_ITEMS items at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            items = shared.value
            for batch in batches:
                found = items.search(*tx.buffers(batch.column(1)))
                if found:
                    row, item, distance, start, end = zip(*found, strict=True)
                    sizes = [len(items.hashes[i]) for i in item]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array([items.ids[i] for i in item], to_arrow_type(item_type)), *(pa.array(x, pa.int64()) for x in (distance, sizes, start, end))],
                        [key, item_key, "distance", "n_words", "word_start", "word_end"],
                    )

            tx.release()

        out = out.unionByName(docs.mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, ratio: float = 0.2, recall: float = 0.99, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` without the rows that hold a leak; clean rows stay as they are, with all their
    columns, null and empty texts among them.  Repeated rows go or stay together; an empty
    benchmark takes nothing away."""
    at = docs.columns.index(text)
    for block in _blocks(benchmark, item_key, item_text, ratio, recall):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # BLOCK_ITEMS items at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in items.search(*tx.buffers(batch.column(at)))]] = False
                yield batch.filter(pa.array(keep))
            tx.release()

        docs = docs.mapInArrow(run, docs.schema)
    return docs

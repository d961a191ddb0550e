"""Approximate nearest neighbours by a hierarchical k-means tree.

A tree of centroids is fitted on a bounded sample; every vector goes to the leaf that a
greedy descent ends in, and the centroid and spread of each node are then taken from all
vectors below it.  A query walks the tree best-bin-first: a priority queue holds the
nodes met, and the one that promises the largest inner product is opened next.  A node
promises the query's product with its centroid and, for its spread, the largest of as
many normal deviations as it holds vectors, so that nodes of all levels compare.  How
many leaves a query visits is calibrated: for a sample of the queries the exact
neighbours are computed, and visits widen until the wanted share of them lies in the
leaves visited.

Equal vectors are one entry with the smallest identifiers, so a common vector is no hot
leaf.  Leaves beside each other in the tree form blocks of bounded size, and a larger
leaf is cut into several; the entries of a block and the queries that visit leaves of it
meet in a sorted partition that is read as a stream.  A query goes to a block once, with
the list of the leaves that it visits there, and reads those only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedweave.llm.session import cut

#: Vectors that the tree is fitted on, branches of a node, sample vectors of a leaf at most.
SAMPLE, BRANCHES, LEAF = 20_000, 8, 4
#: Queries that visits are calibrated on; the share of their neighbours to reach.
CALIBRATION, RECALL = 256, 0.94
#: Entries of a block.
BLOCK = 4096


@dataclass
class Tree:
    """Nodes in an array, parents before children: centroid, first child and number of
    children (0: a leaf), leaf number (from left to right in the tree), spread."""

    centroids: np.ndarray
    first: np.ndarray
    children: np.ndarray
    leaf: np.ndarray
    spread: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.leaf >= 0).sum())

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest centroid at every level."""
        node = np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        while len(live := live[self.children[node[live]] > 0]):
            live = live[np.argsort(node[live], kind="stable")]
            parents, low = np.unique(node[live], return_index=True)
            for parent, rows in zip(parents, np.split(live, low[1:]), strict=True):
                some = np.arange(self.first[parent], self.first[parent] + self.children[parent])
                c = self.centroids[some]
                node[rows] = some[np.argmax(x[rows] @ c.T - 0.5 * (c * c).sum(1), axis=1)]
        return self.leaf[node]

    def measured(self, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Tree:
        """The tree with centroids and spreads of the vectors in its leaves, given their
        number, sum and sum of squared norms for each leaf."""
        n, total, square = np.zeros(len(self.leaf)), np.zeros_like(self.centroids), np.zeros(len(self.leaf))
        ends = self.leaf >= 0
        n[ends], total[ends], square[ends] = counts[self.leaf[ends]], sums[self.leaf[ends]], squares[self.leaf[ends]]
        for node in np.flatnonzero(~ends)[::-1]:
            some = slice(self.first[node], self.first[node] + self.children[node])
            n[node], total[node], square[node] = n[some].sum(), total[some].sum(0), square[some].sum()
        held = np.maximum(n, 1)
        centre = total / held[:, None]
        deviation = np.sqrt(np.maximum(square / held - (centre * centre).sum(1), 0) / centre.shape[1])
        spread = np.where(n > 0, deviation * np.sqrt(2 * np.log(np.maximum(n, 1.5))), -np.inf)
        return Tree(centre, self.first, self.children, self.leaf, spread)

    def searcher(self) -> Searcher:
        return Searcher(self)


class Searcher:
    """Best-bin-first walks over a measured tree."""

    def __init__(self, tree: Tree):
        self.tree = tree
        held = np.isfinite(tree.spread)
        self.below = [tuple(c for c in range(a, a + n) if held[c]) for a, n in zip(tree.first.tolist(), tree.children.tolist(), strict=True)]
        self.leaf = tree.leaf.tolist()
        self.empty = not held[0]

    def promises(self, q: np.ndarray) -> np.ndarray:
        """What each node promises each query."""
        return q @ self.tree.centroids.T + np.linalg.norm(q, axis=1)[:, None] * np.where(np.isfinite(self.tree.spread), self.tree.spread, 0)

    def order(self, promise: np.ndarray, visits: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first leaves in order of promise, of those that hold anything.  With sizes,
        visits widen until the leaves hold `least` entries."""
        if self.empty:
            return []
        value = (-promise).tolist()
        queue, out, held = [(value[0], 0)], [], 0
        leaf, below = self.leaf, self.below
        while queue and (len(out) < visits or held < least):
            node = heapq.heappop(queue)[1]
            if leaf[node] >= 0:
                out.append(leaf[node])
                held += int(sizes[leaf[node]]) if held < least and sizes is not None else 0
            else:
                for child in below[node]:
                    heapq.heappush(queue, (value[child], child))
        return out


def fit_tree(x: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 3) -> Tree:
    """k-means at every node until a node holds at most `leaf` vectors or can't be divided.
    Spreads are those of `x`."""
    rng = np.random.default_rng(seed)
    centroids, first, children = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [0], [0]
    todo, ends, at = [(0, np.arange(len(x)))], {}, 0
    while at < len(todo):
        node, rows = todo[at]
        at += 1
        parts = _k_means(x[rows], branches, 12 if len(rows) > 500 else 5, rng) if len(rows) > leaf else None
        if parts is None:
            ends[node] = rows
            continue
        first[node], children[node] = len(centroids), len(parts)
        for part in parts:
            todo.append((len(centroids), rows[part]))
            centroids.append(x[rows[part]].mean(0))
            first.append(0)
            children.append(0)
    leaves, stack, count = np.full(len(centroids), -1), [0], 0
    while stack:
        node = stack.pop()
        if children[node]:
            stack += range(first[node] + children[node] - 1, first[node] - 1, -1)
        else:
            leaves[node], count = count, count + 1
    tree = Tree(np.array(centroids), np.array(first), np.array(children), leaves, np.zeros(len(leaves)))
    return tree.measured(*_leaf_sums(tree.assign(x), x, count))


def _leaf_sums(leaf: np.ndarray, x: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, sum and sum of squared norms of the vectors in each leaf."""
    order = np.argsort(leaf, kind="stable")
    cuts = np.searchsorted(leaf[order], np.arange(leaves + 1))
    held = np.flatnonzero(np.diff(cuts))
    sums, squares = np.zeros((leaves, x.shape[1])), np.zeros(leaves)
    if len(held):
        sums[held] = np.add.reduceat(x[order], cuts[held], axis=0)
        squares[held] = np.add.reduceat((x[order] ** 2).sum(1), cuts[held])
    return np.diff(cuts), sums, squares


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> list[np.ndarray] | None:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)
        which = near[:, None] == np.arange(len(c))
        n = which.sum(0)
        c = np.where(n[:, None] > 0, which.T.astype(np.float64) @ x / np.maximum(n, 1)[:, None], c)
    parts = [np.flatnonzero(near == j) for j in np.unique(near)]
    return parts if len(parts) > 1 else None


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 1))


def _packed(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec): distinct rows with an identifier and a usable vector."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.cast(pc.list_flatten(column), pa.float64()).to_numpy(zero_copy_only=False) + 0.0  # null is NaN, -0 is 0
            ends = np.cumsum(size)

            def of_row(flags: np.ndarray, ends: np.ndarray = ends, size: np.ndarray = size) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(flags)])
                return sums[ends] - sums[ends - size]

            ok = (of_row(~np.isfinite(flat)) == 0) & (of_row(flat != 0) > 0)
            packed = [flat[e - n : e].tobytes() for e, n in zip(ends[ok], size[ok], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), pa.array(packed, pa.binary())], ["id", "vec"])

    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null")
    return rows.mapInArrow(pack, "id long, vec binary").distinct()


def _entries(packed: DataFrame, keep: int) -> DataFrame:
    """(vec, ids): the `keep` smallest identifiers of each distinct vector."""
    # the limit in the window is taken before the shuffle too, so a common vector is no hot key
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = packed.withColumn("rank", rank).where(F.col("rank") <= keep)
    return few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _measure(tree: Tree, index: DataFrame) -> tuple[Tree, np.ndarray]:
    """The tree with centroids and spreads of all entries, and the number of entries of
    each leaf.  Each task sends one row a leaf at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts, sums, squares = [], [], [], []
        width = tree.centroids.shape[1]
        for batch in batches:
            if batch.num_rows:
                found, where = np.unique(np.asarray(batch.column(0)), return_inverse=True)
                n, total, square = _leaf_sums(where, _matrix(batch.column(1)), len(found))
                at.append(found)
                counts.append(n)
                sums.append(total)
                squares.append(square)
            if len(at) > 64:
                at, counts, sums, squares = ([x] for x in _merged(at, counts, sums, squares))
        if at:
            leaf, n, total, square = _merged(at, counts, sums, squares)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(n.astype(np.int64)), pa.array(square), pa.array([t.tobytes() for t in total.reshape(-1, width)], pa.binary())], ["leaf", "n", "square", "total"])

    schema = "leaf long, n long, square double, total binary"
    parts = index.select("leaf", "vec").mapInArrow(add, schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                part = [np.asarray(batch.column(0))], [np.asarray(batch.column(1))], [_matrix(batch.column(3))], [np.asarray(batch.column(2))]
                held = _merged(*(x + ([y] if held is not None else []) for x, y in zip(part, held or [None] * 4, strict=True)))
        if held is not None:
            leaf, n, total, square = held
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(n), pa.array(square), pa.array([t.tobytes() for t in total], pa.binary())], ["leaf", "n", "square", "total"])

    rows = parts.repartition("leaf").mapInArrow(merge, schema).collect()  # one row a leaf, of which the sample bounds the number
    counts, sums, squares = np.zeros(tree.leaves, np.int64), np.zeros((tree.leaves, tree.centroids.shape[1])), np.zeros(tree.leaves)
    for r in rows:
        counts[r["leaf"]], squares[r["leaf"]], sums[r["leaf"]] = r["n"], r["square"], np.frombuffer(bytes(r["total"]), np.float64)
    return tree.measured(counts, sums, squares), counts


def _merged(at: list, counts: list, sums: list, squares: list) -> tuple[np.ndarray, ...]:
    """Sums of the rows of equal leaves."""
    leaf, where = np.unique(np.concatenate(at), return_inverse=True)
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(len(leaf)))
    n, total, square = (np.add.reduceat(np.concatenate(x)[order], cuts, axis=0) for x in (counts, sums, squares))
    return leaf, n, total, square


def _visits(search: Searcher, index: DataFrame, asked: DataFrame, k: int, recall: float) -> int:
    """Leaves to visit so that a share of `recall` of the exact neighbours of sampled queries
    is met.  The row itself, by its id, is no neighbour."""
    some = asked.orderBy(F.xxhash64("query_id", "vec"), "query_id", "vec").limit(CALIBRATION).collect()
    if not some:
        return 1
    q = np.frombuffer(b"".join(bytes(r["vec"]) for r in some), np.float64).reshape(len(some), -1)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None  # scores, leaves and identifiers, k + 1 columns at most
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = q @ _matrix(batch.column(1)).T
            what = np.broadcast_to(np.arange(batch.num_rows), scores.shape)
            leaves, ids = np.asarray(batch.column(0)), np.empty(batch.num_rows, object)
            ids[:] = batch.column(2).to_pylist()
            top = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
            here = np.take_along_axis(scores, top, 1), leaves[np.take_along_axis(what, top, 1)], ids[top]
            if best is not None:
                here = tuple(np.concatenate([a, b], 1) for a, b in zip(best, here, strict=True))
                top = np.argsort(-here[0], axis=1, kind="stable")[:, : k + 1]
                here = tuple(np.take_along_axis(x, top, 1) for x in here)
            best = here
        if best is not None:
            who = np.repeat(np.arange(len(q)), best[0].shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(best[0].ravel()), pa.array(best[1].ravel().astype(np.int64)), pa.array(best[2].ravel().tolist(), pa.list_(pa.int64()))], ["q", "score", "leaf", "ids"])

    found = index.select("leaf", "vec", "ids").mapInArrow(near, "q long, score double, leaf long, ids array<long>")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "leaf"))
    exact = found.withColumn("rank", rank).where(F.col("rank") <= k + 1).orderBy("q", "rank").collect()  # CALIBRATION * (k + 1) rows
    promise = search.promises(q)
    place = [{leaf: i for i, leaf in enumerate(search.order(p, len(search.leaf)))} for p in promise]
    needed: list[int] = []
    counted = [0] * len(some)
    for r in exact:
        for i in r["ids"]:
            if i != some[r["q"]]["query_id"] and counted[r["q"]] < k:
                counted[r["q"]] += 1
                needed.append(place[r["q"]][r["leaf"]])
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] + 1 if needed else 1


def _blocks(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block of each leaf and the number of blocks that it is cut into."""
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // BLOCK))
    block, room = 0, BLOCK
    for leaf, size in enumerate(sizes.tolist()):
        if size > room and room < BLOCK:
            block, room = block + 1, BLOCK
        first[leaf] = block
        if parts[leaf] > 1:
            block, room = block + int(parts[leaf]), BLOCK
        else:
            room -= size
    return first, parts


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, scanned): the k rows of `vectors` with the largest inner
    products with each row of `queries` that the search finds, the row itself left out.

    Ranks are from 1, nearest first, ties to the smaller vec_id; scores are in double
    precision on the vectors as given.  scanned is the number of distinct vectors in the
    leaves that the query visited.  Rows whose vector is null, empty, zero or has null or
    non-finite components, and rows without an id, take no part on either side.  Rows with
    the same id and vector count once; rows with a query's id aren't its neighbours.
    Usable vectors of different lengths raise ValueError.  Empty tables give no rows.
    """
    keep = k + 1
    whole = cut(_entries(_packed(vectors, key, vector), keep))
    asked = cut(_packed(queries, key, vector).withColumnRenamed("id", "query_id"))
    lengths = whole.select(F.length("vec").alias("n")).unionByName(asked.select(F.length("vec").alias("n"))).agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    if lengths["least"] != lengths["most"]:
        raise ValueError(f"vectors have from {lengths['least'] // 8} to {lengths['most'] // 8} components")
    sample = np.array([np.frombuffer(bytes(r["vec"]), np.float64) for r in whole.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()])
    if not len(sample):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, scanned long")
    fitted = fit_tree(sample)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = fitted.assign(_matrix(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(leaves.astype(np.int64)), batch.column(0), batch.column(1)], ["leaf", "vec", "ids"])

    index = cut(whole.mapInArrow(place, "leaf long, vec binary, ids array<long>"))
    tree, sizes = _measure(fitted, index)
    finder = tree.searcher()
    visits = _visits(finder, index, asked, k, recall)
    first_block, parts = _blocks(sizes)
    reference = sample[:BLOCK]
    reference_leaf = fitted.assign(reference)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = tree.searcher()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                q = _matrix(part.column(0))
                known = q @ reference.T
                # what is among the nearest found scores no less than the k + 1st of any part of it
                least, scanned = np.full(len(q), -np.inf), np.zeros(len(q), np.int64)
                who, block, lists = [], [], []
                for i, promise in enumerate(search.promises(q)):
                    visited = np.sort(np.array(search.order(promise, visits, sizes, keep), np.int32))
                    seen = np.zeros(len(sizes), bool)
                    seen[visited] = True
                    scanned[i] = sizes[visited].sum()
                    found = known[i][seen[reference_leaf]]
                    if len(found) >= keep:
                        bound = np.partition(found, -keep)[-keep]
                        least[i] = bound - 1e-9 * max(1.0, abs(bound))
                    whole_leaf = parts[visited] == 1
                    where, begin = np.unique(first_block[visited[whole_leaf]], return_index=True)
                    block += where.tolist()
                    lists += np.split(visited[whole_leaf], begin[1:]) if len(where) else []
                    for leaf in visited[~whole_leaf]:
                        block += range(first_block[leaf], first_block[leaf] + parts[leaf])
                        lists += [np.array([leaf], np.int32)] * int(parts[leaf])
                    who += [i] * (len(block) - len(who))
                at = pa.array(who, pa.int64())
                flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                leaves = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), part.column(0).take(at), leaves, pa.array(least).take(at), pa.array(scanned).take(at)], ["block", "vec", "leaves", "least", "scanned"])

    visiting = asked.select("vec").distinct().mapInArrow(walk, "block long, vec binary, leaves array<int>, least double, scanned long")
    spark = vectors.sparkSession
    blocks = spark.createDataFrame([(i, int(a), int(n)) for i, (a, n) in enumerate(zip(first_block, parts, strict=True))], "leaf long, first long, parts long")
    # a row a leaf, of which the sample bounds the number
    placed = index.join(F.broadcast(blocks), "leaf").withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec"), F.col("parts")))
    none = lambda t: F.lit(None).cast(t)
    entries = placed.select("block", F.lit(0).alias("kind"), "leaf", "vec", "ids", none("array<int>").alias("leaves"), none("double").alias("least"), none("long").alias("scanned"))
    asks = visiting.select("block", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("leaf"), "vec", none("array<long>").alias("ids"), "leaves", "least", "scanned")
    met = entries.unionByName(asks).repartition("block").sortWithinPartitions("block", "kind", "leaf")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        matrix = ids = leaf = None
        for batch in batches:
            block, kind = (np.asarray(batch.column(i)) for i in range(2))
            change = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for low, high in zip([0, *change], [*change, len(block)], strict=True):
                if low == high:
                    continue
                if block[low] != at:
                    at, held, matrix = block[low], [], None
                part = batch.slice(low, high - low)
                if kind[low] == 0:
                    held.append(part)
                elif held:
                    if matrix is None:
                        matrix = np.concatenate([_matrix(p.column(3)) for p in held])
                        leaf = np.concatenate([np.asarray(p.column(2)) for p in held])
                        ids = [x for p in held for x in p.column(4).to_pylist()]
                    yield from _top(matrix, leaf, ids, part, keep)

    scored = met.mapInArrow(scan, "vec binary, ids array<long>, score double, scanned long")
    own = scored.select("vec", F.explode("ids").alias("vec_id"), "score", "scanned")
    few = own.withColumn("rank", F.row_number().over(Window.partitionBy("vec").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= keep).drop("rank")
    pairs = asked.join(few, "vec").where("query_id <> vec_id").select("query_id", "vec_id", "score", "scanned")
    final = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", final).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "scanned")


def _top(matrix: np.ndarray, leaf: np.ndarray, ids: list, part: pa.RecordBatch, keep: int) -> Iterator[pa.RecordBatch]:
    """The best entries of a block, whose leaves are sorted, for each query of a batch among
    the leaves that it visits; scored row by row so that equal vectors score the same
    wherever they are."""
    least, q = np.asarray(part.column(6)), _matrix(part.column(3))
    who, what, score = [], [], []
    for i, visited in enumerate(part.column(5)):
        visited = visited.values.to_numpy()
        low, high = np.searchsorted(leaf, visited, "left"), np.searchsorted(leaf, visited, "right")
        n = high - low
        rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        rough = matrix[rows] @ q[i]
        near = rough >= least[i]
        rows, rough = rows[near], rough[near]
        if len(rows) > keep:
            last = np.partition(rough, -keep)[-keep]
            rows = rows[rough >= last - 1e-9 * max(1.0, abs(last))]
        exact = (matrix[rows] * q[i]).sum(1)
        order = np.lexsort(([ids[j][0] for j in rows], -exact))[:keep]
        who += [i] * len(order)
        what += [ids[j] for j in rows[order]]
        score += exact[order].tolist()
    at = pa.array(who, pa.int64())
    yield pa.RecordBatch.from_arrays([part.column(3).take(at), pa.array(what, pa.list_(pa.int64())), pa.array(score, pa.float64()), part.column(7).take(at)], ["vec", "ids", "score", "scanned"])

"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

All segmentations of a text into pieces form a lattice; a segmentation's probability is
the product of its pieces' weights over the sum of all.  Giving each an independent
Gumbel variable on top of its log-probability and taking the k largest sums samples k
different ones.  They are found by A-star search over the tree of choices, largest sum
first: the largest sum of a set of segmentations is a Gumbel variable as well, that of
the set in which it lies is its parent's, and those of the parent's other parts are
drawn truncated at it.  The segmentations that leave a sample at one of a range of its
choices are one set, whose probability follows from the sample's own; taking a sample
from it leaves two smaller ranges, the other edges of the choice and the choices of the
new sample.  A queue so has a handful of entries a sample, whatever the length of the text.

Between two bytes that no piece of the model holds in a row there is a piece's end in
every segmentation.  The lattice is a chain of small ones, one for each stretch ("word")
between such places; they are kept for the words met again.  Random numbers are hashes
of the row's key and the choice's place: a row gives the same samples wherever and
however often it is computed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedweave.llm import text as tx

#: Bytes of text that are sampled together; a longer text is alone.
STEP_BYTES = 3 << 19
#: Edges of lattices that a worker keeps from step to step.
KEPT_EDGES = 3_000_000
#: Log-weight of a byte piece, for bytes that no other piece covers alone.
BYTE_WEIGHT = -25.0
_B = np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1


class Pieces:
    """The pieces of a model file, for lookup by hash and for decoding."""

    def __init__(self, path: str, theta: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        raw, ids, weights = [], [], []
        self.bytes = [b""] * model.get_piece_size()
        self.byte_id = np.zeros(256, np.int32)
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i):
                continue
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[value], self.bytes[i] = i, bytes([value])
                continue
            piece = model.id_to_piece(i).replace("▁", " ").encode("utf-8")
            self.bytes[i] = piece
            raw.append(piece)
            ids.append(i)
            # scores are merge ranks, so a piece weighs as a word of that rank by Zipf's law
            weights.append(-theta * np.log(2.0 - model.get_score(i)))
        #: Whether some piece holds two bytes in a row.
        self.inside = np.zeros((256, 256), bool)
        for piece in raw:
            self.inside[list(piece[:-1]), list(piece[1:])] = True
        lengths = np.array([len(p) for p in raw])
        self.longest = int(lengths.max())
        flat, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(lengths)])
        h = np.zeros(len(raw), np.uint64)
        for j in range(self.longest):
            some = lengths > j
            h[some] = h[some] * _B + tx._VALUE_EXACT[flat[at[:-1][some] + j]]
        keys = tx.mix(h + lengths.astype(np.uint64))
        self.keys = np.append(keys, np.uint64(0))
        self.ids, self.weights = np.append(ids, 0).astype(np.int32), np.append(weights, -np.inf)
        self.slot = np.full((2, 1 << 20), len(raw), np.int32)
        rest = np.arange(len(raw))
        for k, shift in enumerate((np.uint64(44), np.uint64(24))):
            place = (keys[rest] >> shift & np.uint64(0xFFFFF)).astype(np.int64)
            _, first = np.unique(place, return_index=True)
            self.slot[k, place[first]] = rest[first]
            rest = np.delete(rest, first)
        if len(rest):
            raise ValueError(f"{path}: pieces don't fit the lookup table")
        sizes = np.array([len(b) for b in self.bytes])
        self.flat, self.start, self.size = np.frombuffer(b"".join(self.bytes), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of the piece of each key; the last index for none."""
        none = len(self.keys) - 1
        out = self.slot[0][(keys >> np.uint64(44)).astype(np.int64)]
        out = np.where(self.keys[out] == keys, out, none)
        miss = np.flatnonzero(out == none)
        second = self.slot[1][(keys[miss] >> np.uint64(24) & np.uint64(0xFFFFF)).astype(np.int64)]
        out[miss] = np.where(self.keys[second] == keys[miss], second, none)
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the pieces one after the other."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[ids] - (ends - size), size) + np.arange(total)]


@lru_cache(maxsize=2)
def pieces(path: str, theta: float) -> Pieces:
    return Pieces(path, theta)


@dataclass
class Lattices:
    """Lattices of different words.  Node `base[w] + j` is the end of the first j bytes of
    word w; its edges, first[node] to first[node + 1], come from shorter beginnings.  A
    word's chain is what the likeliest edges from its end lead to."""

    base: np.ndarray
    length: np.ndarray
    first: np.ndarray
    node: np.ndarray
    source: np.ndarray
    piece: np.ndarray
    logp: np.ndarray
    best: np.ndarray  # the likeliest edge of each node, and its probability
    best_p: np.ndarray
    key: np.ndarray  # node + probability of the node's edges up to each but the best
    chain: np.ndarray  # edges of the words' chains, chain_first[w] to chain_first[w + 1]
    chain_first: np.ndarray
    chain_key: np.ndarray  # word + probability to have left the chain by each of its edges
    chain_p: np.ndarray  # probability of each word's chain


def _joined(x: Lattices, y: Lattices) -> Lattices:
    """The words of two lattices one after the other."""
    nodes, edges, words, links = len(x.best), len(x.piece), len(x.base), len(x.chain)
    return Lattices(
        np.concatenate([x.base, y.base + nodes]),
        np.concatenate([x.length, y.length]),
        np.concatenate([x.first, y.first[1:] + edges]),
        np.concatenate([x.node, y.node + nodes]),
        np.concatenate([x.source, y.source + nodes]),
        np.concatenate([x.piece, y.piece]),
        np.concatenate([x.logp, y.logp]),
        np.concatenate([x.best, y.best + edges]),
        np.concatenate([x.best_p, y.best_p]),
        np.concatenate([x.key, y.key + nodes]),
        np.concatenate([x.chain, y.chain + edges]),
        np.concatenate([x.chain_first, y.chain_first[1:] + links]),
        np.concatenate([x.chain_key, y.chain_key + words]),
        np.concatenate([x.chain_p, y.chain_p]),
    )


def lattices(p: Pieces, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Lattices:
    """Of the words at `starts` of `data`.  An edge's probability is that of its being
    the last piece of a segmentation up to the node."""
    order = np.argsort(lengths, kind="stable")
    base = np.zeros(len(starts), np.int32)
    parts, nodes, at = [], 0, 0
    none = len(p.keys) - 1
    while at < len(order):
        longest = int(lengths[order[at]])
        room = max(1, 1_000_000 // ((longest + 8) * min(longest + 8, p.longest)))
        stop = int(np.searchsorted(lengths[order], longest + longest // 8, "right"))
        group = order[at : min(stop, at + room)]
        at += len(group)
        size = int(lengths[group].max())
        n, reach = len(group), min(size, p.longest)
        base[group] = nodes + np.arange(n) * (size + 1)
        text = data[np.minimum(starts[group][:, None] + np.arange(size), len(data) - 1)]
        prefix = np.zeros((n, size + 1), np.uint64)
        for j in range(size):
            prefix[:, j + 1] = prefix[:, j] * _B + tx._VALUE_EXACT[text[:, j]]
        found = np.full((n, size + 1, reach), none, np.int32)
        for k in range(1, reach + 1):
            power = np.uint64(pow(int(_B), k, 1 << 64))
            found[:, k:, k - 1] = p.find(tx.mix(prefix[:, k:] - prefix[:, :-k] * power + np.uint64(k)).ravel()).reshape(n, -1)
        weight = p.weights[found]
        weight[:, 1:, 0][found[:, 1:, 0] == none] = BYTE_WEIGHT
        total = np.full((n, size + 1), -np.inf)
        total[:, 0] = 0
        for j in range(1, size + 1):
            k = min(j, reach)
            ways = total[:, j - k : j][:, ::-1] + weight[:, j, :k]
            most = ways.max(1)
            total[:, j] = most + np.log(np.exp(ways - most[:, None]).sum(1))
        inside = np.arange(size + 1)[None, :] <= lengths[group][:, None]
        w, j, k = np.nonzero((weight > -np.inf) & inside[:, :, None])
        end = (nodes + w * (size + 1) + j).astype(np.int32)  # a step has far fewer nodes than 2^31
        which = found[w, j, k]
        ids = np.where(which == none, p.byte_id[text[w, j - 1]], p.ids[which])
        parts.append((end, end - (k + 1).astype(np.int32), ids, np.minimum(total[w, j - k - 1] + weight[w, j, k] - total[w, j], 0.0)))
        nodes += n * (size + 1)
    node, source, piece, logp = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32),) * 4
    first = np.searchsorted(node, np.arange(nodes + 1, dtype=np.int32)).astype(np.int32)
    best, best_p, chance = np.zeros(nodes, np.int32), np.zeros(nodes), np.exp(logp)
    ends = np.flatnonzero(first[1:] > first[:-1])
    if len(ends):
        best_p[ends] = np.maximum.reduceat(chance, first[ends])
        likeliest = np.flatnonzero(chance == best_p[node])[::-1]
        best[node[likeliest]] = likeliest  # the first of equals is written last
        chance[best[ends]] = 0
    sums = np.concatenate([[0.0], np.cumsum(chance)])
    key = node + np.minimum(sums[1:] - sums[first[node]], 1.0)
    who, edge = [], []
    at_node, live = (base + lengths).astype(np.int32), np.arange(len(base))
    while len(live):
        taken = best[at_node[live]]
        who.append(live)
        edge.append(taken)
        at_node[live] = source[taken]
        live = live[at_node[live] > base[live]]
    who, chain = (np.concatenate(x) for x in (who, edge)) if who else (np.zeros(0, np.int64), np.zeros(0, np.int32))
    order = np.argsort(who, kind="stable")
    who, chain = who[order], chain[order]
    chain_first = np.searchsorted(who, np.arange(len(base) + 1))
    sums = np.concatenate([[0.0], np.cumsum(logp[chain])])
    left = -np.expm1(sums[1:] - sums[chain_first[who]])
    chain_p = np.exp(sums[chain_first[1:]] - sums[chain_first[:-1]])
    return Lattices(base, lengths, first, node, source, piece, logp, best, best_p, key, chain, chain_first, who + left, chain_p)


class Words:
    """The lattices of words met, by the words' hashes."""

    def __init__(self, p: Pieces):
        self.pieces = p
        self.clear()

    def clear(self) -> None:
        self.hashes, self.index, self.lattices = np.zeros(0, np.uint64), np.zeros(0, np.int64), None

    def find(self, hashes: np.ndarray, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Lattice of each word of some rows, making those that aren't there."""
        keys, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
        if self.lattices is not None and len(self.lattices.piece) > KEPT_EDGES:
            self.clear()
        if self.lattices is None:
            self.hashes, self.index = keys, np.arange(len(keys))
            self.lattices = lattices(self.pieces, text, starts[first], lengths[first])
            return self.index[kind]
        new = ~_among(keys, self.hashes)
        if new.any():
            made = lattices(self.pieces, text, starts[first[new]], lengths[first[new]])
            here = np.searchsorted(self.hashes, keys[new])
            self.index = np.insert(self.index, here, len(self.lattices.base) + np.arange(int(new.sum())))
            self.hashes = np.insert(self.hashes, here, keys[new])
            self.lattices = _joined(self.lattices, made)
        return self.index[np.searchsorted(self.hashes, keys)][kind]


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values if len(wanted) else np.zeros(len(values), bool)


@lru_cache(maxsize=2)
def known_words(path: str, theta: float) -> Words:
    return Words(pieces(path, theta))


def uniform(seed: np.ndarray, sample: int, word: np.ndarray, step: np.ndarray, kind: int) -> np.ndarray:
    """A number in (0, 1) for each choice, from the row's seed and the choice's place."""
    h = tx.mix(seed + tx.mix(word.astype(np.uint64) * np.uint64(1 << 24) + step.astype(np.uint64)) + np.uint64((sample * 16 + kind + 1) * 0xD6E8FEB86659FD93 & _ALL))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _mixed(h: int) -> int:
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & _ALL
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & _ALL
    return h ^ (h >> 31)


class _Numbers:
    """Numbers in (0, 1) one after the other, from a row's seed."""

    def __init__(self, seed: int):
        self.state = _mixed(seed ^ 0x5851F42D4C957F2D)

    def next(self) -> float:
        self.state = (self.state + 0x9E3779B97F4A7C15) & _ALL
        return ((_mixed(self.state) >> 11) + 0.5) / (1 << 53)


@dataclass
class Paths:
    """One sample of each row: edges[words[j]:words[j + 1]] lead from the end of word j to
    its beginning."""

    words: np.ndarray
    edges: np.ndarray


def _walk(lat: Lattices, seed: np.ndarray, sample: int, word: np.ndarray, node: np.ndarray, step: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Choose edges from each given node down to its word's beginning; (who, edge) in order."""
    who, edges = [], []
    live = np.flatnonzero(node > base)
    node, step = node.copy(), step.copy()
    while len(live):
        here = node[live]
        u = uniform(seed[live], sample, word[live], step[live], 0)
        edge = lat.best[here]
        over = np.flatnonzero(u > lat.best_p[here])
        if len(over):
            edge[over] = _another(lat, here[over], u[over] - lat.best_p[here[over]])
        who.append(live)
        edges.append(edge)
        node[live] = lat.source[edge]
        step[live] += 1
        live = live[node[live] > base[live]]
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    who, edges = np.concatenate(who), np.concatenate(edges)
    order = np.argsort(who, kind="stable")
    return who[order], edges[order]


def _another(lat: Lattices, node: np.ndarray, up_to: np.ndarray) -> np.ndarray:
    """The edge of each node, but the likeliest, at which the others' probability exceeds `up_to`."""
    first, last = lat.first[node], lat.first[node + 1] - 1
    edge = np.clip(np.searchsorted(lat.key, node + up_to), first, last)
    best = edge == lat.best[node]  # only by rounding
    return np.where(best, np.where(edge > first, edge - 1, np.minimum(edge + 1, last)), edge)


def _draw(lat: Lattices, kind: np.ndarray, seed: np.ndarray, sample: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A segmentation of each word; (number of edges of each, all edges).  Most take their
    chain; the others leave it at one of its edges and go on from there."""
    u = uniform(seed, sample, word, np.zeros(len(kind), np.int64), 5)
    begin = lat.chain_first[kind]
    kept = lat.chain_first[kind + 1] - begin
    count = kept.copy()
    leave = np.flatnonzero(u >= lat.chain_p[kind])
    if len(leave):
        t = kind[leave]
        at = np.clip(np.searchsorted(lat.chain_key, t + (u[leave] - lat.chain_p[t]), "right"), lat.chain_first[t], lat.chain_first[t + 1] - 1)
        node = lat.node[lat.chain[at]]
        step = at - lat.chain_first[t]
        chance = uniform(seed[leave], sample, word[leave], step, 6) * (1 - lat.best_p[node])
        edge = np.where(lat.first[node + 1] - lat.first[node] > 1, _another(lat, node, chance), lat.best[node])
        who, more = _walk(lat, seed[leave], sample, word[leave], lat.source[edge], step + 1, lat.base[t])
        added = np.bincount(who, minlength=len(leave))
        kept[leave], count[leave] = step, step + 1 + added
    ends = np.cumsum(count)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    starts = ends - count
    out[_spread(starts, kept)] = lat.chain[_spread(begin, kept)]
    if len(leave):
        out[starts[leave] + step] = edge
        out[_spread(starts[leave] + step + 1, added)] = more
    return count, out


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] times each, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Queue:
    """The sets of segmentations of one row that hold no sample yet, by their largest sums.

    An entry is (-sum, serial, sample, low, high, taken): the segmentations that are the
    sample's up to a choice in low:high and differ there; with `taken`, high is low + 1
    and the edges taken are not among them.
    """

    def __init__(self, lat: Lattices, seed: int):
        self.lat, self.numbers = lat, _Numbers(seed)
        self.heap: list[tuple] = []
        self.edges: list[np.ndarray] = []
        self.fallen: list[np.ndarray] = []  # for each sample, minus the log-probability of its first choices

    def add(self, edges: np.ndarray, low: int, peak: float) -> None:
        """A sample with the sum `peak`, which may differ from what was there from choice `low` on."""
        fallen = np.empty(len(edges) + 1)
        fallen[0] = 0
        np.cumsum(-self.lat.logp[edges], out=fallen[1:])
        self.edges.append(edges)
        self.fallen.append(fallen)
        self._push(peak, len(self.edges) - 1, low, len(edges))

    def _push(self, peak: float, sample: int, low: int, high: int, taken: tuple[int, ...] = ()) -> None:
        fallen = self.fallen[sample]
        if taken:
            mass = sum(math.exp(self.lat.logp[e]) for e in self._left(sample, low, taken))
        else:
            mass = -math.expm1(fallen[low] - fallen[high]) if high > low else 0.0
        if mass > 0:
            # a Gumbel variable at log(mass) - fallen, truncated at the peak
            e = math.log(-math.log(self.numbers.next())) - math.log(mass) + fallen[low]
            bound = max(-peak, e) + math.log1p(math.exp(-abs(-peak - e)))
            heapq.heappush(self.heap, (bound, len(self.heap), sample, low, high, taken))

    def _left(self, sample: int, choice: int, taken: tuple[int, ...]) -> list[int]:
        node = self.lat.node[self.edges[sample][choice]]
        return [e for e in range(int(self.lat.first[node]), int(self.lat.first[node + 1])) if e not in taken]

    def largest(self) -> float:
        return -self.heap[0][0] if self.heap else -math.inf

    def pop(self) -> tuple[float, int, int, int]:
        """(sum, sample, choice, edge) of the next sample: it is the given one's up to the
        choice and takes the edge there.  What is left of its set goes back."""
        bound, _, sample, low, high, taken = heapq.heappop(self.heap)
        peak, fallen = -bound, self.fallen[sample]
        choice = low
        if not taken:
            gone = fallen[low] - math.log1p(self.numbers.next() * math.expm1(fallen[low] - fallen[high]))
            gone = min(gone, math.nextafter(fallen[high], -math.inf))
            choice = min(max(low, int(np.searchsorted(fallen[low + 1 : high + 1], gone, "right")) + low), high - 1)
            self._push(peak, sample, low, choice)
            self._push(peak, sample, choice + 1, high)
            taken = (int(self.edges[sample][choice]),)
        left = self._left(sample, choice, taken)
        chances = [math.exp(self.lat.logp[e]) for e in left]
        u = self.numbers.next() * sum(chances)
        i = 0
        while i + 1 < len(left) and u >= chances[i]:
            u -= chances[i]
            i += 1
        if len(left) > 1:
            self._push(peak, sample, choice, choice + 1, (*taken, left[i]))
        return peak, sample, choice, left[i]


class Sampler:
    """Samples of some rows: words of row i are words[i]:words[i + 1], each a lattice `kind`."""

    def __init__(self, lat: Lattices, words: np.ndarray, kind: np.ndarray, seeds: np.ndarray):
        self.lat, self.words, self.kind, self.seeds = lat, words, kind, seeds
        self.place = np.arange(len(kind)) - np.repeat(words[:-1], np.diff(words))

    def run(self, k: int) -> tuple[list[Paths], list[np.ndarray], np.ndarray]:
        """k samples: their paths (a row without any more has an empty one), their sums
        (-inf there), and the sum of the next after them."""
        n = len(self.seeds)
        zero = np.zeros(n, np.int64)
        peak = -np.log(-np.log(uniform(self.seeds, 0, zero, zero, 2)))
        count, edges = _draw(self.lat, self.kind, np.repeat(self.seeds, np.diff(self.words)), 0, self.place)
        paths, peaks = [Paths(np.concatenate([[0], np.cumsum(count)]), edges)], [peak]
        queues = [_Queue(self.lat, int(s)) for s in self.seeds]
        begin = zero
        for s in range(k):
            bounds = paths[s].words[self.words].tolist()
            for i, queue in enumerate(queues):
                if bounds[i] < bounds[i + 1]:
                    queue.add(paths[s].edges[bounds[i] : bounds[i + 1]], int(begin[i]), float(peaks[s][i]))
            if s + 1 == k:
                break
            parent, choice, edge, top = zero.copy(), np.full(n, -1), zero.copy(), np.full(n, -np.inf)
            for i, queue in enumerate(queues):
                if queue.heap:
                    top[i], parent[i], choice[i], edge[i] = queue.pop()
            paths.append(self._branch(paths, s + 1, parent, choice, edge))
            peaks.append(top)
            begin = choice + 1
        return paths, peaks, np.array([q.largest() for q in queues])

    def _branch(self, paths: list[Paths], sample: int, parent, choice, edge) -> Paths:
        """Paths that are their parents' up to a choice, take the edge given there and go on anew."""
        n = len(self.seeds)
        live = np.flatnonzero(choice >= 0)
        shift = np.concatenate([[0], np.cumsum([len(p.edges) for p in paths])])[parent]
        every = np.concatenate([p.edges for p in paths])
        ends = np.stack([p.words for p in paths])
        start = ends[parent, self.words[:-1]]
        kept = np.where(choice >= 0, choice, 0)
        # go on in the word of the choice, then in the words after it
        word = np.zeros(n, np.int64)
        for s, p in enumerate(paths):
            mine = live[parent[live] == s]
            word[mine] = np.searchsorted(p.words, start[mine] + choice[mine], "right") - 1
        word = word[live]
        step = start[live] + choice[live] - ends[parent[live], word]
        base = self.lat.base[self.kind[word]]
        who, rest = _walk(self.lat, self.seeds[live], sample, self.place[word], self.lat.source[edge[live]], step + 1, base)
        added = np.bincount(who, minlength=len(live))
        after = self.words[1:][live] - word - 1
        more = _spread(word + 1, after)
        count, fresh = _draw(self.lat, self.kind[more], np.repeat(self.seeds[live], after), sample, self.place[more])
        # edges of each word: the parent's before the choice, then the new ones
        per_word = np.zeros(len(self.kind), np.int64)
        before = word - self.words[:-1][live]
        old = _spread(self.words[:-1][live], before)
        per_word[old] = ends[np.repeat(parent[live], before), old + 1] - ends[np.repeat(parent[live], before), old]
        per_word[word] = step + 1 + added
        per_word[more] = count
        words = np.concatenate([[0], np.cumsum(per_word)])
        out = np.empty(int(words[-1]), np.int32)
        head = words[self.words[:-1]]
        out[_spread(head, kept)] = every[_spread(start + shift, kept)]
        out[head[live] + kept[live]] = edge[live]
        out[_spread(head[live] + kept[live] + 1, added)] = rest
        out[_spread(words[more], count)] = fresh
        return Paths(words, out)


def split(p: Pieces, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, rows, starts, lengths): the rows each after a space, and their words, which
    end where no piece of `p` holds the bytes on both sides; rows[i]:rows[i + 1] are those
    of row i.  An empty row has none."""
    count = np.diff(offsets)
    full = count > 0
    ends = np.cumsum(count + full)
    begin = ends - count - full
    text = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    text[_spread(begin + full, count)] = data[int(offsets[0]) : int(offsets[-1])]
    cut = np.ones(len(text), bool)
    cut[1:] = ~p.inside.ravel()[text[:-1].astype(np.int32) * 256 + text[1:]]
    cut[begin[full]] = True
    starts = np.flatnonzero(cut)
    lengths = np.diff(np.append(starts, len(text)))
    return text, np.searchsorted(starts, np.append(begin, len(text))), starts, lengths


def samples(known: Words, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, k: int):
    """For each of up to k samples: (rows that have it, piece ids, their offsets by those
    rows, log-probabilities, sums, log inclusion probabilities, whether the pieces spell
    the text)."""
    p = known.pieces
    text, rows, starts, lengths = split(p, data, offsets)
    kind = known.find(tx.Ranges(text, tx._VALUE_EXACT).hashes(starts, starts + lengths), text, starts, lengths)
    lat = known.lattices
    paths, peaks, limit = Sampler(lat, rows, kind, seeds).run(k)
    for path, peak in zip(paths, peaks, strict=True):
        bounds = path.words[rows]
        have = np.flatnonzero(np.isfinite(peak) & (np.diff(rows) > 0))
        # within a word the choices go from its end to its beginning
        size = np.diff(path.words)
        backward = np.repeat(path.words[:-1] + path.words[1:] - 1, size) - np.arange(len(path.edges))
        ids = lat.piece[path.edges[backward]].astype(np.int32)
        sums = np.concatenate([[0.0], np.cumsum(lat.logp[path.edges])])
        logp = (sums[bounds[1:]] - sums[bounds[:-1]])[have]
        ends = np.concatenate([[0], np.cumsum(p.size[ids])])
        spelt = p.decode(ids)
        ok = []
        for i in have:
            a, b = ends[bounds[i]], ends[bounds[i + 1]]
            ok.append(bool(np.array_equal(spelt[a + 1 : b], data[offsets[i] : offsets[i + 1]])))
        with np.errstate(over="ignore", divide="ignore"):
            gap = logp - limit[have]
            included = np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.clip(gap, -700, 700)))))
        yield have, ids, np.append(bounds[:-1][have], bounds[-1] if len(have) else 0), logp, peak[have], included, ok


def encode(docs: DataFrame, path: str, k: int = 3, theta: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sample, ids, log_prob, perturbed, log_inclusion, round_trip): up to k
    different segmentations of each row's whole text, sample 1 the largest perturbed
    log-probability.

    log_inclusion is the logarithm of the probability to be among the k given the next
    perturbed log-probability after them: log_prob - log_inclusion weighs a sample.
    round_trip says that decoding gives the text again, as it always should.  A null or
    empty text has one sample without ids, of log-probabilities 0.  A text with fewer than
    k segmentations has as many rows as it has.  Rows with null or repeated keys are each
    sampled; equal keys have the same random numbers.
    """
    schema = T.StructType(
        [docs.schema[key], T.StructField("sample", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), *(T.StructField(c, T.DoubleType()) for c in ("log_prob", "perturbed", "log_inclusion")), T.StructField("round_trip", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words(path, theta)
        for batch in batches:
            data, offsets = tx.buffers(batch.column(1))
            seeds = np.asarray(batch.column(2)).view(np.uint64)
            names = schema.names
            empty = np.flatnonzero(np.diff(offsets) == 0)
            if len(empty):
                n = len(empty)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(empty)), pa.array([1] * n, pa.int32()), pa.array([[]] * n, pa.list_(pa.int32())), *([pa.array([0.0] * n)] * 3), pa.array([True] * n)], names
                )
            for low, high in tx.slices(offsets, STEP_BYTES):
                for s, (have, ids, bounds, logp, peak, included, ok) in enumerate(samples(known, data, offsets[low : high + 1], seeds[low:high], k)):
                    if len(have):
                        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(low + have)), pa.array([s + 1] * len(have), pa.int32()), lists, pa.array(logp), pa.array(peak), pa.array(included), pa.array(ok)], names)
        tx.release()

    return docs.select(key, text, F.xxhash64(key).alias("_seed")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """`encoded` with a column `to`: the text that the piece ids spell, without the space
    that encoding puts before it.  Null ids give null, none the empty text; bytes that
    are no UTF-8 become replacement characters.  A column named `to` is replaced."""
    encoded = encoded.drop(to)
    at = encoded.columns.index(ids)
    schema = T.StructType([*encoded.schema.fields, T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(path, 1.0).bytes
        for batch in batches:
            texts = [None if row is None else b"".join(map(known.__getitem__, row))[1:].decode("utf-8", "replace") for row in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return encoded.mapInArrow(run, schema)

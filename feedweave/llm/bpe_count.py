"""Token counts by heap-and-linked-list byte-pair merging.

Each pre-token starts as a linked list of its byte symbols.  A heap holds the
adjacent pairs that have a merge rank; the lowest rank (leftmost on ties) is popped
and merged again and again.  The count is the number of symbols at the start less
the merges done; no identifiers are emitted.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pre-tokens whose counts a worker keeps at once; then it starts anew.
KEPT = 400_000
#: Longer pre-tokens are counted each time, so that what is kept stays small.
KEPT_LENGTH = 64
#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(shifted)}


class Counter:
    """Counts tokens as the tokenizer in a file does; one for each worker and file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or before != before | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or odd or spec["normalizer"]:
            raise ValueError(f"{path}: only plain byte-level BPE is counted")
        vocabulary = model["vocab"]
        symbols = _byte_symbols()
        self.first = [vocabulary[symbols[b]] for b in range(256)]
        self.ranks: dict[int, int] = {}  # left * 2^32 + right: rank
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocabulary[left] << 32 | vocabulary[right]] = rank
            self.made.append(vocabulary[left + right])
        special = [t["content"] for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: only plain special tokens are handled")
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = special
        self.split = regex.compile(PATTERN).findall
        self.wide = regex.compile(r" (?:\s|$)").search
        self.kept: dict[str, int] = {}
        self.spaced: dict[str, int] = {}  # by what follows a space

    def piece(self, text: str) -> int:
        """Tokens of one pre-token."""
        symbol = [self.first[b] for b in text.encode("utf-8")]
        n = len(symbol)
        rank_of, made_of = self.ranks.get, self.made
        # a heap entry is rank * 2^32 + position of the pair's left symbol
        heap = [r << 32 | i for i in range(n - 1) if (r := rank_of(symbol[i] << 32 | symbol[i + 1])) is not None]
        if not heap:
            return n
        if n == 2:
            return 1
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            top = heapq.heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if j >= n or symbol[i] < 0 or rank_of(symbol[i] << 32 | symbol[j]) != rank:
                continue  # one of the two is part of another merge by now
            merges += 1
            made = symbol[i] = made_of[rank]
            symbol[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(made << 32 | symbol[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank_of(symbol[h] << 32 | made)) is not None:
                heapq.heappush(heap, r << 32 | h)
        return n - merges

    def _piece(self, text: str) -> int:
        if (n := self.kept.get(text)) is None:
            n = self.piece(text)
            self._keep(text, n)
        return n

    def _keep(self, text: str, n: int) -> None:
        if len(text) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[text] = n

    def _plain(self, text: str) -> int:
        """No pre-token spans the place before a single space, so where each space has
        a visible character after it, a text is counted between the spaces."""
        if self.wide(text):
            return sum(map(self._piece, self.split(text)))
        first, *rest = text.split(" ")
        total = sum(map(self._piece, self.split(first)))
        kept = self.spaced
        try:
            return total + sum(map(kept.__getitem__, rest))
        except KeyError:
            pass
        for token in rest:
            if (n := kept.get(token)) is None:
                n = self.piece(" " + token) if token.isalpha() else sum(map(self._piece, self.split(" " + token)))
                if len(token) <= KEPT_LENGTH:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[token] = n
            total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; each special string in it is one."""
        if self.special is None or not any(m in text for m in self.marks):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """`key`, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of `docs`.

    path: the tokenizer's file on every executor.  A null or empty text has 0 bytes
    and 0 tokens.  Rows with null or repeated keys stay as they are.  Nothing is
    shuffled; memory is a batch of rows and the counts of KEPT pre-tokens.
    """
    schema = T.StructType([docs.select(key).schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            tokens = [count(x.as_py()) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["key", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(key, text).mapInArrow(run, schema)

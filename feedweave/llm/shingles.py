"""Shingle sets of texts, as sorted distinct 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from feedweave.llm import text as tx


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text's words; with fewer words, of all as one."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(size, n)
    out = tx.mix(hashes[: n - width + 1] + np.uint64(width))
    for k in range(1, width):
        out = tx.pair(out, hashes[k : n - width + 1 + k])
    return np.unique(out)


def per_row(docs: DataFrame, size: int, schema: str, make) -> DataFrame:
    """`make` of the shingle set of each text, after the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.buffers(batch.column(1))
            for low, high in tx.slices(offsets):
                w = tx.words(data, offsets[low : high + 1])
                sets = [shingles(w.hashes[a:b], size) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
                columns = make(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *columns], [str(i) for i in range(len(columns) + 1)])

    return docs.mapInArrow(run, schema)

"""Near-duplicate documents by one-permutation hashing with optimal densification.

A document's set is its distinct word shingles.  One hash of each shingle, split into
bins, gives the signature; an empty bin borrows from a bin that a second hash names,
trying until it finds a full one.  Bands of bins are bucket keys.  Copies of a set are
one node.  Each bucket is joined to one hub only, the member that meets most others
over all buckets, so a bucket of n nodes has n - 1 candidate pairs and not n^2.  Every
candidate is confirmed on the full sets.  Members of a bucket that are in different
components after that, whichever hubs they met, are compared with each other by the exact
join of llm.ngram_join, so no link between members of a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.llm import text as tx
from feedweave.llm.ngram_join import linked
from feedweave.llm.session import cut, release
from feedweave.llm.shingles import per_row
from feedweave.operators.components import components

BANDS, ROWS = 32, 6
BINS = BANDS * ROWS
_TRIES = 4096


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Least hash of each bin, and the bins that an empty bin tries in turn."""
    least = np.array([-(-(k << 64) // BINS) for k in range(1, BINS)], np.uint64)
    return least, np.random.default_rng(11).integers(0, BINS, (_TRIES, BINS), dtype=np.int16)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Band keys of a non-empty sorted set of hashes."""
    least, tries = _tables()
    cuts = np.concatenate([[0], np.searchsorted(hashes, least), [len(hashes)]])
    full = cuts[1:] > cuts[:-1]
    bins = np.zeros(BINS, np.uint64)
    bins[full] = hashes[cuts[:-1][full]]
    empty = np.flatnonzero(~full)
    for row in tries:
        if not len(empty):
            break
        got = row[empty]
        hit = full[got]
        bins[empty[hit]] = bins[got[hit]]
        empty = empty[~hit]
    bins[empty] = hashes[0]
    parts = bins.reshape(BANDS, ROWS)
    key = tx.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1))
    for k in range(ROWS):
        key = tx.pair(key, parts[:, k])
    return key


def _signed(sets: list[np.ndarray]) -> list[pa.Array]:
    one, two = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
    sums = [(tx.mix(s ^ one).sum(), tx.mix(s ^ two).sum()) for s in sets]
    prints = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
    bands = [signature(s).view(np.int64) if len(s) else None for s in sets]
    return [pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(bands, pa.list_(pa.int64()))]


def _confirm(pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= threshold * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= threshold * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _across(sets: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """All pairs (a, b) of `members` (node) with 100 * intersection >= threshold * union, or a forest over
    them: the exact join by pivots' regions of llm.ngram_join, which lists no pairs."""
    own = cut(sets.join(members, sets["id"] == members["node"], "left_semi").distinct().withColumn("cid", F.xxhash64("id", "words")))
    rows = own.select("cid", F.expr("length(words) div 8").cast("long").alias("n"), F.lit(1).cast("long").alias("copies"), "words")
    edges = linked(rows, threshold).where("b is not null").select("a", "b")
    name = lambda side: own.select(F.col("cid").alias(side), F.col("id").alias(f"{side}_id"))
    return edges.join(name("a"), "a").join(name("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).where("a <> b")


def near_duplicates(docs: DataFrame, size: int = 2, threshold: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row of `docs`.

    Documents are linked where 100 * |A and B| >= threshold * |A or B| for their sets of
    shingles of `size` words.  component_id is the smallest key that links reach, kept
    says that it is the row's own.  A null or empty text, or one without words, has
    n_shingles 0 and is linked with nothing.  A row with a null key is in no component:
    component_id null, kept true.  Rows with the same key and the same words are kept
    together.  A similarity at the threshold shares a bucket with probability
    1 - (1 - 0.8^6)^32 > 0.9999.
    """
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = cut(per_row(docs, size, "id long, n long, f1 long, f2 long, bands array<long>", _signed))
    nodes = signed.where("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min("id").alias("node"), F.any_value("bands").alias("bands"))
    nodes = cut(nodes)
    entries = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    open_rows = cut(entries.join(shared, "bucket").select("bucket", "node", "n", "members"))
    met = open_rows.groupBy("node").agg(F.sum("members").alias("met"))
    open_rows = cut(open_rows.join(met, "node").select("bucket", "node", "n", "met"))
    # the sets of the nodes that share a bucket, made once for all rounds; the texts are always
    # dealt out by id here, whatever the number of these nodes
    wanted = open_rows.select(F.col("node").alias("id")).distinct().hint("merge")
    sets = per_row(docs.join(wanted, "id", "left_semi"), size, "id long, words binary", lambda sets: [pa.array([s.tobytes() for s in sets], pa.binary())])
    sets = cut(sets.where("length(words) > 0"))
    links = labels = None

    def confirmed(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("words").alias("words_a")), "a")
        with_both = with_a.join(sets.select(F.col("id").alias("b"), F.col("words").alias("words_b")), "b").select("a", "b", "words_a", "words_b")
        return cut(_confirm(with_both, threshold).distinct())

    # stars: every node of a bucket is compared with the bucket's hub
    best = F.struct(F.col("met"), (-F.col("node")).alias("order"), F.col("n").alias("hub_n"))
    hubs = open_rows.groupBy("bucket").agg(F.max(best).alias("hub"))
    starred = open_rows.join(hubs, "bucket").select("bucket", "node", "n", (-F.col("hub.order")).alias("hub"), F.col("hub.hub_n").alias("hub_n"))
    pairs = cut(starred.where(f"node <> hub and 100 * least(n, hub_n) >= {threshold} * greatest(n, hub_n)").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    if not pairs.isEmpty():
        links = confirmed(pairs)
        labels = None if links.isEmpty() else components(links)
        release(docs.sparkSession)
    own_label = F.col("node") if labels is None else F.coalesce("component", "node")
    known = (open_rows if labels is None else open_rows.join(labels, "node", "left")).select("bucket", "node", "n", own_label.alias("component"))
    # members of a bucket that are of like size and in different components
    step = max(log(100 / threshold) * (1 + 1e-9), 1e-6)
    sized = known.withColumn("size", F.floor(F.log("n") / step)).withColumn("size", F.explode(F.array("size", F.col("size") + 1)))
    parted = sized.groupBy("bucket", "size").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    members = cut(sized.join(parted, ["bucket", "size"], "left_semi").select("node").distinct())
    if not members.isEmpty():
        found = cut(_across(sets, members, threshold))
        release(docs.sparkSession)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = components(links)
        release(docs.sparkSession)
    classes = nodes.select("n", "f1", "f2", "node")
    if labels is not None:
        classes = classes.join(labels, "node", "left").select("n", "f1", "f2", F.coalesce("component", "node").alias("component"))
    else:
        classes = classes.withColumnRenamed("node", "component")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id"))
    out = signed.drop("bands").join(classes, ["n", "f1", "f2"], "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, size: int = 5, threshold: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document of each component: the smallest key.  Of rows with that
    key the columns stay as they are; rows with null keys stay."""
    kept = near_duplicates(docs, size, threshold, key, text).where("kept").select(F.col(key).alias("_kept")).distinct()
    return docs.join(kept, docs[key].eqNullSafe(kept["_kept"]), "left_semi")


#: `near_duplicates` over the table `documents` with two words and 80, for DuckDB; keys there are unique.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n + b.n) AS n FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * c >= 80 * (n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""

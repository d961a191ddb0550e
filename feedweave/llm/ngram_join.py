"""Exact similarity join of documents on word n-grams, in the metric space of the Jaccard distance.

Documents with equal sets are one class.  The join works on classes:

1. Two sets whose similarity is at least t have k of the first n - ceil(t n) + k shingles of
   each in common, in any order that holds for both.  A class is at a larger distance from all
   others, and leaves, unless it shares k = 1 + n / 20 of its prefix by hash with any, and then
   t n shingles in all and one of its prefix by rarity.
2. Each shared prefix shingle elects a pivot among the classes that hold it and are of about
   the same size.  A class is a member of the region of every pivot that it meets in this way,
   so that the ends of each link are in one region at least.
3. A region of more members than a task should hold is divided: pivots are drawn from it, each
   member that the region answers for (inner) goes to the Voronoi cell of its nearest pivot,
   and every member is copied to the cells whose pivot is at most two thresholds farther than
   its nearest one.  By the triangle inequality the partners of a cell's inner members are in
   the cell.  Cells are regions of the next round.
4. A region that pivots don't part (all members about equally far from each other) is joined by
   pairs of blocks of its members, so that a task holds two blocks, whatever the region's size.
5. Within a leaf, intersections of all sets are one product of 0/1 matrices, a strip of columns
   at a time.  It yields links a class, counted in the smallest region that both ends share,
   and the edges of a forest over the linked members; links themselves are never listed.

Shingles are compared by hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedweave.llm import text as tx
from feedweave.llm.session import cut, release
from feedweave.llm.shingles import per_row
from feedweave.operators.components import components

#: Members, and shingles of all members, of one leaf or block.
LEAF, WEIGHT = 512, 4_000_000
#: Pivots drawn from a region that is divided.
PIVOTS = 16
_STRIP = 4096
_ROW = "region long, path long, cid long, n long, copies long, own boolean, inner boolean, mine array<long>, words binary"


def _prefixed(threshold: int):
    def make(sets: list[np.ndarray]) -> list[pa.Array]:
        prefix = [s[: len(s) - -(-threshold * len(s) // 100) + 1 + len(s) // 20].view(np.int64) if len(s) else None for s in sets]
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array(_class_ids(sets), pa.int64()), pa.array(prefix, pa.list_(pa.int64()))]

    return make


def _class_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A number for each set, equal for equal sets."""
    sums = np.array([tx.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum() if len(s) else 0 for s in sets], np.uint64)
    return tx.pair(sums, np.array([len(s) for s in sets], np.uint64)).view(np.int64)


def _with_words(sets: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(_class_ids(sets), pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, shingle) of the rows (cid, n, words), some half a million at a time."""
    for batch in batches:
        sets = _sets(batch.column(2))
        ids, n = (batch.column(k).to_numpy() for k in (0, 1))
        ends, low = np.cumsum(n), 0
        while low < len(sets):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] - n[low] + 500_000, "right")))
            columns = [np.repeat(ids[low:high], n[low:high]), np.concatenate(sets[low:high]).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cid", "shingle"])
            low = high


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _common(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of each set in `left` with each in `right`, or in `left`."""
    both = left if right is None else left + right
    lengths = [len(s) for s in both]
    out = np.zeros((len(left), len(left) if right is None else len(right)), np.int64)
    if not sum(lengths):
        return out
    _, column, held = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), lengths)
    shared = held > 1
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(shared.sum()), _STRIP):
        a, b = np.searchsorted(column, (low, low + _STRIP))
        width = min(_STRIP, int(column[b - 1]) - low + 1)
        ones = np.zeros((len(both), width), np.float32)
        ones[row[a:b], column[a:b] - low] = 1
        out += np.rint(ones[: len(left)] @ (ones if right is None else ones[len(left) :]).T).astype(np.int64)
    return out


def _forest(linked: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what `linked` (rows `a`, columns `b` or `a`) connects."""
    most = np.iinfo(np.int64).max
    la, lb = a.copy(), a if b is None else b.copy()
    while True:
        na = np.minimum(la, np.where(linked, lb, most).min(1))
        nb = na if b is None else np.minimum(lb, np.where(linked, na[:, None], most).min(0))
        if np.array_equal(na, la) and (b is None or np.array_equal(nb, lb)):
            break
        la, lb = na, nb
    ids, labels = (a, la) if b is None else (np.concatenate([a, b]), np.concatenate([la, lb]))
    return ids[ids != labels], labels[ids != labels]


def _leaf(rows: pa.RecordBatch, threshold: int) -> pa.RecordBatch:
    """(a, b, links) of one leaf: edges, and links a class with b null."""
    region, i, j = (rows.column(c)[0].as_py() for c in ("region", "i", "j"))
    block, sets = rows.column("block").to_numpy(), _sets(rows.column("words"))
    mine = [np.array([r for r in x if r < region], np.int64) for x in rows.column("mine").to_pylist()]
    cid, n, copies = (rows.column(c).to_numpy() for c in ("cid", "n", "copies"))
    own, inner = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("own", "inner"))
    one = np.flatnonzero(block == i)
    two = one if i == j else np.flatnonzero(block == j)
    pick = lambda values, at: [values[k] for k in at]
    right = None if i == j else two
    common = _common(pick(sets, one), None if right is None else pick(sets, two))
    linked = 100 * common >= threshold * (n[one][:, None] + n[two] - common)
    linked &= own[one][:, None] | own[two]
    linked &= _common(pick(mine, one), None if right is None else pick(mine, two)) == 0
    if right is None:
        np.fill_diagonal(linked, False)
    a, b = _forest(linked, cid[one], None if right is None else cid[two])
    counts, ids = [(linked @ copies[two])[inner[one]]], [cid[one][inner[one]]]
    if right is not None:
        counts.append((linked.T @ copies[one])[inner[two]])
        ids.append(cid[two][inner[two]])
    counts, ids = np.concatenate(counts).astype(np.int64), np.concatenate(ids)
    ids, counts = ids[counts > 0], counts[counts > 0]
    none = len(a)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([a, ids])),
            pa.array(np.concatenate([b, ids]), mask=np.arange(none + len(ids)) >= none),
            pa.array(np.concatenate([b, counts]), mask=np.arange(none + len(ids)) < none),
        ],
        ["a", "b", "links"],
    )


def _leaves(threshold: int):
    """`_leaf` of each run of rows of one leaf; a leaf that a batch ends in waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if kept is None else pa.concat_batches([kept, batch])
            keys = np.stack([rows.column(c).to_numpy() for c in ("region", "path", "i", "j")])
            starts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1])
            for low, high in zip(starts[:-1], starts[1:], strict=True):
                yield _leaf(rows.slice(low, high - low), threshold)
            kept = rows.slice(starts[-1])
        if kept is not None:
            yield _leaf(kept, threshold)

    return run


def _cells(threshold: int):
    """(region, path, cid, cell, inner): the cells of some members of a region, by its pivots."""
    reach = 2 * (1 - threshold / 100) + 1e-9

    def run(key, members: pa.Table, pivots: pa.Table) -> pa.Table:
        schema = pa.schema([("region", pa.int64()), ("path", pa.int64()), ("cid", pa.int64()), ("cell", pa.int64()), ("inner", pa.bool_())])
        if not len(members) or not len(pivots):
            return schema.empty_table()
        members, pivots = members.combine_chunks(), pivots.sort_by("cid").combine_chunks()
        common = _common(_sets(members.column("words")), _sets(pivots.column("words")))
        n, size = members.column("n").to_numpy(), pivots.column("n").to_numpy()
        far = 1 - common / (n[:, None] + size - common)
        nearest = far.argmin(1)
        row, cell = np.nonzero(far <= far.min(1)[:, None] + reach)
        inner = (nearest[row] == cell) & members.column("inner").to_numpy()[row]
        ids = pivots.column("cid").to_numpy()[cell]
        same = [np.full(len(row), members.column(c)[0].as_py()) for c in ("region", "path")]
        return pa.Table.from_arrays([pa.array(c) for c in (*same, members.column("cid").to_numpy()[row], ids, inner)], schema=schema)

    return run


def _sized(rows: DataFrame, leaf: int) -> DataFrame:
    """(region, path, members, inside, parts): parts is 1 for a leaf."""
    sizes = rows.groupBy("region", "path").agg(F.count("*").alias("members"), F.sum(F.col("inner").cast("long")).alias("inside"), F.sum("n").alias("weight"))
    parts = F.ceil(F.greatest(F.col("members") / leaf, F.col("weight") / WEIGHT)).cast("int")
    return sizes.where("inside > 0 and members > 1").withColumn("parts", parts).drop("weight")


def _divided(rows: DataFrame, threshold: int, leaf: int, places: int) -> DataFrame:
    """Rows (region, path, i, j, block, ...) of leaves, whose partners are in the same leaf."""
    done, keys = [], ["region", "path"]
    while True:
        rows = cut(rows.join(_sized(rows, leaf), keys))
        large = rows.where("parts > 1")
        done.append(rows.where("parts = 1").select(*keys, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"), "cid", "n", "copies", "own", "inner", "mine", "words"))
        if large.isEmpty():
            break
        # as many pivots as are drawn by hash, every one sent to the parts of its region
        drawn = large.where(f"inner and pmod(xxhash64(cid, path, 5), members) < {PIVOTS}")
        dealt = large.withColumn("part", F.pmod(F.xxhash64("cid", F.lit(3)), F.col("parts")).cast("int"))
        sent = drawn.select(*keys, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cid", "n", "words")
        by = [*keys, "part"]
        cells = dealt.select(*by, "cid", "n", "inner", "words").groupBy(*by).cogroup(sent.groupBy(*by))
        cells = cut(cells.applyInArrow(_cells(threshold), "region long, path long, cid long, cell long, inner boolean"))
        cost = cells.groupBy(*keys, "cell").agg(F.sum(F.col("inner").cast("double")).alias("inside"), F.count("*").alias("all"))
        cost = cost.groupBy(*keys).agg(F.sum(F.col("inside") * F.col("all")).alias("cost"))
        # cells pay where they halve the comparisons at least
        parted = large.select(*keys, "members", "inside").distinct().join(cost, keys).where("2 * cost <= inside * members").select(*keys)
        whole = large.join(parted, keys, "left_anti")
        spread = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
        whole = whole.withColumn("block", F.pmod(F.xxhash64("cid", F.lit(3)), F.col("parts")).cast("int")).withColumn("at", F.explode(spread))
        done.append(whole.select(*keys, "at.i", "at.j", "block", "cid", "n", "copies", "own", "inner", "mine", "words"))
        moved = cells.join(parted, keys, "left_semi").withColumnRenamed("inner", "within")
        rows = large.join(moved, [*keys, "cid"]).withColumn("path", F.xxhash64("path", "cell")).select(*keys, "cid", "n", "copies", "own", F.col("within").alias("inner"), "mine", "words")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.repartition(places, "region", "path", "i", "j").sortWithinPartitions("region", "path", "i", "j")


def linked(sets: DataFrame, threshold: int, leaf: int = LEAF) -> DataFrame:
    """(a, b, links) of sets (cid, n, copies, words), whose cids are distinct: rows with b null hold the
    number of rows that a is linked with, other than its own; the others are edges that connect all
    that links connect."""
    spark, t = sets.sparkSession, threshold
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sets.select("cid", "n", "words").mapInArrow(_shingle_rows, "cid long, shingle long")
    rows = rows.join(rows.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1"), "shingle").join(sets.select("cid", "n"), "cid")
    by_set = Window.partitionBy("cid", "n")
    rows = rows.withColumn("sharing", F.count("*").over(by_set)).withColumn("place", F.col("n") - F.col("sharing") + F.row_number().over(by_set.orderBy("held", "shingle")))
    rows = rows.where(f"100 * sharing >= {t} * n and place <= n - ({t} * n + 99) div 100 + 1")
    # linked sets differ by one size class at most
    step = max(log(100 / t) * (1 + 1e-9), 1e-6)
    rows = cut(rows.select("shingle", "cid", F.floor(F.log("n") / step).cast("int").alias("class")))
    release(spark)
    rows = rows.withColumn("size", F.explode(F.array(F.col("class"), F.col("class") + 1))).withColumn("own", F.col("class") == F.col("size"))
    pivots = rows.groupBy("shingle", "size").agg(F.min("cid").alias("pivot"), F.count("*").alias("held"), F.max("own").alias("any")).where("held > 1 and any")
    met = cut(rows.join(pivots, ["shingle", "size"]).select("cid", "size", "own", F.xxhash64("pivot", "size").alias("region")).distinct())
    mine = met.groupBy("cid", "size").agg(F.collect_list("region").alias("mine"))
    members = met.join(mine, ["cid", "size"]).join(sets, "cid")
    members = members.select("region", F.lit(0).cast("long").alias("path"), "cid", "n", "copies", "own", F.lit(True).alias("inner"), "mine", "words")
    found = cut(_divided(members, t, leaf, places).mapInArrow(_leaves(t), "a long, b long, links long"))
    release(spark)
    return found


def similar(docs: DataFrame, size: int = 4, threshold: int = 85, key: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """(key, n_shingles, component_id, n_links) of each row of `docs`.

    Documents are linked where 100 * |A and B| >= threshold * |A or B| for their sets of
    shingles of `size` words.  component_id is the smallest key that links reach, n_links the
    number of other rows that the row is linked with.  A null or empty text, or one without
    words, has n_shingles 0 and is linked with nothing.  A row with a null key is linked with
    nothing and has a null component_id.  Repeated rows are linked with each other; rows of one
    key with different texts are documents of their own that have the same name.
    """
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    spark, t = docs.sparkSession, threshold
    signed = cut(per_row(docs, size, "id long, n long, cid long, prefix array<long>", _prefixed(t)))
    known = signed.where("n > 0 and id is not null").groupBy("cid", "n").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("prefix").alias("prefix"))
    entries = known.select("cid", F.explode("prefix").alias("shingle"))
    shared = entries.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1").select("shingle")
    sharing, classes = cut(entries.join(shared, "shingle").groupBy("cid").agg(F.count("*").alias("sharing"))), cut(known.drop("prefix"))
    signed = cut(signed.drop("prefix"))
    del known, entries, shared
    release(spark)
    wanted = cut(classes.join(sharing, "cid").where("sharing > n div 20").select("cid", "id", "n", "copies"))
    # sets of the classes that may have partners; texts are dealt out by id, whatever their number
    texts = docs.join(wanted.select("id").distinct().hint("merge"), "id", "left_semi")
    sets = per_row(texts, size, "id long, cid long, n long, words binary", _with_words)
    sets = cut(sets.drop("n").join(wanted.drop("id"), "cid").dropDuplicates(["cid"]).select("cid", "n", "copies", "words"))
    del texts
    release(spark)
    found = linked(sets, t, leaf)
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    labels = components(found.where("b is not null").select("a", "b"))
    named = classes.select("cid", "id", "copies").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    first = named.groupBy("component").agg(F.min("id").alias("first"))
    named = named.join(first, "component").join(counts, "cid", "left").select("cid", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    alone = F.col("id").isNull() | (F.col("n") == 0)
    named = signed.withColumn("cid", F.when(~alone, F.col("cid"))).select("id", "n", "cid").join(named, "cid", "left")
    return named.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("first", "id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


#: `similar` over the table `documents` with four words and 85, for DuckDB; keys there are unique.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n + b.n) AS n FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * c >= 85 * (n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, (SELECT count(*) FROM e WHERE e.x = s.doc_id) AS n_links FROM s JOIN c USING (doc_id)
"""

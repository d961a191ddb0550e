"""The trie of conversation prefixes: how many conversations begin alike, and what sharing would save.

Turns are put in order over all tasks (by ranges of conversation and turn), and a numpy scan of
each range gives the rolling polynomial fingerprint of the turns up to each; what ranges before
it hold of the same conversation is added by a row a range, so a conversation of any length
is spread.  The fingerprint modulo a prime of p turns put after q others is a product and a sum,
so a rebuilt conversation (another's head, then its own rest) needs no scan of its own.

Prefixes of one depth and fingerprint are candidates for one node.  Every member of a candidate
is compared with its representative, the smallest conversation: the role and text of the turn,
and the node of the prefix before it.  As this is done at every depth, members that agree have
equal prefixes from the first turn on.  Those that differ are split off by a hash of what
they differ in, with all that follows them, and the groups are compared again until all agree.

Sums over subtrees are rolled up by doubling: each round adds what nodes hold to the ancestor
1, 2, 4, ... levels above, so a trie of depth d takes log d rounds.  Prefixes of a single
conversation are chains whose sums are known; they take no part in the rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.llm.session import cut
from feedweave.operators.components import spread_join

#: Primes below 2^31 and a base for each: products fit in 64 bits.
MODULI, BASES = (2_147_483_647, 2_147_483_629), (911_382_323, 972_663_749)
#: Conversations c and c - c % GROUP share a head of crc32(c) % HEADS turns.
GROUP, HEADS = 5, 9
_PIECE = 1 << 16
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _power(base: int, exponents: np.ndarray, modulus: int) -> np.ndarray:
    """base ** exponents % modulus, by squaring."""
    out, left, square = np.ones(len(exponents), np.int64), exponents.copy(), base % modulus
    while left.any():
        out = np.where(left & 1, out * square % modulus, out)
        left >>= 1
        square = square * square % modulus
    return out


def _scan(moduli: tuple[int, int]):
    """(conv, part, at, e1, e2, i1, i2, bytes, role, text) of sorted rows (conv, part, v, bytes, role,
    text): the place in the conversation's run of this part, and the fingerprints of the run's turns
    before it and up to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place, sums = None, 0, [0, 0]
        for batch in batches:
            if not len(batch):
                continue
            conv, v = (batch.column(c).to_numpy() for c in ("conv", "v"))
            starts = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
            counts = np.diff(np.append(starts, len(conv)))
            at = np.arange(len(conv)) - np.repeat(starts, counts)
            goes_on = conv[0] == last
            if goes_on:
                at[: counts[0]] += place
            before, upto = [], []
            for k, p in enumerate(moduli):
                term = ((v >> (31 * k)) & 0x7FFFFFFF) % p * _power(BASES[k], at, p) % p
                total = np.cumsum(term)
                base = np.repeat((total - term)[starts], counts)
                if goes_on:
                    base[: counts[0]] -= sums[k]
                upto.append((total - base) % p)
                before.append((total - term - base) % p)
            last, place, sums = conv[-1], int(at[-1]) + 1, [int(u[-1]) for u in upto]
            columns = [batch.column("conv"), batch.column("part"), *(pa.array(c) for c in (at, *before, *upto)), *(batch.column(c) for c in ("bytes", "role", "text"))]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "part", "at", "e1", "e2", "i1", "i2", "bytes", "role", "text"])

    return run


def _weighed(moduli: tuple[int, int]):
    """Runs (conv, part, start, s1, s2) with the powers w1 and w2 that move them to their start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = batch.column("start").to_numpy()
            powers = [pa.array(_power(BASES[k], start, p)) for k, p in enumerate(moduli)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *powers], [*batch.schema.names, "w1", "w2"])

    return run


def _in_order(conversations: DataFrame, names: tuple[str, str, str, str], moduli: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, part, at, pos, e1, e2, i1, i2, bytes) and their texts (conv, part, at, role, text)."""
    key, turn, role, text = names
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col(key).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), empty(role).alias("role"), empty(text).alias("text")).where("conv is not null")
    places = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the ranges' samples hold beginnings of texts only
    ranged = turns.withColumn("start", F.substring("text", 1, 64)).repartitionByRange(places, "conv", "turn", "role", "start").sortWithinPartitions("conv", "turn", "role", "text")
    ranged = ranged.select("conv", F.spark_partition_id().alias("part"), F.xxhash64("role", "text").alias("v"), F.octet_length("text").cast("long").alias("bytes"), "role", "text")
    scanned = cut(ranged.mapInArrow(_scan(moduli), "conv long, part int, at long, e1 long, e2 long, i1 long, i2 long, bytes long, role string, text string"))
    runs = scanned.groupBy("conv", "part").agg(F.count("*").alias("n"), F.max_by("i1", "at").alias("s1"), F.max_by("i2", "at").alias("s2"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "s1", "s2")
    runs = runs.mapInArrow(_weighed(moduli), "conv long, part int, start long, s1 long, s2 long, w1 long, w2 long")
    offsets = [(F.coalesce(F.sum(F.col(f"w{k}") * F.col(f"s{k}") % p).over(before), F.lit(0)) % p).alias(f"o{k}") for k, p in enumerate(moduli, 1)]
    runs = runs.select("conv", "part", "start", "w1", "w2", *offsets)
    moved = lambda c, k: ((F.col(f"o{k}") + F.col(f"w{k}") * F.col(f"{c}{k}")) % moduli[k - 1]).alias(f"{c}{k}")
    placed = scanned.drop("role", "text").join(runs, ["conv", "part"])
    placed = placed.select("conv", "part", "at", (F.col("start") + F.col("at")).alias("pos"), *(moved(c, k) for c in "ei" for k in (1, 2)), "bytes")
    return cut(placed), scanned.select("conv", "part", "at", "role", "text")


def _rebuilt(placed: DataFrame, moduli: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Prefixes (conv, depth, f, prev, bytes, last, source, part, at) of the rebuilt conversations,
    and (conv, length) of all.  The source's turn (part, at) is that at the prefix's end."""
    convs = placed.groupBy("conv").agg(F.count("*").alias("len"))
    base = F.col("conv") - F.col("conv") % GROUP
    head = F.when(base == F.col("conv"), 0).otherwise(F.crc32(F.col("conv").cast("string")) % HEADS).cast("long")
    convs = convs.select("conv", "len", base.alias("base"), head.alias("h"))
    lengths = convs.select(F.col("conv").alias("base"), F.col("len").alias("base_len"))
    convs = convs.join(lengths, "base", "left").withColumn("k", F.least("h", F.coalesce("base_len", F.lit(0))))
    heads = placed.where(F.col("pos") < HEADS - 1)
    at = lambda name, to, x: heads.select(F.col("conv").alias(name), (F.col("pos") + 1).alias(to), *(F.col(f"i{j}").alias(f"{x}{j}") for j in (1, 2)))
    convs = convs.join(at("conv", "h", "g"), ["conv", "h"], "left").join(at("base", "k", "b"), ["base", "k"], "left")
    convs = cut(convs.select("conv", "base", "h", "k", (F.col("k") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("length"), *(F.coalesce(f"{x}{j}", F.lit(0)).alias(f"{x}{j}") for x in "gb" for j in (1, 2))))

    def print_of(one: Column, two: Column) -> Column:
        return one * F.lit(1 << 31) + two

    def after_head(c: str) -> Column:
        parts = []
        for j, p in enumerate(moduli, 1):
            back = F.element_at(F.array(*(F.lit(pow(BASES[j - 1], -d, p)) for d in range(HEADS))), (F.col("h") - F.col("k") + 1).cast("int"))
            parts.append((F.col(f"b{j}") + back * F.pmod(F.col(f"{c}{j}") - F.col(f"g{j}"), F.lit(p))) % p)
        return print_of(*parts)

    own = placed.join(convs, "conv").where("pos >= h").withColumn("depth", F.expr("pos - h + k + 1"))
    own = own.select("conv", "depth", after_head("i").alias("f"), after_head("e").alias("prev"), "bytes", (F.col("depth") == F.col("length")).alias("last"), F.col("conv").alias("source"), "part", "at")
    taken = heads.withColumnRenamed("conv", "source").join(convs.select("conv", F.col("base").alias("source"), "k", "length"), "source").where("pos < k").withColumn("depth", F.col("pos") + 1)
    taken = taken.select("conv", "depth", print_of(F.col("i1"), F.col("i2")).alias("f"), print_of(F.col("e1"), F.col("e2")).alias("prev"), "bytes", (F.col("depth") == F.col("length")).alias("last"), "source", "part", "at")
    return cut(own.unionByName(taken)), convs.select("conv", "length")


def _verified(prefixes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prefixes, and nodes (depth, f, n_convs, conv_id, prev, bytes): equal prefixes have
    equal (depth, f), and others don't."""
    turn = ["source", "part", "at"]
    texts = texts.withColumnRenamed("conv", "source")
    while True:
        nodes = cut(prefixes.groupBy("depth", "f").agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.min_by("prev", "conv").alias("prev"), F.min_by("bytes", "conv").alias("bytes")))
        members = prefixes.join(nodes.where("n_convs > 1").select("depth", "f", "conv_id"), ["depth", "f"]).join(texts, turn)
        shown = members.where("conv = conv_id").select("depth", "f", *(F.col(c).alias(f"{c}_1") for c in ("prev", "role", "text")))
        differs = " or ".join(f"{c} <> {c}_1" for c in ("prev", "role", "text"))
        apart = members.where("conv <> conv_id").join(shown, ["depth", "f"]).where(differs)
        apart = cut(apart.groupBy("conv").agg(F.min(F.struct("depth", F.xxhash64("depth", "f", "prev", "role", "text").alias("salt"))).alias("first")).select("conv", "first.depth", "first.salt"))
        if apart.isEmpty():
            return prefixes, nodes
        split = prefixes.join(apart.withColumnRenamed("depth", "from"), "conv", "left")
        changed = lambda c, deep: F.when(deep, F.col(c).bitwiseXOR(F.col("salt"))).otherwise(F.col(c)).alias(c)
        prefixes = cut(split.select("conv", "depth", changed("f", F.col("depth") >= F.col("from")), changed("prev", F.col("depth") > F.col("from")), "bytes", "last", *turn))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, f, first, ids) of sorted rows (depth, f, conv): keys of a node in decimal, joined by
    commas, some thousands a row."""
    for batch in batches:
        if not len(batch):
            continue
        depth, f, conv = (batch.column(c).to_numpy() for c in ("depth", "f", "conv"))
        cuts = np.flatnonzero((depth[1:] != depth[:-1]) | (f[1:] != f[:-1])) + 1
        bounds = np.unique(np.concatenate([[0], cuts, np.arange(0, len(conv), _PIECE), [len(conv)]]))
        ids = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        first = bounds[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(depth[first]), pa.array(f[first]), pa.array(conv[first]), pa.array(ids, pa.string())], ["depth", "f", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, f, ends_sha256) of sorted pieces; a node's keys are hashed as they come."""
    node, state = None, None
    done: list[tuple[int, int, str]] = []
    for batch in batches:
        for depth, f, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "f", "ids")), strict=True):
            if (depth, f) == node:
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((*node, state.hexdigest()))
            node, state = (depth, f), hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["depth", "f", "ends_sha256"])
            done = []
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], ["depth", "f", "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, f, ends_sha256) of rows (depth, f, conv): the digest of each node's keys in
    ascending order.  Only a node's digest itself is made in one task, from strings of keys."""
    places = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.repartitionByRange(places, "depth", "f", "conv").sortWithinPartitions("depth", "f", "conv").mapInArrow(_pieces, "depth long, f long, first long, ids string")
    return pieces.repartition(places, "depth", "f").sortWithinPartitions("depth", "f", "first").mapInArrow(_digests, "depth long, f long, ends_sha256 string")


def _rolled_up(tree: DataFrame) -> DataFrame:
    """(depth, f, saved, leaves) summed over subtrees, of (depth, f, prev, saved, leaves)."""
    state = cut(tree.select("depth", "f", F.col("prev").alias("up"), "saved", "leaves"))
    most, step = state.agg(F.max("depth").alias("most")).first()["most"] or 0, 1
    while step <= most:
        above = state.where(F.col("depth") >= step).groupBy((F.col("depth") - step).alias("depth"), F.col("up").alias("f")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        further = state.where(F.col("depth") >= step).select((F.col("depth") + step).alias("depth"), F.col("f").alias("up"), F.col("up").alias("next"))
        summed = state.join(above, ["depth", "f"], "left").join(further, ["depth", "up"], "left")
        state = cut(summed.select("depth", "f", F.col("next").alias("up"), *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("saved", "leaves"))))
        step *= 2
    return state.drop("up")


def trie(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", moduli: tuple[int, int] = MODULI) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations, the empty one included.

    Turns are in order of turn, null first, then role and text; null roles and texts are empty and
    repeated rows are turns of their own.  Conversation c is rebuilt as the first h turns of
    c - c % 5 and its own turns after its first h, h = crc32(c) % 9.  Rows with a null key are no
    conversation; a table without conversations has no nodes.  conv_id is the smallest member,
    parent_conv_id that of the prefix that is a turn shorter, saved_tokens the bytes of last turns
    that members of the subtree's nodes share with another, and ends_sha256 the digest of the
    members that have no further turn.
    """
    placed, texts = _in_order(conversations, (key, turn, role, text), moduli)
    prefixes, convs = _rebuilt(placed, moduli)
    prefixes, nodes = _verified(prefixes, texts)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("f"), "n_convs", "conv_id", F.lit(None).cast("long").alias("prev"), zero.alias("bytes"))
    kids = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("prev").alias("f")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("chains"))
    every = cut(nodes.unionByName(root).join(kids, ["depth", "f"], "left").na.fill(0, ["n_children", "chains"]))
    shared = every.where("n_convs > 1 or depth = 0")
    own_leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    sums = _rolled_up(shared.select("depth", "f", "prev", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), (F.col("chains") + own_leaf).alias("leaves")))
    ends = prefixes.where("last").join(shared.select("depth", "f"), ["depth", "f"], "left_semi").select("depth", "f", "conv")
    ends = ends_digest(ends.unionByName(convs.where("length = 0").select(zero.alias("depth"), zero.alias("f"), "conv")))
    found = every.join(sums, ["depth", "f"], "left").join(ends, ["depth", "f"], "left")
    # a chain's last prefix is that of its one conversation's end
    alone = F.when((F.col("depth") > 0) & (F.col("n_convs") == 1) & (F.col("n_children") == 0), F.sha2(F.col("conv_id").cast("string"), 256))
    found = found.withColumn("parent", F.struct((F.col("depth") - 1).alias("depth"), F.col("prev").alias("f")))
    parents = every.where("n_children > 0").select(F.struct("depth", "f").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = spread_join(found, parents, "parent", "f")
    return found.select(
        F.col("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", alone, F.lit(_NO_ENDS)).alias("ends_sha256"),
    )


#: `trie` over the table `conversations`, for DuckDB.
ORACLE = r"""
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
v AS (
  SELECT DISTINCT c, c - c % 5 AS base, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h FROM o),
r AS (
  SELECT v.c, 0 AS own, o.pos, role, text FROM v JOIN o ON o.c = v.base AND o.pos < v.h
  UNION ALL SELECT v.c, 1, o.pos, role, text FROM v JOIN o ON o.c = v.c AND o.pos >= v.h),
t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, role, text FROM r),
p AS (
  SELECT c, d, octet_length(encode(text)) AS bytes, sha256(string_agg(sha256(role || chr(1) || text), '') OVER (PARTITION BY c ORDER BY d)) AS k,
         d = max(d) OVER (PARTITION BY c) AS last FROM t
  UNION ALL SELECT c, 0, 0, '', c NOT IN (SELECT c FROM t) FROM v),
n AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n, any_value(bytes) AS bytes, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last) AS ends FROM p GROUP BY 1, 2),
u AS (SELECT DISTINCT a.d AS ad, a.k AS ak, b.d AS bd, b.k AS bk FROM p a JOIN p b ON a.c = b.c AND a.d <= b.d),
kids AS (SELECT ad, ak, count(*) AS n_children FROM u WHERE bd = ad + 1 GROUP BY 1, 2),
sums AS (
  SELECT u.ad, u.ak, sum((n.n - 1) * n.bytes) AS saved, count(*) FILTER (n_children IS NULL) AS leaves
  FROM u JOIN n ON n.d = u.bd AND n.k = u.bk LEFT JOIN kids ON kids.ad = u.bd AND kids.ak = u.bk GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN sums ON sums.ad = n.d AND sums.ak = n.k LEFT JOIN kids ON kids.ad = n.d AND kids.ak = n.k
LEFT JOIN u ON u.bd = n.d AND u.bk = n.k AND u.ad = n.d - 1 LEFT JOIN n q ON q.d = u.ad AND q.k = u.ak
"""

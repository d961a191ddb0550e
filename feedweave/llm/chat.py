"""Chat formatting by cumulative-snapshot collapse, in DataFrame operations only.

A logged conversation is often a snapshot of a longer one.  Every turn gets the rolling
hash of the turns up to it; a conversation whose last rolling hash is that of an earlier
turn of another, longer one is a prefix of it and goes, by an anti-join.  Of equal
conversations that of the smallest id stays.  The rest are rendered.

The rolling hash is a pair of sums of 64-bit hashes of (place, turn) with different seeds
from the row's bytes on, so it is built from partial sums: first over stretches of turns,
then within a stretch.  Turns meet what belongs to their conversation by stretch, and what
is put in order by conversation is a row a stretch without texts, so a conversation of any
length is spread over tasks.  Common first turns and equal conversations are
reduced to one row each before they are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedweave.llm.session import cut

#: Turns of a stretch, and of one rendered part.
STRETCH = 512


def _beside(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
    """`left` joined with `right` on conv, where null equals null, and the columns `more`."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in ("conv", *more)})
    on = F.col("conv").eqNullSafe(F.col("_conv"))
    for c in more:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return left.join(right, on).drop("_conv", *(f"_{c}" for c in more))


def _placed(turns: DataFrame) -> DataFrame:
    """(conv, turn, rows, place, last, a, b): the places of turns from 0, that of the
    conversation's last, and the rolling hashes up to and with each.  Rows of the same turn number count as one turn, whose rows are
    a multiset."""
    row = F.struct("role", "text")
    wide = lambda c: c.cast("decimal(38,0)")
    slots = turns.groupBy("conv", "turn").agg(
        F.count("*").alias("rows"),
        F.sum(wide(F.xxhash64(F.lit(1), row))).alias("one"),
        F.sum(wide(F.xxhash64(F.lit(2), row))).alias("two"),
    )
    slots = slots.withColumn("stretch", F.floor(F.coalesce("turn", F.lit(-1)) / STRETCH))
    within = Window.partitionBy("conv", "stretch").orderBy("turn")
    slots = slots.withColumn("at", F.row_number().over(within) - 1)
    counts = slots.groupBy("conv", "stretch").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumns({"first": F.coalesce(F.sum("n").over(before), F.lit(0)), "last": F.sum("n").over(Window.partitionBy("conv")) - 1}).drop("n")
    slots = _beside(slots, starts, "stretch").withColumn("place", F.col("first") + F.col("at"))
    hashes = slots.withColumns({c: wide(F.xxhash64(F.lit(seed), "place", "rows", "one", "two")) for c, seed in (("ha", 3), ("hb", 4))})
    sums = hashes.groupBy("conv", "stretch").agg(F.sum("ha").alias("sa"), F.sum("hb").alias("sb"))
    bases = sums.select("conv", "stretch", *(F.coalesce(F.sum(s).over(before), wide(F.lit(0))).alias(o) for s, o in (("sa", "oa"), ("sb", "ob"))))
    up_to = within.rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashes.withColumns({"ra": F.sum("ha").over(up_to), "rb": F.sum("hb").over(up_to)})
    joined = _beside(rolled, bases, "stretch")
    return joined.select("conv", "turn", "rows", "place", "last", wide(F.col("ra") + F.col("oa")).alias("a"), wide(F.col("rb") + F.col("ob")).alias("b"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv, turns): the conversations of (conv, turn, role, text) that are neither a
    prefix of a longer one nor equal to one of a smaller id."""
    sized = cut(_placed(turns))
    one_each = sized.where("place = last").groupBy("place", "a", "b").agg(F.min("conv").alias("conv"))
    inner = sized.where("place < last").select("place", "a", "b").distinct()
    return one_each.join(inner, ["place", "a", "b"], "left_anti").select("conv", (F.col("place") + 1).alias("turns"))


def render(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, part, n_turns, formatted): the maximal conversations as chat text.

    A turn is rendered as <|role|>, a line feed, the text and a line feed, in order of
    turn; rows of one turn number by role and text, and repeated rows are repeated.
    A null role is "unknown", a null text empty, a null turn comes first and a null key
    is a conversation of its own that is smallest.  A conversation has one row for each
    STRETCH turn numbers that hold any, numbered from 0 in `part`, and formatted texts
    joined in that order are the whole; n_turns is the conversation's number of turns.
    """
    turns = conversations.select(F.col(key).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit("unknown")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    turns = turns.withColumn("stretch", F.floor(F.coalesce("turn", F.lit(-1)) / STRETCH))
    kept = _beside(turns.select("conv", "stretch").distinct(), maximal(turns.drop("stretch")))
    kept = kept.withColumn("part", F.row_number().over(Window.partitionBy("conv").orderBy("stretch")) - 1)
    rows = _beside(turns, kept, "stretch")
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "role", "text")))
    parts = rows.groupBy("conv", "turns", "part").agg(ordered.alias("list"))
    shown = F.array_join(F.transform("list", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), "")
    return parts.select(F.col("conv").alias(key), F.col("part").cast("long").alias("part"), F.col("turns").cast("long").alias("n_turns"), shown.alias("formatted"))


#: `render` over the table `conversations`, for DuckDB; turn numbers there aren't null.
ORACLE = f"""
WITH rows AS (
  SELECT conv_id AS conv, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
slots AS (
  SELECT conv, turn, string_agg(role || chr(1) || text, chr(2) ORDER BY role, text) AS slot FROM rows GROUP BY conv, turn),
whole AS (
  SELECT conv, string_agg(slot, chr(3) ORDER BY turn) || chr(3) AS body, count(*) AS turns FROM slots GROUP BY conv),
prefixes AS (
  SELECT conv, turn, string_agg(slot, chr(3)) OVER (PARTITION BY conv ORDER BY turn) || chr(3) AS body,
         row_number() OVER (PARTITION BY conv ORDER BY turn DESC) AS back FROM slots),
kept AS (
  SELECT min(conv) AS conv, any_value(turns) AS turns FROM whole
  WHERE md5(body) NOT IN (SELECT md5(body) FROM prefixes WHERE back > 1) GROUP BY body),
parts AS (
  SELECT r.conv, k.turns, CAST(floor(r.turn / {STRETCH}) AS BIGINT) AS stretch,
         string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS formatted
  FROM rows r JOIN kept k USING (conv) GROUP BY 1, 2, 3)
SELECT conv AS conv_id, row_number() OVER (PARTITION BY conv ORDER BY stretch) - 1 AS part, CAST(turns AS BIGINT) AS n_turns, formatted FROM parts
"""

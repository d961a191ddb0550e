"""How filters interact: what each removes, in every order, and its Shapley share.

A document's mask is the set of filters that it fails.  Counts of documents a mask are all
that the orders depend on.  For each part (a language) they form the removal polynomial

    f(x) = sum over masks of count * (1 - product over the mask's filters of (1 - x_i)),

the multilinear extension of the number of documents that a set of filters removes.  Its
value at a corner is what that set removes, which gives the survivors of each step; the
integral of its partial derivative by x_i along the diagonal is filter i's Shapley value.
Integrals are exact fractions, and times the number of orders they are whole numbers.

The texts are read once and only (key, flags, digest of the text) are shuffled; copies
are counted a task before they meet, so one text that a third of all rows hold is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_ORDERS = ["".join(p) for p in permutations(FILTERS)]
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WHITE = "\t\n\x0b\x0c\r"
_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def content_flags(text: Column) -> dict[str, Column]:
    """Failure of the filters that look at one text: A, under 200 words; B, fewer distinct
    words than half of them; C, more than 3 capitals in 100 characters; D, a character of #$%&*|."""
    words = F.array_remove(F.split(F.translate(text, _WHITE, " " * len(_WHITE)), " "), "")
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents a part and set of failed filters, bit k of mask
    for the filter FILTERS[k], and those labelled quality 1 and toxic 1.

    E fails where a row with a smaller key has the same text; rows of one key, and rows with a
    null key, aren't smaller than each other or than others.  Null texts and parts are empty
    ones.  A key that is labelled more than once counts as good or toxic if one label says so.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    flags = content_flags(F.col("_text"))
    mask = reduce(lambda a, b: a + b, [F.when(flags[c], F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate("ABCD")])
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("_text"))
    rows = rows.select("id", "part", mask.alias("mask"), F.sha2("_text", 256).alias("digest"))
    marked = labels.select(F.col(key).cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marked = marked.where("id is not null").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    # one row a key first, then one a text, part and kind of label: copies are combined within tasks
    same = ["digest", "part", "mask", "good", "toxic"]
    rows = rows.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n")).join(marked, "id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    groups = rows.groupBy(*same).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("loose"), least.alias("least"))
    first = groups.groupBy("digest").agg(F.min("least.id").alias("first"))
    groups = groups.join(first, "digest")
    kept = F.col("loose") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask"), kept.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - kept).alias("n"))))
    counted = groups.select("part", "good", "toxic", split.alias("at")).select("part", "at.mask", "at.n", "good", "toxic").where("n > 0")
    return counted.groupBy("part", "mask").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for name, c in (("n", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))))


def removal_polynomial(counts: dict[int, int], filters: int) -> list[int]:
    """Coefficients of f by monomial, a bit mask of variables: that of T is the sum of the counts
    of all masks that hold T, with the sign of (-1)^(|T| + 1)."""
    above = [counts.get(mask, 0) for mask in range(1 << filters)]
    for k in range(filters):
        for mask in range(1 << filters):
            if not mask >> k & 1:
                above[mask] += above[mask | 1 << k]
    return [0] + [above[t] * (1 if t.bit_count() % 2 else -1) for t in range(1, 1 << filters)]


def corners(coefficients: list[int]) -> list[int]:
    """Values of a multilinear polynomial where the variables of each mask are 1 and others 0."""
    out = list(coefficients)
    for k in range(len(out).bit_length() - 1):
        for mask in range(len(out)):
            if mask >> k & 1:
                out[mask] += out[mask ^ 1 << k]
    return out


def shapley(coefficients: list[int], variable: int) -> Fraction:
    """Integral over t from 0 to 1 of the partial derivative at (t, ..., t)."""
    return sum((Fraction(c, t.bit_count()) for t, c in enumerate(coefficients) if t >> variable & 1), Fraction(0))


def _steps(counts: dict[int, tuple[int, int, int]]) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part."""
    size, total = len(FILTERS), sum(n for n, _, _ in counts.values())
    polynomials = [removal_polynomial({m: c[k] for m, c in counts.items()}, size) for k in range(3)]
    gone, good, toxic = map(corners, polynomials)
    shares = [int(shapley(polynomials[0], k) * factorial(size)) for k in range(size)]
    whole = (1 << size) - 1
    for order in _ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            k = FILTERS.index(letter)
            after = before | 1 << k
            removed = gone[after] - gone[before]
            yield order, step, total - gone[after], removed, gone[1 << k] - removed, gone[whole] - gone[whole ^ 1 << k], good[after] - good[before], toxic[after] - toxic[before], shares[k]
            before = after


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
    for batch in batches:
        for row in batch.to_pylist():
            lines = [(row["part"], *x) for x in _steps({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in row["masks"]})]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines, strict=True), types, strict=True)], names)


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row for each part, order of the five filters and step; see `mask_counts` for odd rows.

    kept are the documents after the step, removed those that it takes, redundant those that fail
    its filter and were removed before, unique_fails those that fail its filter alone, good_lost
    and toxic_lost the labelled ones among the removed, and shapley what its filter removes at
    whatever step, summed over all orders.  A table without rows has no parts and gives no rows.
    """
    counts = mask_counts(docs, labels, key, text, part)
    # at most 2^5 masks a part
    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks")).mapInArrow(_report, _SCHEMA)


#: `audit` over `documents` and `labels`, for DuckDB: every order is run over every mask's documents.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY 1),
m AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
                regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS k FROM o, range(1, 6) r(step)),
r AS (
  SELECT part, filter_order, step, k, n, good, toxic, fails[k] AS bad, len(list_filter(fails, lambda x: x)) = 1 AS single,
         len(list_filter(range(1, step), lambda i: fails[ascii(filter_order[i]) - 64])) > 0 AS gone
  FROM s, c),
x AS (
  SELECT part, filter_order, step, k, sum(n) FILTER (NOT bad AND NOT gone) AS kept, sum(n) FILTER (bad AND NOT gone) AS removed, sum(n) FILTER (bad AND gone) AS redundant,
         sum(n) FILTER (bad AND single) AS unique_fails, sum(good) FILTER (bad AND NOT gone) AS good_lost, sum(toxic) FILTER (bad AND NOT gone) AS toxic_lost
  FROM r GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM x
"""

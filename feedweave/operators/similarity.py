"""Similarity of short texts by trigrams weighted by how rare they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.functions import text as X

TITLE, SUMMARY = 0.75, 0.25


def document_frequencies(docs: DataFrame, normalize=X.normalize_story_text) -> DataFrame:
    """(trigram, df): in how many of (id, title, summary) each trigram occurs."""
    docs = docs.select(normalize(F.col("title")).alias("title"), normalize(F.col("summary")).alias("summary"))
    every = F.array_distinct(F.concat(X.trigrams("title"), X.trigrams("summary")))
    return docs.select(F.explode(every).alias("trigram")).groupBy("trigram").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column | None = None) -> Column:
    """Weight of a trigram in df of n documents; of one in none without df."""
    return F.log((n + 1) / (df + 1)) + 1 if df is not None else F.log(n + 1) + 1


def model(docs: DataFrame, normalize=X.normalize_story_text) -> DataFrame:
    """(trigram, df, idf) of a corpus."""
    n = docs.agg(F.count("*").alias("n"))
    return document_frequencies(docs, normalize).crossJoin(F.broadcast(n)).select("trigram", "df", idf(F.col("n"), F.col("df")).alias("idf"))  # n is one row


def vectors(docs: DataFrame, weights: DataFrame, field: str, normalize=X.normalize_story_text) -> DataFrame:
    """(id, trigram, weight): occurrences times weight, of one field; `weights` hold every
    trigram of the corpus."""
    docs = docs.select("id", normalize(F.col(field)).alias("field"))
    counted = docs.select("id", F.explode(X.trigrams("field")).alias("trigram")).groupBy("id", "trigram").agg(F.count("*").alias("tf"))
    return counted.join(weights, "trigram").select("id", "trigram", (F.col("tf") * F.col("idf")).alias("weight"))


def dice(pairs: DataFrame, vectors_of_field: DataFrame, name: str) -> DataFrame:
    """`pairs` (a, b) with the weighted Dice of one field: twice the shared weight over all
    weight; 0 where both are empty."""
    totals = vectors_of_field.groupBy("id").agg(F.sum("weight").alias("total"))
    left, right = (vectors_of_field.select(F.col("id").alias(x), "trigram", F.col("weight").alias(f"w_{x}")) for x in "ab")
    shared = pairs.join(left, "a").join(right, ["b", "trigram"]).groupBy("a", "b").agg(F.sum(F.least("w_a", "w_b")).alias("shared"))
    out = pairs.join(shared, ["a", "b"], "left")
    for x in "ab":
        out = out.join(totals.select(F.col("id").alias(x), F.col("total").alias(f"t_{x}")), x, "left")
    every = F.coalesce("t_a", F.lit(0.0)) + F.coalesce("t_b", F.lit(0.0))
    value = F.when(every == 0, F.lit(0.0)).otherwise(2 * F.coalesce("shared", F.lit(0.0)) / every)
    return out.withColumn(name, value).drop("shared", "t_a", "t_b")


def compare(pairs: DataFrame, docs: DataFrame, weights: DataFrame, normalize=X.normalize_story_text) -> DataFrame:
    """`pairs` with title_sim, summary_sim and combined."""
    out = dice(pairs, vectors(docs, weights, "title", normalize), "title_sim")
    out = dice(out, vectors(docs, weights, "summary", normalize), "summary_sim")
    return out.withColumn("combined", TITLE * F.col("title_sim") + SUMMARY * F.col("summary_sim"))


def pairs_within(rows: DataFrame, window_ms: int, on: Column | None = None) -> DataFrame:
    """(a, b) with a < b of (id, ms) rows no more than window_ms apart.

    A range join by buckets: a row meets its own bucket and the one after, so each pair
    meets once and no row meets more than two buckets' rows.  `on` narrows the pairs;
    it sees the columns of both sides as l.x and r.x.
    """
    bucket = F.floor(F.col("ms") / window_ms)
    left = rows.withColumn("bucket", F.explode(F.array(bucket, bucket + 1))).alias("l")
    right = rows.withColumn("bucket", bucket).alias("r")
    met = (F.col("l.bucket") == F.col("r.bucket")) & (F.abs(F.col("l.ms") - F.col("r.ms")) <= window_ms)
    # a pair of one bucket meets in it, one of neighbours in the later: keep it once
    own = F.floor(F.col("l.ms") / window_ms)
    once = ((own == F.col("r.bucket")) & (F.col("l.id") < F.col("r.id"))) | ((own + 1 == F.col("r.bucket")) & (F.col("l.id") != F.col("r.id")))
    met = met & once
    if on is not None:
        met = met & on
    return left.join(right, met).select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"))

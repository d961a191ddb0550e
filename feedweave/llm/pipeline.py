"""From raw documents to sampled training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), where docs is all that the stage before it kept
(the table `documents` for the first), and returns a DataFrame that is written as
Parquet and read again for the next.  Stages take the columns of `documents` and leave
others out.  Null and empty texts and null keys pass all stages as their docstrings say;
rows that are repeated whole are one document to near-dedup, and a table without rows
stays one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm import decontaminate, near_dedup, secrets, sp_sample, toxicity
from feedweave.llm.session import small_batches, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on those labelled, doesn't reject: null and
    empty texts among them, unless the model finds any text toxic.  No documents give none."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.remove_toxic(docs.select(*COLUMNS), model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest key: five-word
    shingles, similarity 0.8.  Texts without words are copies of nothing, rows with null
    keys stay, and rows with one key stay or go together."""
    small_batches(spark)
    return near_dedup.deduplicate(docs.select(*COLUMNS), size=5, threshold=80)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none, and an
    empty benchmark takes nothing away."""
    small_batches(spark)
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark", "item_id", "text"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by marks; n_chars is that of the new text
    where there was a secret.  Null and empty texts stay as they are."""
    small_batches(spark)
    hidden = secrets.redact(docs.select(*COLUMNS).withColumn("_old", F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col("_old"))
    return hidden.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def sampled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document, or as many as it has; a null or empty
    text has one without pieces."""
    small_batches(spark)
    return sp_sample.encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), k=2)


STAGES = [("toxicity", clean), ("near-dedup", distinct), ("decontamination", uncontaminated), ("secrets", redacted), ("pieces", sampled)]

#: SQL can express neither the models nor the sampling; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the table `documents`."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

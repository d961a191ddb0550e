"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder of the session.

    The folder is `spark.checkpoint.dir`.  Where that is unset (a local test
    session) a temporary folder of this machine is used.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="feedweave-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share: under `spark.checkpoint.dir`, or a temporary
    one of this machine where that is unset in a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="feedweave-")


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str) -> DataFrame:
    """`many` with the columns of `one`, which has a row a key at most, by a left join in
    which no key is hot: rows of a key are dealt by the hash of their column `by` over as
    many places as a shuffle has partitions, and `one` goes to the places that occur."""
    places = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = many.withColumn("_place", F.pmod(F.xxhash64(by), F.lit(places)).cast("int"))
    return many.join(many.select(key, "_place").distinct().join(one, key), [key, "_place"], "left").drop("_place")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of `edges` reaches.

    Nodes are of any type that can be ordered; edges with a null end are left out.
    Nothing is collected but one hash a round.  A round takes the smallest label among
    a node's neighbours and then the label of that label, so the number of rounds
    grows with the logarithm of a component's diameter at best; stars take three.
    """
    both = edges.where(f"{a} is not null and {b} is not null").select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = cut(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = cut(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")))
    seen = None
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = cut(step.join(jump, "component", "left").select("node", F.coalesce("further", "component").alias("component")))
        now = labels.agg(F.bit_xor(F.xxhash64("node", "component")).alias("h")).first()["h"]
        if now == seen:
            return labels
        seen = now

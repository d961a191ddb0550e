"""Sources of videos over the driver tables: orders stand for uploads and customers for channels."""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedweave.operators.components import shared_folder
from feedweave.plans.catalogue import query
from feedweave.plans.feed import read
from feedweave.sources import videos as S

CUT = "1996-06-01T00:00:00Z"
_PAGE = 4
#: Parts that one file of details holds, about.
_SHELF = 2_000


def _landed_uploads(spark: SparkSession, sf: str) -> tuple[str, list[str]]:
    """Orders written as pages of the upload lists of nations, newest first, with private ones among them."""
    folder = f"{shared_folder(spark)}/pages"
    orders = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("o_orderdate"), "o_orderkey")) - 1
    when = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    details = F.struct(F.col("o_orderkey").cast("string").alias("videoId"), when.alias("videoPublishedAt"))
    item = F.struct(details.alias("contentDetails"), F.struct(F.when(F.col("o_orderstatus") == "F", "private").otherwise("public").alias("privacyStatus")).alias("status"))
    rows = orders.select(F.col("c_nationkey").alias("list"), place.alias("place"), item.alias("item")).withColumn("page", F.floor(F.col("place") / _PAGE))
    pages = rows.groupBy("list", "page").agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("items"))
    body = F.to_json(F.struct(F.concat(F.lit("t"), F.col("page") + 1).alias("nextPageToken"), F.transform("items", lambda i: i["item"]).alias("items")))
    token = F.when(F.col("page") == 0, "first").otherwise(F.concat(F.lit("t"), "page"))
    pages.where("page < 5").select(F.concat(F.lit("uploads-"), "list", F.lit("-"), token).alias("request"), body.alias("value")).write.partitionBy("request").text(folder)
    return folder, [str(r["n_nationkey"]) for r in read(spark, sf, "nation").select("n_nationkey").collect()]


@query(
    "paged_uploads",
    f"""WITH p AS (SELECT c_nationkey, o_orderkey, o_orderdate, o_orderstatus, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS place FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT CAST(c_nationkey AS VARCHAR) AS list, CAST(place // {_PAGE} + 1 AS INT) AS page, CAST(o_orderkey AS VARCHAR) AS videoId FROM p
WHERE place < {5 * _PAGE} AND o_orderdate >= TIMESTAMP '1996-06-01' AND o_orderstatus <> 'F'""",
)
def paged_uploads(spark: SparkSession, sf: str) -> DataFrame:
    folder, lists = _landed_uploads(spark, sf)
    spark.dataSource.register(S.VideoPages)
    pages = spark.read.format("video_pages").options(folder=folder, kind="uploads", lists=json.dumps(lists), after=CUT).load()
    return pages.select("list", "page", "videoId")


@query("looked_up_details", "SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_name END AS title, CASE WHEN p_size % 7 <> 0 THEN 'PT' || p_size || 'M' END AS duration FROM part")
def looked_up_details(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as videos whose details are asked for by fifty, some of which aren't answered for.  Responses are
    landed by shelves of some _SHELF parts, so files are few however many parts there are."""
    folder = f"{shared_folder(spark)}/details"
    part = read(spark, sf, "part")
    shelves = part.count() // _SHELF + 1
    place = lambda i: F.crc32(i) % shelves
    key = F.col("p_partkey").cast("string")
    snippet, details = F.struct(F.col("p_name").alias("title")), F.struct(F.concat(F.lit("PT"), "p_size", F.lit("M")).alias("duration"))
    item = F.to_json(F.struct(key.alias("id"), snippet.alias("snippet"), details.alias("contentDetails")))
    part.where("p_size % 7 <> 0").select(item.alias("value"), F.concat(F.lit("details-"), place(key)).alias("request")).repartition("request").write.partitionBy("request").text(folder)

    def client():
        return S.shelved(folder, lambda i: f"details-{zlib.crc32(i.encode()) % shelves}")

    found = S.looked_up(part.select("p_partkey"), client, S.DETAIL_ROW, "p_partkey", place=place)
    return found.select("p_partkey", F.col("found.snippet.title").alias("title"), F.col("found.contentDetails.duration").alias("duration"))

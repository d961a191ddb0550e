"""Aggregates of items, channels and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.functions import text as X
from feedweave.operators.items import is_secondary, top_per_group


def count_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def dashboard(items: DataFrame, now: Column) -> DataFrame:
    """One row: all items, and those of each kind collected in the last 24 hours."""
    recent = F.try_to_timestamp(F.col("collectedAt").cast("string")) >= now - F.expr("INTERVAL 24 HOURS")
    return items.agg(F.count("*").alias("total"), count_if(recent).alias("recent"), *(count_if(recent & (F.col("sourceType") == kind)).alias(f"recent_{kind}") for kind in ("news", "official", "youtube")))


def tag_counts(items: DataFrame, tags: str) -> DataFrame:
    return items.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def tag_latest(items: DataFrame, tags: str, time: str = "publishedAt") -> DataFrame:
    """(tag, latest): the raw text of the latest time of each tag."""
    return items.select(F.explode(tags).alias("tag"), time).groupBy("tag").agg(F.max_by(time, F.struct(X.feed_millis(time), F.col(time).cast("string"))).alias("latest"))


def dimension_counts(dimension: DataFrame, counts: DataFrame) -> DataFrame:
    """Every row of a dimension (id) with its count, 0 where it has none."""
    return dimension.join(counts.withColumnRenamed("tag", "id"), "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def publisher_counts(items: DataFrame) -> DataFrame:
    """(video, publisher, n), editorial and video apart."""
    return items.groupBy((F.col("sourceType") == "youtube").alias("video"), "publisher").agg(F.count("*").alias("n"))


def median_or_zero(c: Column | str) -> Column:
    return F.coalesce(F.round(F.percentile(c, 0.5)), F.lit(0.0)).cast("long")


def channel_status(status: Column | str) -> Column:
    """The status of a channel by policy, unlisted where it has none; of a left join."""
    return F.coalesce(F.col(status) if isinstance(status, str) else status, F.lit("unlisted"))


def policy_rows(preferred: DataFrame, blocked: DataFrame) -> DataFrame:
    """(channel_id, status) of the two lists; blocked goes before preferred."""
    both = preferred.select("channel_id", F.lit("preferred").alias("status")).unionByName(blocked.select("channel_id", F.lit("blocked").alias("status")))
    return both.groupBy("channel_id").agg(F.min("status").alias("status"))


def effective_tier(status: Column | str, content: Column | str) -> Column:
    """The tier of a video: reject of a blocked channel, primary of a preferred one where its
    content is, else secondary."""
    s, c = (F.col(x) if isinstance(x, str) else x for x in (status, content))
    return F.when(s == "blocked", "reject").when((s == "preferred") & (c == "primary"), "primary").otherwise("secondary")


def channels(videos: DataFrame) -> DataFrame:
    """(channelId, name, status, counts, median, newest five) of (channelId, publisher,
    publishedAt, title, url, videoId, durationSeconds, contentTier, status, shorts)."""
    ms = X.feed_millis("publishedAt")
    timed = videos.withColumn("ms", ms)
    top = top_per_group(timed, ["channelId"], [F.desc("ms"), F.asc("videoId")], 5)
    newest = top.groupBy("channelId").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "videoId", "title", "url", "publishedAt", "durationSeconds"))), lambda x: x.dropFields("rank")).alias("representativeVideos"))
    total = timed.groupBy("channelId").agg(
        F.max_by("publisher", F.struct("ms", F.col("videoId"))).alias("name"),
        F.max("status").alias("status"),
        F.count("*").alias("totalVideos"),
        count_if(F.col("shorts")).alias("knownShorts"),
        count_if(F.coalesce("durationSeconds", F.lit(0)) >= 600).alias("atLeastTenMinutes"),
        median_or_zero(F.coalesce("durationSeconds", F.lit(0))).alias("medianDurationSeconds"),
        count_if(F.col("contentTier") == "primary").alias("contentPrimary"),
        count_if(F.col("contentTier") == "secondary").alias("contentSecondary"),
    )
    return total.join(newest, "channelId")


def channel_order() -> list[Column]:
    return [F.desc(F.col("status") == "preferred"), F.desc("atLeastTenMinutes"), F.desc("totalVideos"), F.asc(F.collate("name", "ko")), F.asc("name")]


def channel_totals(report: DataFrame) -> DataFrame:
    of = lambda s: count_if(F.col("status") == s).alias(s)
    return report.agg(F.count("*").alias("channels"), F.coalesce(F.sum("totalVideos"), F.lit(0)).alias("videos"), of("preferred"), of("unlisted"), of("blocked"))


def best_observations(seen: DataFrame, key: str, query: str) -> DataFrame:
    """The best title and summary of each key and all queries that it was seen by, sorted.

    A whole title first, then more words shared with the summary, a longer title, a longer
    summary, and the text that comes first.
    """
    cut_off = F.regexp_like("title", F.lit(r"(?:\.{3}|…)$"))
    quality = F.struct((~cut_off).cast("int").alias("whole"), X.title_overlap_count("title", "summary").alias("shared"), F.length("title").alias("t"), F.length("summary").alias("s"))
    text = F.concat_ws("\n", "title", "summary")
    best = F.min(F.struct(*((-quality[c]).alias(c) for c in ("whole", "shared", "t", "s")), F.collate(text, "ko").alias("order"), text.alias("text"), "title", "summary"))
    out = seen.groupBy(key).agg(best.alias("best"), F.array_sort(F.collect_set(query)).alias("queries"))
    return out.select(key, "best.title", "best.summary", "queries")


def observed_queries(seen: DataFrame, key: str, query: str) -> DataFrame:
    """(key, queries): all queries that each key was seen by, sorted."""
    return seen.groupBy(key).agg(F.array_sort(F.collect_set(query)).alias("queries"))


def with_observations(videos: DataFrame, observed: DataFrame, key: str = "videoId") -> DataFrame:
    """Videos that were observed, with their queries; others are left out."""
    return videos.join(observed, key)


def with_format_cache(videos: DataFrame, cache: DataFrame, now: Column, ttl: str = "INTERVAL 30 DAYS", key: str = "videoId") -> DataFrame:
    """Videos with the cached classification and evidence of their format; null where there
    is none, or one older than `ttl`."""
    fresh = cache.where(F.try_to_timestamp(F.col("checkedAt").cast("string")) >= now - F.expr(ttl)).select(key, "classification", "evidence")
    return videos.join(fresh, key, "left")


def with_fetched_tags(items: DataFrame, fetched: DataFrame, key: str = "videoId") -> DataFrame:
    """Items with the column `fetchedTags` of (key, tags): null where the lookup didn't find
    the video, and an empty array where it found it without tags."""
    found = fetched.select(key, F.coalesce("tags", F.array().cast("array<string>")).alias("fetchedTags"))
    return items.join(found, key, "left")


def tags_of(dimension: DataFrame, items: DataFrame, tags: str) -> DataFrame:
    """Rows of a dimension (id) that some item is tagged with."""
    return dimension.join(items.select(F.explode(tags).alias("id")).distinct(), "id", "left_semi")


# Runs


def latest_collection(collectors: DataFrame, fallback: Column, time: str = "lastCollectedAt") -> DataFrame:
    """One row: the latest time of the collectors as written, or the fallback if none has one."""
    return collectors.agg(F.coalesce(F.max_by(time, F.struct(X.feed_millis(time), F.col(time).cast("string"))), fallback).alias("latest"))


def reclassification_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change, was, now) of the items that another classification moves: removed, or of
    another tier, null tiers as primary."""
    tier = lambda d, name: d.select("id", F.coalesce("relevanceTier", F.lit("primary")).alias(name))
    both = tier(before, "was").join(tier(after, "now"), "id", "left")
    change = F.when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "tier")
    return both.withColumn("change", change).where("change is not null").select("id", "change", "was", "now")


def by_collection(items: DataFrame) -> DataFrame:
    return items.groupBy("collectedAt").agg(F.count("*").alias("n"))


def new_items(current: DataFrame, previous: DataFrame) -> DataFrame:
    """One row: how many more items each collection time has than before, summed; an item
    that only changed its id isn't new."""
    joined = by_collection(current).join(by_collection(previous).withColumnRenamed("n", "was"), "collectedAt", "left")
    return joined.agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.col("n") - F.coalesce("was", F.lit(0)))), F.lit(0)).alias("new_items"))


def run_status(attempted: Column, succeeded: Column, failed: Column) -> Column:
    """failed, partial or success of the summed counts of a run; nothing attempted has failed."""
    return F.when((attempted == 0) | (succeeded == 0), "failed").when(failed > 0, "partial").otherwise("success")


def tier_totals(items: DataFrame) -> DataFrame:
    kind = lambda s: F.col("sourceType") == s
    return items.agg(
        F.count("*").alias("total"),
        count_if(kind("news")).alias("news"),
        count_if(kind("official")).alias("official"),
        count_if(kind("youtube")).alias("youtube"),
        count_if(~is_secondary()).alias("primary"),
        count_if(is_secondary()).alias("secondary"),
    )


def removed(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """Rows of `before` whose key isn't in `after`."""
    return before.join(after.select(key).distinct(), key, "left_anti")


def tier_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before, after, n) of the items in both, null tiers as primary."""
    tier = lambda d, name: d.select("id", F.coalesce("relevanceTier", F.lit("primary")).alias(name))
    return tier(before, "before").join(tier(after, "after"), "id").groupBy("before", "after").agg(F.count("*").alias("n"))


def restore_report(before: DataFrame, candidates: DataFrame, after: DataFrame) -> DataFrame:
    """One row of what a restoration did: counts and the range of dates restored."""
    restored = removed(after, before).agg(F.count("*").alias("restored"), F.min("publishedAt").alias("earliest"), F.max("publishedAt").alias("latest"), F.countDistinct(F.substring("publishedAt", 1, 10)).alias("days"))
    n = lambda d, name: d.agg(F.count("*").alias(name))
    return n(before, "before").crossJoin(n(candidates, "candidates")).crossJoin(n(after, "after")).crossJoin(restored)  # one row each

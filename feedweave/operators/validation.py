"""Violations of rules, as rows (rule, key, detail); nothing is found where there are none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.operators.clusters import news_match, story_rows, video_match  # noqa: F401
from feedweave.operators.items import ITEM


class Invalid(ValueError):
    """Data that breaks a rule."""


def violations(rows: DataFrame, rule: str, broken: Column, key: str = "id", detail: Column | None = None) -> DataFrame:
    return rows.where(F.coalesce(broken, F.lit(True))).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def duplicates(rows: DataFrame, rule: str, key: str = "id") -> DataFrame:
    again = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return violations(again, rule, F.lit(True), key, F.col("n"))


def orphans(items: DataFrame, tags: str, dimension: DataFrame, rule: str) -> DataFrame:
    """Tags that no row of the dimension has."""
    used = items.select(F.col("id").alias("key"), F.explode(tags).alias("id"))
    return used.join(dimension.select("id"), "id", "left_anti").select(F.lit(rule).alias("rule"), F.col("key").cast("string").alias("key"), F.col("id").cast("string").alias("detail"))


def item_violations(items: DataFrame) -> DataFrame:
    """Rules on the fields of one item, and that ids are unique."""
    kind, time = F.col("type"), lambda c: F.try_to_timestamp(c).isNull()
    state = F.col("dedupeState")
    rules = {
        "id": F.coalesce(F.length("id"), F.lit(0)) == 0,
        "title": F.coalesce(F.length("title"), F.lit(0)) == 0,
        "publisher": F.coalesce(F.length("publisher"), F.lit(0)) == 0,
        "type": ~kind.isin("news", "official", "youtube"),
        "source type": kind != F.col("sourceType"),
        "official": F.col("isOfficial") != (kind == "official"),
        "video": F.col("youtube").isNotNull() != (kind == "youtube"),
        "score": ~F.col("relevanceScore").between(0, 100),
        "tier": F.coalesce(~F.col("relevanceTier").isin("primary", "secondary"), F.lit(False)),
        "published": time("publishedAt"),
        "collected": time("collectedAt"),
        "url": ~F.regexp_like("url", F.lit("(?i)^https?://[^/]+")),
        "bounds": F.coalesce((state["earliestPublishedAt"] > state["latestPublishedAt"]) | (state["representativeCollectedAt"] > state["latestCollectedAt"]), F.lit(False)),
    }
    # one array of the rules broken a row, so the items are read once, and once more for their ids
    broken = F.array_compact(F.array(*(F.when(F.coalesce(b, F.lit(True)), F.lit(r)) for r, b in rules.items())))
    found = items.select(F.explode(broken).alias("rule"), F.col("id").cast("string").alias("key"), F.lit("").alias("detail"))
    return found.unionByName(duplicates(items, "unique id"))


def cluster_violations(clusters: DataFrame, items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rules on stories: two members at least, known, one type, in one story only, the seed
    the first member, and every pair of members among the matching pairs (a, b)."""
    member = clusters.select("id", F.posexplode("memberIds").alias("at", "m"))
    known = member.join(items.select(F.col("id").alias("m"), "type"), "m", "left")
    small = violations(clusters, "size", F.size("memberIds") < 2)
    seed = violations(clusters, "seed", F.get("memberIds", 0) != F.col("seedItemId"))
    unknown = violations(known.where(F.col("type").isNull()), "member", F.lit(True), "id", F.col("m"))
    mixed = violations(known.groupBy("id").agg(F.countDistinct("type").alias("types")), "type", F.col("types") > 1)
    shared = duplicates(member, "one story", "m")
    both = member.alias("p").join(member.alias("q"), "id").where("p.m < q.m").select("id", F.col("p.m").alias("a"), F.col("q.m").alias("b"))
    apart = violations(both.join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "pair", F.lit(True), "id", F.concat_ws(" ", "a", "b"))
    return reduce(DataFrame.unionByName, [small, seed, unknown, mixed, shared, apart])


def bundle_violations(items: DataFrame, issues: DataFrame, people: DataFrame, total: int) -> DataFrame:
    """Rules on items and on what they refer to."""
    return item_violations(items).unionByName(table_violations(items, issues, people, total))


def table_violations(items: DataFrame, issues: DataFrame, people: DataFrame, total: int) -> DataFrame:
    """Rules on all tables: unique ids, tags that exist, and the number of items."""
    count = items.agg(F.count("*").alias("n")).select(F.lit("items").alias("id"), "n")
    return reduce(
        DataFrame.unionByName,
        [duplicates(issues, "unique issue"), duplicates(people, "unique person"), orphans(items, "issueTags", issues, "issue tag"), orphans(items, "personTags", people, "person tag"), violations(count, "total", F.col("n") != total, "id", F.col("n"))],
    )


def query_violations(queries: DataFrame) -> DataFrame:
    """Unique ids, and 1 to 15 queries in use."""
    used = queries.agg(F.coalesce(F.count_if("enabled"), F.lit(0)).alias("n")).select(F.lit("queries").alias("id"), "n")
    return violations(used, "enabled", ~F.col("n").between(1, 15), "id", F.col("n")).unionByName(duplicates(queries, "unique query"))


def check(found: DataFrame, show: int = 20) -> None:
    """Raise if there is any violation."""
    rows = found.limit(show).collect()
    if rows:
        raise Invalid("; ".join(f"{r['rule']}: {r['key']} {r['detail']}".strip() for r in rows))


COLUMNS = ITEM.fieldNames()

"""Feed entries: visible items grouped by story, with one item to stand for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.functions import text as X
from feedweave.operators import items as I
from feedweave.operators.components import cut
from feedweave.operators.similarity import compare, model


def visible_groups(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """`items` with the group of each: its first story in order (ms, seed), where it is in one
    and isn't official, else the item itself.

    clusters: (id, seedItemId, memberIds, ms) as `clusters.build` gives them.
    """
    member = clusters.select(F.col("id").alias("story"), F.col("ms").alias("_ms"), F.col("seedItemId").alias("_seed"), F.explode("memberIds").alias("id"))
    first = member.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("_ms", F.collate("_seed", "ko"), "_seed"))).where("_n = 1").select("id", "story")
    joined = items.join(first, "id", "left")
    return joined.withColumn("group", F.when((F.col("sourceType") == "official") | F.col("story").isNull(), F.col("id")).otherwise(F.col("story"))).drop("story")


def timed(items: DataFrame) -> DataFrame:
    return items.withColumns({"published_ms": X.feed_millis("publishedAt"), "collected_ms": X.feed_millis("collectedAt")})


def candidate_scores(grouped: DataFrame, weights: DataFrame) -> DataFrame:
    """(group, id, score) of the candidates of groups of several items: centrality, relevance,
    completeness and freshness, by 50, 25, 20 and 5.

    Candidates are the primary members, or all where none is.  weights: the model of the
    whole corpus, whatever the filters.
    """
    group = Window.partitionBy("group")
    sized = timed(grouped).withColumn("n", F.count("*").over(group)).where("n > 1")
    sized = cut(
        sized.withColumns(
            {"oldest": F.min("published_ms").over(group), "newest": F.max("published_ms").over(group), "primaries": F.sum((~I.is_secondary()).cast("int")).over(group), "secondary": I.is_secondary()}
        )
    )
    l, r = sized.select("group", "id").alias("l"), sized.select("group", "id").alias("r")
    pairs = l.join(r, (F.col("l.group") == F.col("r.group")) & (F.col("l.id") < F.col("r.id"))).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    scored = cut(compare(pairs, sized.select("id", "title", "summary").distinct(), weights))
    both = scored.select(F.col("a").alias("id"), "combined").unionByName(scored.select(F.col("b").alias("id"), "combined"))
    central = both.groupBy("id").agg(F.sum("combined").alias("near"))
    fresh = F.when(F.col("newest") == F.col("oldest"), 1.0).otherwise((F.col("published_ms") - F.col("oldest")) / (F.col("newest") - F.col("oldest")))
    score = 50 * F.coalesce("near", F.lit(0.0)) / (F.col("n") - 1) + 25 * F.col("relevanceScore") / 100 + 20 * X.completeness("title", "summary") + 5 * fresh
    return sized.join(central, "id", "left").where("primaries = 0 or not secondary").select("group", "id", score.alias("score"), "published_ms", "collected_ms")


def representatives(grouped: DataFrame, weights: DataFrame) -> DataFrame:
    """(group, representative): the highest score; later publication, earlier collection and
    the smaller id of equals.  A group of one stands for itself without a score."""
    order = [F.desc("score"), F.desc("published_ms"), F.asc("collected_ms"), *I.locale_order("id")]
    chosen = I.top_per_group(candidate_scores(grouped, weights), ["group"], order, 1).select("group", F.col("id").alias("representative"))
    alone = grouped.groupBy("group").agg(F.count("*").alias("n"), F.any_value("id").alias("representative")).where("n = 1").select("group", "representative")
    return chosen.unionByName(alone)


def entries(grouped: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, representative, related, itemCount, latestPublishedAt, maxRelevanceScore) of each group."""
    rows = timed(grouped).join(chosen, "group")
    key = F.struct((-F.col("published_ms")).alias("p"), (-F.col("collected_ms")).alias("c"), (-F.col("relevanceScore")).alias("s"), F.col("id").alias("i"))
    rest = F.struct(key.alias("key"), F.struct(*I.RELATED).alias("item"))
    related = F.transform(F.array_sort(F.collect_list(F.when(F.col("id") != F.col("representative"), rest))), lambda x: x["item"])
    return rows.groupBy(F.col("group").alias("id")).agg(
        F.max(F.when(F.col("id") == F.col("representative"), F.struct(*[c for c in (*I.FEED, "searchTerms") if c in grouped.columns]))).alias("representative"),
        related.alias("related"),
        F.count("*").alias("itemCount"),
        F.min_by("publishedAt", key).alias("latestPublishedAt"),
        F.max("relevanceScore").alias("maxRelevanceScore"),
        F.max("published_ms").alias("latest_ms"),
    )


def entry_order(sort: str) -> list[Column]:
    latest = [F.desc("latest_ms"), F.desc("maxRelevanceScore"), *I.locale_order("id")]
    return [F.desc("maxRelevanceScore"), *latest] if sort == "relevance" else latest


def feed_page(items: DataFrame, clusters: DataFrame, filters: I.Filters, page: I.Page, sort: str = "latest", weights: DataFrame | None = None) -> I.PageResult:
    """One page of entries of the items that pass the filters, which are applied before grouping."""
    weights = weights if weights is not None else model(items)
    grouped = cut(visible_groups(I.filter_items(items, filters), clusters))
    return I.page_of(entries(grouped, representatives(grouped, weights)), entry_order(sort), page, F.col("itemCount"))


def source_link_page(items: DataFrame, filters: I.Filters, page: I.Page) -> I.PageResult:
    """One page of links, ungrouped, latest first."""
    rows = timed(I.filter_items(items, filters))
    return I.page_of(rows.select(*I.LINK, "published_ms", "collected_ms", "relevanceScore"), I.related_first(), page)


def scoped_feed_page(items: DataFrame, clusters: DataFrame, issue: str = "all", person: str = "all", weights: DataFrame | None = None) -> I.PageResult:
    return feed_page(items, clusters, I.Filters(scope="all", issue=issue, person=person), I.Page(), weights=weights)


def home_page(editorial: DataFrame, videos: DataFrame, clusters: DataFrame, size: int = 6) -> tuple[I.PageResult, I.PageResult]:
    page = I.Page(0, size)
    return feed_page(editorial, clusters, I.Filters(), page), feed_page(videos, clusters, I.Filters(type="youtube"), page)

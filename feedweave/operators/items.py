"""The item table: schema, projections, filters, orders and pages of the feed."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedweave.functions import text as X

_S, _L = T.StringType(), T.ArrayType(T.StringType())
STATE = T.StructType(
    [T.StructField("version", T.IntegerType()), *(T.StructField(c, _L) for c in ("urls", "stories", "nearKeys"))]
    + [T.StructField(c, T.LongType()) for c in ("earliestPublishedAt", "latestPublishedAt", "representativeCollectedAt", "latestCollectedAt")]
)
VIDEO = T.StructType(
    [T.StructField(c, _S) for c in ("videoId", "channelId", "channelStatus", "contentRelevanceTier")]
    + [
        T.StructField("tags", _L),
        T.StructField("thumbnail", T.StructType([T.StructField("url", _S), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])),
        T.StructField("durationSeconds", T.IntegerType()),
    ]
)
ITEM = T.StructType(
    [T.StructField(c, _S) for c in ("id", "type", "title", "summary", "url", "originalUrl", "publisher", "publishedAt", "collectedAt")]
    + [T.StructField(c, _L) for c in ("matchedKeywords", "discoveryQueries", "issueTags", "personTags")]
    + [T.StructField("sourceType", _S), T.StructField("isOfficial", T.BooleanType()), T.StructField("relevanceScore", T.IntegerType()), T.StructField("relevanceTier", _S), T.StructField("labels", _L)]
    + [T.StructField("dedupeState", STATE), T.StructField("youtube", VIDEO)]
)
FEED = ("id", "type", "title", "summary", "url", "originalUrl", "publisher", "publishedAt", "collectedAt", "matchedKeywords", "issueTags", "personTags", "sourceType", "isOfficial", "relevanceScore", "relevanceTier", "labels")
RELATED = ("id", "title", "url", "publisher", "publishedAt")
LINK = ("id", "title", "url", "publisher", "publishedAt", "sourceType")
REVISION = ("id", "title", "summary", "url", "publisher", "publishedAt", "collectedAt", "matchedKeywords", "issueTags", "personTags", "sourceType", "relevanceScore", "relevanceTier", "labels", "youtube")


# Projections


def feed_items(items: DataFrame) -> DataFrame:
    """What the feed shows of an item, with the words that a search looks in."""
    return items.select(*FEED, X.search_terms("matchedKeywords", "labels").alias("searchTerms"))


def related_items(items: DataFrame) -> DataFrame:
    return items.select(*RELATED)


def source_links(items: DataFrame) -> DataFrame:
    return items.select(*LINK)


def revision_items(items: DataFrame) -> DataFrame:
    return items.select(*REVISION)


def public_items(items: DataFrame) -> DataFrame:
    """Items without the state of duplicate resolution."""
    return items.drop("dedupeState")


def video_story_text(items: DataFrame) -> DataFrame:
    return items.select("id", "title", X.join_summary_and_tags("summary", F.col("youtube.tags")).alias("summary"))


def thumbnail(images: Column | str) -> Column:
    """The image of the first preferred size, else that of the largest area, 480 x 360 where unknown."""
    m = F.col(images) if isinstance(images, str) else images
    preferred = [F.try_element_at(m, F.lit(k)) for k in ("maxres", "standard", "high", "medium", "default")]
    area = lambda v: F.coalesce(v["width"], F.lit(0)) * F.coalesce(v["height"], F.lit(0))
    largest = F.get(F.array_sort(F.map_values(m), lambda a, b: area(b) - area(a)), 0)
    chosen = F.coalesce(*preferred, largest)
    return F.when(chosen.isNotNull(), F.struct(chosen["url"].alias("url"), F.coalesce(chosen["width"], F.lit(480)).alias("width"), F.coalesce(chosen["height"], F.lit(360)).alias("height")))


# Filters


@dataclass(frozen=True)
class Filters:
    scope: str = "primary"
    type: str = "all"
    issue: str = "all"
    person: str = "all"
    query: str = ""

    @staticmethod
    def of(params: dict[str, str | list[str]], issues: set[str] = frozenset(), people: set[str] = frozenset()) -> Filters:
        """From request parameters: the first value of each; unknown values count as "all"."""
        first = {k: (v[0] if v else "") if isinstance(v, list) else v for k, v in params.items()}
        known = lambda k, values, other: v if (v := first.get(k, other)) in values else other
        return Filters(
            known("scope", {"primary", "all"}, "primary"), known("type", {"news", "official", "youtube"}, "all"), known("issue", issues, "all"), known("person", people, "all"), (first.get("q") or "").strip()[:200]
        )

    def params(self) -> dict[str, str]:
        """The parameters that aren't as usual."""
        named = {"scope": self.scope, "type": self.type, "issue": self.issue, "person": self.person, "q": self.query}
        usual = {"scope": "primary", "type": "all", "issue": "all", "person": "all", "q": ""}
        return {k: v for k, v in named.items() if v != usual[k]}


def is_secondary() -> Column:
    """A null tier means primary."""
    return F.coalesce(F.col("relevanceTier") == "secondary", F.lit(False))


def search_text() -> Column:
    words = [F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ") for c in (F.col("matchedKeywords"), F.col("labels"))]
    return F.lower(F.concat_ws(" ", "title", "summary", "publisher", "searchTerms", *words))


def filter_items(items: DataFrame, f: Filters) -> DataFrame:
    """Feed items that pass every filter; secondary items are hidden in the primary scope
    unless something but videos is searched for."""
    tests = []
    if f.scope == "primary" and (not f.query or f.type == "youtube"):
        tests.append(~is_secondary())
    if f.type != "all":
        tests.append(F.col("sourceType") == f.type)
    if f.issue != "all":
        tests.append(F.array_contains("issueTags", f.issue))
    if f.person != "all":
        tests.append(F.array_contains("personTags", f.person))
    if f.query.strip():
        tests.append(F.contains(search_text(), F.lower(F.lit(f.query.strip()))))
    return items.where(reduce(lambda a, b: a & b, tests)) if tests else items


def official_kept(football: tuple[str, ...]) -> Column:
    """Whether an official candidate is kept: it has a tag and, but for the house source,
    a keyword of football."""
    tagged = (F.size("issueTags") > 0) | (F.size("personTags") > 0)
    return tagged & ((F.col("sourceId") == "kfa_media") | F.arrays_overlap("matchedKeywords", F.array(*map(F.lit, football))))


# Orders


def newest_first(position: str = "_pos") -> list[Column]:
    """Latest publication, latest collection, higher score; then the place in the input."""
    return [F.desc("published_ms"), F.desc("collected_ms"), F.desc("relevanceScore"), F.asc(position)]


def most_relevant_first(position: str = "_pos") -> list[Column]:
    return [F.desc("relevanceScore"), *newest_first(position)]


def related_first() -> list[Column]:
    return [F.desc("published_ms"), F.desc("collected_ms"), F.desc("relevanceScore"), F.asc(F.collate("id", "ko")), F.asc("id")]


def locale_order(c: str) -> list[Column]:
    """The Korean order and, where it makes no difference, that of code units."""
    return [F.asc(F.collate(c, "ko")), F.asc(c)]


# Pages

DEFAULT_LIMIT, MOST_LIMIT = 30, 100


@dataclass(frozen=True)
class Page:
    offset: int = 0
    limit: int = DEFAULT_LIMIT

    @staticmethod
    def of(offset: str | int | None = None, limit: str | int | None = None) -> Page:
        """Only whole numbers written as such count; a limit is 1 to MOST_LIMIT."""

        def whole(value: str | int | None, other: int, least: int, most: int) -> int:
            text = str(value) if value is not None else ""
            if not (text.isascii() and text.isdigit()) or str(int(text)) != text:
                return other
            return min(most, max(least, int(text)))

        return Page(whole(offset, 0, 0, 2**53 - 1), whole(limit, DEFAULT_LIMIT, 1, MOST_LIMIT))


class SnapshotMismatch(ValueError):
    """A later page was asked for of another snapshot than the current."""


def check_snapshot(page: Page, asked: str | None, current: str) -> None:
    if page.offset > 0 and asked != current:
        raise SnapshotMismatch(f"{asked} is not {current}")


@dataclass
class PageResult:
    rows: DataFrame
    total: int = 0
    total_items: int = 0
    has_more: bool = False
    page: Page = field(default_factory=Page)


def page_of(rows: DataFrame, order: list[Column], page: Page, items: Column | None = None) -> PageResult:
    """The page's rows in order, with the number of all rows and of their items."""
    counts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(items if items is not None else F.lit(1)), F.lit(0)).alias("m")).first()
    part = rows.orderBy(*order).offset(page.offset).limit(page.limit)
    return PageResult(part, counts["n"], counts["m"], page.offset + page.limit < counts["n"], page)


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group in an order, ranked from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= n)

"""Duplicate resolution of items, with state that later runs go on from.

Items that share a canonical URL, a story (title, publisher and time) or, within a day,
a title and publisher are one.  Joins split the items into components that share no key
at all; within a component an ordered merge decides, because it depends on the order of
publication.  Keys are stars around their smallest item, so a key of n items costs n
edges, and an item whose keys are all its own never leaves the JVM.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right, insort
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedweave.functions import text as X
from feedweave.functions.url import canonical, canonical_url
from feedweave.operators.components import components, cut
from feedweave.operators.items import ITEM

DAY_MS = 24 * 60 * 60 * 1000
_ACCUMULATED = ("collectedAt", "publishedAt", "discoveryQueries", "dedupeState")


def near_key() -> F.Column:
    title = F.lower(X.squeeze("title"))
    return F.concat_ws("|", "type", "sourceType", title, F.lower(X.trimmed("publisher")))


def story_key() -> F.Column:
    return F.concat_ws("|", near_key(), "publishedAt")


def _near(item: dict) -> str:
    title = " ".join(item["title"].split()).lower()
    return "|".join((item["type"], item["sourceType"], title, item["publisher"].strip().lower()))


def millis(text: str | None) -> float:
    """Milliseconds since 1970; not a number if it is no date."""
    try:
        return round(datetime.fromisoformat((text or "").replace("Z", "+00:00")).timestamp() * 1000)
    except ValueError:
        return float("nan")


def serialized(value) -> str:
    """JSON with sorted keys and without null fields."""

    def bare(v):
        if isinstance(v, dict):
            return {k: bare(x) for k, x in v.items() if x is not None}
        return [bare(x) for x in v] if isinstance(v, list) else v

    return json.dumps(bare(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def korean_key(text: str) -> tuple:
    """An order like that of Korean dictionaries: marks, digits, Hangul, Latin with lower
    case first, then the rest; code units where that makes no difference."""

    def one(c: str) -> tuple:
        if "가" <= c <= "힣" or "ㄱ" <= c <= "ㆎ":
            return 3, c
        if c.isdigit():
            return 2, c
        return (4, c.lower()) if c.isalpha() else (1, c)

    return tuple(map(one, text)), tuple(c.isupper() for c in text), text.encode("utf-16-be")


def sorted_set(values) -> list[str]:
    return sorted(set(values), key=korean_key)


class Group:
    """Items found to be one: the item that stands for them, their keys and bounds."""

    def __init__(self, item: dict):
        state = item.get("dedupeState") or {}
        time, seen = millis(item["publishedAt"]), millis(item["collectedAt"])
        self.item = item
        self.rank = serialized({k: v for k, v in item.items() if k not in _ACCUMULATED})
        self.urls = {canonical(item["url"]), canonical(item["originalUrl"]), *map(canonical, state.get("urls") or ())}
        # a kept state's stories are those that were seen; its own time may be another's
        self.stories = set(state["stories"]) if state else {f"{_near(item)}|{item['publishedAt']}"}
        self.near = {_near(item), *(state.get("nearKeys") or ())}
        self.earliest = _least(time, state.get("earliestPublishedAt"))
        self.latest = _most(time, state.get("latestPublishedAt"))
        self.last_seen = _most(seen, state.get("latestCollectedAt"))
        self.chosen_at = state["representativeCollectedAt"] if state else seen

    def outranked_by(self, other: Group) -> bool:
        if bool(self.item["isOfficial"]) != bool(other.item["isOfficial"]):
            return bool(other.item["isOfficial"])
        if self.chosen_at != other.chosen_at:
            return other.chosen_at > self.chosen_at
        return other.rank.encode("utf-16-be") > self.rank.encode("utf-16-be")

    def take(self, other: Group) -> None:
        """Merge another group into this one."""
        mine, theirs = self.item, other.item
        wins = self.outranked_by(other)
        queries = sorted_set([*(mine.get("discoveryQueries") or ()), *(theirs.get("discoveryQueries") or ())])
        first = lambda f: theirs[f] if millis(theirs[f]) < millis(mine[f]) else mine[f]
        self.item = {**(theirs if wins else mine), "collectedAt": first("collectedAt"), "publishedAt": first("publishedAt"), "discoveryQueries": queries or None}
        if wins:
            self.rank, self.chosen_at = other.rank, other.chosen_at
        self.last_seen = _most(self.last_seen, other.last_seen)
        self.earliest, self.latest = _least(self.earliest, other.earliest), _most(self.latest, other.latest)
        self.urls |= other.urls
        self.stories |= other.stories
        self.near |= other.near

    def result(self) -> dict:
        """The item, with a state where it can't be told from the item itself."""
        item = {**self.item, "dedupeState": None}
        time, seen = millis(item["publishedAt"]), millis(item["collectedAt"])
        plain = Group(item)
        same = (self.urls, self.stories, self.near) == (plain.urls, plain.stories, plain.near)
        if not same or (self.earliest, self.latest, self.chosen_at, self.last_seen) != (time, time, seen, seen):
            item["dedupeState"] = {"version": 1, "urls": sorted_set(self.urls), "stories": sorted_set(self.stories), "nearKeys": sorted_set(self.near)} | {
                k: None if v != v else int(v) for k, v in (("earliestPublishedAt", self.earliest), ("latestPublishedAt", self.latest), ("representativeCollectedAt", self.chosen_at), ("latestCollectedAt", self.last_seen))
            }
        return item


def _least(a: float, b: float | None) -> float:
    return min((x for x in (a, b) if x is not None and x == x), default=float("nan"))


def _most(a: float, b: float | None) -> float:
    return max((x for x in (a, b) if x is not None and x == x), default=float("nan"))


def _fits(groups: list[Group]) -> bool:
    """Whether all that the groups span is within a day."""
    times = [t for g in groups for t in (g.earliest, g.latest)]
    return all(t == t for t in times) and max(times) - min(times) <= DAY_MS


def _around(groups: list[tuple[float, int, Group]], new: Group) -> list[Group]:
    """Groups, in order of their earliest time, whose earliest time is within a day of all times of `new`."""
    low, high = bisect_left(groups, (new.latest - DAY_MS,)), bisect_right(groups, new.earliest + DAY_MS, key=lambda x: x[0])
    return [g for _, _, g in groups[low:high]]


def processing_order(item: dict) -> tuple:
    time = lambda f: m if (m := millis(item[f])) == m else float("-inf")
    parts = ("|".join(str(item[f]) for f in ("type", "sourceType", "id", "url", "originalUrl")), serialized({k: v for k, v in item.items() if k not in _ACCUMULATED}), serialized(item))
    return time("publishedAt"), time("collectedAt"), *(p.encode("utf-16-be") for p in parts)


def resolve(items: list[dict]) -> list[dict]:
    """The ordered merge of items that may be one.

    URLs and stories join groups whatever their times; a title and publisher only while
    all that would be joined spans a day at most, tried in the order of the groups' times.
    Groups of a title are in order of their earliest time, so those within a day are found at once.
    """
    by_key: dict[tuple[str, str], Group] = {}
    by_near: dict[str, list[tuple[float, int, Group]]] = {}
    for number, item in enumerate(sorted(items, key=processing_order)):
        new = Group(item)
        new.number = number
        keys = [*(("url", u) for u in new.urls), *(("story", s) for s in new.stories)]
        found = list({id(g): g for k in keys if (g := by_key.get(k))}.values())
        if new.earliest == new.earliest and new.latest == new.latest:
            near = {id(g): g for n in new.near for g in _around(by_near.get(n, []), new)}.values()
            for g in sorted(near, key=lambda g: (g.earliest, g.latest, korean_key(g.item["id"]))):
                if g not in found and _fits([*found, g, new]):
                    found.append(g)
        target = found[0] if found else new
        for g in found:
            for n in g.near if g.earliest == g.earliest else ():
                del by_near[n][bisect_left(by_near[n], (g.earliest, g.number))]
        for g in [*found[1:], new] if found else ():
            target.take(g)
        if found:
            target.near.add(_near(target.item))
        for g in [*found[1:], new]:  # the keys of the target are its own already
            for k in [*(("url", u) for u in g.urls), *(("story", s) for s in g.stories)]:
                by_key[k] = target
        for n in target.near if target.earliest == target.earliest else ():  # without a time none is near
            insort(by_near.setdefault(n, []), (target.earliest, target.number, target))
    groups = {id(g): g for g in by_key.values()}
    return [g.result() for g in groups.values()]


def keys_of(items: DataFrame) -> DataFrame:
    """(row, key) of every key that an item can meet another by."""
    state = lambda f: F.coalesce(F.col(f"dedupeState.{f}"), F.array().cast("array<string>"))
    tag = lambda kind, c: F.concat(F.lit(kind), c)
    urls = F.transform(state("urls"), lambda u: tag("u:", u))
    stories = F.when(F.col("dedupeState").isNull(), F.array(tag("s:", story_key()))).otherwise(F.transform(state("stories"), lambda s: tag("s:", s)))
    near = F.concat(F.array(tag("n:", near_key())), F.transform(state("nearKeys"), lambda n: tag("n:", n)))
    own = F.array(tag("u:", canonical_url("url")), tag("u:", canonical_url("originalUrl")))
    return items.select("row", F.explode(F.array_distinct(F.concat(own, urls, stories, near))).alias("key"))


def _parted(keys: DataFrame, items: DataFrame) -> DataFrame:
    """`keys` with those of titles and publishers parted where two neighbours in time are more than two days
    from each other: a title joins what is within a day (two, as times without a zone may be read in another).
    A title of which a row has a time that isn't known stays whole."""
    times = items.select("row", F.unix_millis(F.try_to_timestamp("publishedAt")).alias("published"), F.col("dedupeState.earliestPublishedAt").cast("long").alias("kept"))
    titles = keys.where(F.startswith("key", F.lit("n:"))).join(times, "row").withColumn("ms", F.least("published", "kept"))
    order = Window.partitionBy("key").orderBy("ms")
    gap = F.when(F.col("ms") - F.lag("ms").over(order) > 2 * DAY_MS, 1).otherwise(0)
    whole = F.max(F.col("published").isNull()).over(Window.partitionBy("key"))
    titles = titles.withColumns({"gap": gap, "whole": whole}).withColumn("part", F.when(F.col("whole"), 0).otherwise(F.sum("gap").over(order)))
    return keys.where(~F.startswith("key", F.lit("n:"))).unionByName(titles.select("row", F.concat("key", F.lit("|"), "part").alias("key")))


def with_components(items: DataFrame) -> DataFrame:
    """`items` (with a column row) with the component of each row; rows that share no key
    have none."""
    keys = cut(_parted(keys_of(items), items))
    hubs = keys.groupBy("key").agg(F.min("row").alias("hub"), F.count("*").alias("n")).where("n > 1")
    edges = keys.join(hubs, "key").where("row <> hub").select(F.col("row").alias("a"), F.col("hub").alias("b"))
    found = components(edges).withColumnRenamed("node", "row")
    return items.join(found, "row", "left")


def dedupe(items: DataFrame) -> DataFrame:
    """One item for each group of duplicates; columns as in ITEM.

    Rows with null titles, publishers or URLs count as empty texts there.  A component is
    resolved in one task; its size is what one chain of shared keys holds.
    """
    texts = ("id", "type", "sourceType", "title", "publisher", "url", "originalUrl", "publishedAt", "collectedAt")
    rows = items.select(*(F.coalesce(c, F.lit("")).alias(c) if c in texts else F.col(c) for c in ITEM.fieldNames()))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    split = with_components(rows)
    alone = split.where("component is null").select(*ITEM.fieldNames())

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"json": [json.dumps(r, ensure_ascii=False) for r in resolve([_plain(json.loads(j)) for j in frame["json"]])]})

    grouped = split.where("component is not null").select("component", F.to_json(F.struct(*ITEM.fieldNames())).alias("json"))
    merged = grouped.groupBy("component").applyInPandas(merge, "json string")
    merged = merged.select(F.from_json("json", ITEM).alias("item")).select("item.*")
    return alone.unionByName(merged)


def _plain(item: dict) -> dict:
    return {f: item.get(f) for f in ITEM.fieldNames()}

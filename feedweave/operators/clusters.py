"""Stories: items about one event, every pair of which matches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.functions import text as X
from feedweave.operators.components import components, cut
from feedweave.operators.dedupe import korean_key
from feedweave.operators.similarity import compare, model, pairs_within

HOUR = 60 * 60 * 1000
# Windows, similarities and sizes that stories are told by.
NEWS_WINDOW, VIDEO_WINDOW = 36 * HOUR, 72 * HOUR
STRONG_TITLE, TAGGED_TITLE, SHORT_EXACT_SUMMARY, EXACT_LENGTH = 0.57, 0.55, 0.30, 10
ANCHOR_LEAST, ANCHOR_MOST = 3, 30
VIDEO_STRONG, VIDEO_TITLE, VIDEO_CONTENT = 0.55, 0.35, 0.30
OPINION = "(?:칼럼|사설|기고|오피니언|데스크|유레카|시론|논설)"
SERIES = (
    "(?i)^(?:(?:뉴스9|스포츠뉴스|오늘의(?:한국)?축구(?:뉴스|소식|브리핑)?|(?:축구|스포츠)?경기하이라이트)"
    "|(?:주간|월간|데일리)(?:한국)?(?:축구|스포츠|축구협회)(?:뉴스|소식|브리핑)?)"
    r"(?:(?:20\d{2}년)?\d{1,2}월\d{1,2}일|(?:20\d{2})?\d{3,4}|다시보기|full|제?\d+(?:회|화|편)|\d+부)*$"
)
DURATION_ANCHOR, DISTINCT_ANCHOR = "(?:년|개월|일)$", "(?:배|억원|만원)$"


def story_rows(items: DataFrame) -> DataFrame:
    """What clustering reads of items: videos by summary and tags, times in milliseconds."""
    video = F.col("type") == "youtube"
    return items.where(F.col("type").isin("news", "youtube")).select(
        "id",
        "type",
        "title",
        F.when(video, X.join_summary_and_tags("summary", F.col("youtube.tags"))).otherwise(F.col("summary")).alias("summary"),
        F.lower(X.trimmed(X.nfkc("publisher"))).alias("publisher"),
        F.unix_millis(F.try_to_timestamp("publishedAt")).alias("ms"),
        F.array_distinct(F.concat(F.transform("issueTags", lambda t: F.concat(F.lit("i:"), t)), F.transform("personTags", lambda t: F.concat(F.lit("p:"), t)))).alias("tags"),
        X.normalize_story_text("title").alias("norm"),
    ).withColumn("opinion", F.regexp_like("title", F.lit(OPINION))).withColumn("series", F.regexp_like("norm", F.lit(SERIES)))


def news_match() -> Column:
    """Whether two news items with similarities, l.* and r.*, are of one story."""
    tag = F.arrays_overlap("l.tags", "r.tags")
    guard = F.col("l.opinion") | F.col("r.opinion")
    series = F.col("l.series") | F.col("r.series")
    same = (F.col("l.norm") == F.col("r.norm")) & (F.col("l.norm") != "")
    exact = ~series & ((F.col("l.publisher") == F.col("r.publisher")) | (~guard & (F.length("l.norm") >= EXACT_LENGTH)) | (~guard & tag & (F.col("summary_sim") >= SHORT_EXACT_SUMMARY)))
    t, s = F.col("title_sim"), F.col("summary_sim")
    fuzzy = (t >= STRONG_TITLE) | ((t >= TAGGED_TITLE) & tag) | ((t >= 0.42) & (s >= 0.12)) | ((t >= 0.30) & (s >= 0.34) & tag)
    return F.when(same, exact).otherwise(~guard & ~series & fuzzy)


def video_match() -> Column:
    tag = F.arrays_overlap("l.tags", "r.tags")
    guard = F.col("l.opinion") | F.col("r.opinion") | F.col("l.series") | F.col("r.series")
    same = (F.col("l.norm") == F.col("r.norm")) & (F.col("l.norm") != "")
    t, s = F.col("title_sim"), F.col("summary_sim")
    return ~guard & F.when(same, F.length("l.norm") >= EXACT_LENGTH).otherwise(tag & ((t >= VIDEO_STRONG) | ((t >= VIDEO_TITLE) & (s >= VIDEO_CONTENT))))


def anchors(news: DataFrame, pattern: str = X.FACT_ANCHOR) -> DataFrame:
    """(id, publisher, ms, anchor) of the numeric facts of news rows."""
    return news.select("id", "publisher", "ms", F.explode(X.fact_anchors(X.nfkc("title"), X.nfkc("summary"), pattern)).alias("anchor"))


def bursts(members: DataFrame, window_ms: int = NEWS_WINDOW, least: int = ANCHOR_LEAST) -> DataFrame:
    """Anchors with `least` members of two publishers within a window from some member on.

    A window that begins with a member holds `least` members if the member `least - 1` places on is in it, and a
    second publisher if the next one that isn't the member's is, so a member is looked at once however many are near.
    """
    back = Window.partitionBy("anchor").orderBy(F.desc("ms"), F.desc("publisher"))
    known = members.where("ms is not null")
    ahead, so_far = back.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = F.when(F.col("publisher").isNotNull(), F.struct("publisher", "ms"))
    seen = known.withColumns({"_full": F.lag("ms", least - 1).over(back), "_next": F.last(named, ignorenulls=True).over(ahead)})
    changed = F.when(F.col("_next.publisher") != F.col("publisher"), F.col("_next.ms"))
    other = F.last(changed, ignorenulls=True).over(so_far)
    latest = F.col("ms") + window_ms
    return seen.withColumn("_other", other).where((F.col("_full") <= latest) & (F.col("_other") <= latest)).select("anchor").distinct()


def anchor_stats(members: DataFrame) -> DataFrame:
    """(anchor, members, publishers, span): span null where a time is unknown."""
    span = F.when(F.count("ms") == F.count("*"), F.max("ms") - F.min("ms"))
    return members.groupBy("anchor").agg(F.count("*").alias("members"), F.countDistinct("publisher").alias("publishers"), span.alias("span"))


def qualifying(members: DataFrame) -> DataFrame:
    """Anchors that tell a story: few members, no mere duration, one burst of publishers."""
    stats = anchor_stats(members).where(F.col("members").between(ANCHOR_LEAST, ANCHOR_MOST) & ~F.regexp_like("anchor", F.lit(DURATION_ANCHOR)))
    few = members.join(stats.select("anchor"), "anchor", "left_semi")
    burst = bursts(few).withColumn("burst", F.lit(True))
    single = (F.col("publishers") >= 2) & (F.col("span") <= NEWS_WINDOW)
    repeated = F.regexp_like("anchor", F.lit(DISTINCT_ANCHOR)) & F.coalesce("burst", F.lit(False))
    return stats.join(burst, "anchor", "left").where(F.coalesce(single, F.lit(False)) | repeated).select("anchor", "members")


def matching_pairs(rows: DataFrame, window_ms: int, match: Column) -> DataFrame:
    """(a, b, title_sim, summary_sim, combined) of the pairs that match.

    Every match shares a title trigram or, with an empty set of them, its normalized
    title, so only pairs in the window that share one are compared.
    """
    titled = cut(rows.withColumn("grams", X.trigrams("norm")))
    near = pairs_within(titled.select("id", "ms", "grams"), window_ms, F.arrays_overlap("l.grams", "r.grams"))
    scored = compare(cut(near), rows.select("id", "title", "summary"), cut(model(rows)))
    sides = [titled.drop("grams", "title", "summary").withColumnRenamed("id", f"{x}_id").alias(x) for x in ("l", "r")]
    joined = scored.join(sides[0], F.col("a") == F.col("l_id")).join(sides[1], F.col("b") == F.col("r_id"))
    return joined.where(match).select("a", "b", "title_sim", "summary_sim", "combined")


def burst_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of news with a shared tag and a shared qualifying anchor within the window,
    and (id, anchor, members) of the qualifying anchors."""
    members = cut(anchors(rows))
    chosen = members.join(qualifying(members), "anchor").select("id", "anchor", "members")
    side = cut(chosen.join(rows.select("id", "ms", "tags"), "id"))
    l, r = side.alias("l"), side.alias("r")
    met = (F.col("l.anchor") == F.col("r.anchor")) & (F.col("l.id") < F.col("r.id")) & (F.abs(F.col("l.ms") - F.col("r.ms")) <= NEWS_WINDOW) & F.arrays_overlap("l.tags", "r.tags")
    return l.join(r, met).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct(), chosen


def _order(m: dict) -> tuple:
    return m["ms"] if m["ms"] is not None and m["ms"] == m["ms"] else float("-inf"), korean_key(m["id"])


class _Matcher:
    """Pairs of one component."""

    def __init__(self, pairs: dict[tuple[str, str], float], burst: set[tuple[str, str]]):
        self.pairs, self.burst = pairs, burst

    def story(self, a: dict, b: dict) -> bool:
        return (min(a["id"], b["id"]), max(a["id"], b["id"])) in self.pairs

    def fact(self, a: dict, b: dict) -> bool:
        return (min(a["id"], b["id"]), max(a["id"], b["id"])) in self.burst

    def mean(self, atom: list[dict], members: list[dict]) -> float:
        return sum(self.pairs[min(a["id"], b["id"]), max(a["id"], b["id"])] for a in atom for b in members) / (len(atom) * len(members))


def exact_atoms(members: list[dict], match: _Matcher) -> list[list[dict]]:
    """Members of one normalized title that all match each other; the rest alone."""
    atoms: list[list[dict]] = []
    titled: dict[str, list[list[dict]]] = {}
    for m in members:
        same = titled.setdefault(m["norm"], []) if m["norm"] else []
        home = next((a for a in same if all(match.story(m, x) for x in a)), None)
        if home is not None:
            home.append(m)
        else:
            atoms.append([m])
            same.append(atoms[-1])
    return sorted(atoms, key=lambda a: _order(a[0]))


def burst_clusters(members: list[dict], match: _Matcher) -> list[list[dict]]:
    """Clusters around shared facts: again and again the best candidate of all anchors'
    partitions of the atoms not yet taken."""
    atoms = exact_atoms(members, match)
    by_anchor: dict[str, list[str]] = {}
    for m in members:
        for anchor in m["anchors"]:
            by_anchor.setdefault(anchor, []).append(m["id"])
    taken: set[str] = set()
    out = []
    while True:
        best = None
        for anchor, ids in by_anchor.items():
            free = [a for a in atoms if any(m["id"] in ids for m in a) and not any(m["id"] in taken for m in a)]
            parts: list[list[list[dict]]] = []
            for atom in free:
                home = next((p for p in parts if all(match.fact(x, y) for x in atom for other in p for y in other)), None)
                parts.append([atom]) if home is None else home.append(atom)
            for part in parts:
                if len(part) < 2:
                    continue
                rows = sorted((m for a in part for m in a), key=_order)
                key = (-len(part), -len(rows), -sum(m["id"] in ids for m in rows), _order(rows[0]), korean_key(anchor), korean_key("\0".join(m["id"] for m in rows)))
                if best is None or key < best[0]:
                    best = key, rows
        if best is None:
            return out
        out.append(best[1])
        taken.update(m["id"] for m in best[1])


def greedy_clusters(members: list[dict], match: _Matcher) -> list[list[dict]]:
    """Atoms in order, each into the cluster that it matches throughout with the highest
    mean similarity, the smaller seed of equals, or a new one."""
    clusters: list[list[dict]] = []
    for atom in exact_atoms(members, match):
        fitting = [c for c in clusters if all(match.story(x, y) for x in atom for y in c)]
        if fitting:
            home = min(fitting, key=lambda c: (-match.mean(atom, c), korean_key(c[0]["id"])))
            home += atom
            home.sort(key=_order)
        else:
            clusters.append(list(atom))
    return clusters


def _component(frame: pd.DataFrame) -> pd.DataFrame:
    members, pairs, burst = [], {}, set()
    for r in frame.to_dict("records"):
        if r["kind"] == "member":
            members.append({"id": r["a"], "ms": r["ms"], "norm": r["norm"], "type": r["type"], "anchors": list(r["anchors"]) if r["anchors"] is not None else []})
        elif r["kind"] == "pair":
            pairs[r["a"], r["b"]] = r["combined"]
        else:
            burst.add((r["a"], r["b"]))
    members.sort(key=_order)
    match = _Matcher(pairs, burst)
    found = burst_clusters(members, match) if burst else []
    taken = {m["id"] for c in found for m in c}
    found += greedy_clusters([m for m in members if m["id"] not in taken], match)
    found = [c for c in found if len(c) > 1]
    return pd.DataFrame({"seedItemId": [c[0]["id"] for c in found], "memberIds": [[m["id"] for m in c] for c in found], "ms": [c[0]["ms"] for c in found]}).astype({"seedItemId": "object", "memberIds": "object", "ms": "Int64"})


def build(items: DataFrame) -> DataFrame:
    """(id, seedItemId, memberIds, ms) of every story of two items or more; order by ms and
    the seed.  News and videos have corpora, windows and rules of their own.

    The pairs split the items into components that are clustered one task each; what an
    item matches is within its window, so a component is an event and what overlaps it.
    """
    rows = cut(story_rows(items))
    news, videos = rows.where("type = 'news'"), rows.where("type = 'youtube'")
    facts, chosen = burst_pairs(news)
    facts = cut(facts)
    pairs = cut(matching_pairs(news, NEWS_WINDOW, news_match()).unionByName(matching_pairs(videos, VIDEO_WINDOW, video_match())))
    edges = pairs.select("a", "b").unionByName(facts)
    home = cut(components(edges))
    with_anchors = rows.join(chosen.groupBy("id").agg(F.array_sort(F.collect_set("anchor")).alias("anchors")), "id", "left")
    of = lambda df: df.join(home.withColumnRenamed("node", "a"), "a")
    blank = {"b": "string", "combined": "double", "ms": "long", "norm": "string", "type": "string", "anchors": "array<string>"}
    fill = lambda df, kind: of(df).withColumns({c: F.lit(None).cast(t) for c, t in blank.items() if c not in df.columns}).select("component", F.lit(kind).alias("kind"), "a", *blank)
    parts = fill(with_anchors.select(F.col("id").alias("a"), "ms", "norm", "type", "anchors"), "member").unionByName(fill(pairs.select("a", "b", "combined"), "pair")).unionByName(fill(facts, "fact"))
    found = parts.groupBy("component").applyInPandas(_component, "seedItemId string, memberIds array<string>, ms long")
    return found.select(X.cluster_id("seedItemId").alias("id"), "seedItemId", "memberIds", "ms")


def stats(clusters: DataFrame) -> DataFrame:
    """(clusters, members, largest)."""
    n = F.size("memberIds")
    return clusters.agg(F.count("*").alias("clusters"), F.coalesce(F.sum(n), F.lit(0)).alias("members"), F.coalesce(F.max(n), F.lit(0)).alias("largest"))


def near_misses(items: DataFrame, clusters: DataFrame, least: float = 0.45, limit: int = 100) -> DataFrame:
    """The `limit` most similar pairs of news in the window that are in no common story and
    don't match."""
    rows = cut(story_rows(items).where("type = 'news'"))
    grams = rows.select("id", "ms", X.trigrams("norm").alias("grams"))
    near = cut(pairs_within(grams, NEWS_WINDOW, F.arrays_overlap("l.grams", "r.grams")))
    scored = compare(near, rows.select("id", "title", "summary"), cut(model(rows)))
    sides = [rows.drop("title", "summary").withColumnRenamed("id", f"{x}_id").alias(x) for x in ("l", "r")]
    scored = scored.join(sides[0], F.col("a") == F.col("l_id")).join(sides[1], F.col("b") == F.col("r_id"))
    # stories share no members, so the story of either end tells whether both are in one
    member = clusters.select(F.explode("memberIds").alias("m"), F.col("id").alias("story"))
    missed = scored.where((F.col("title_sim") >= least) & ~news_match())
    for end in ("a", "b"):
        missed = missed.join(member.select(F.col("m").alias(end), F.col("story").alias(f"story_{end}")), end, "left")
    missed = missed.where(~F.coalesce(F.col("story_a") == F.col("story_b"), F.lit(False)))
    return missed.orderBy(F.desc("title_sim"), F.desc("summary_sim"), "a", "b").limit(limit).select("a", "b", "title_sim", "summary_sim", "combined")

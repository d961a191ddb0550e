import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedweave.operators import clusters as K
from feedweave.operators import feed as G
from feedweave.operators import items as I
from feedweave.operators import reports as R
from feedweave.operators import retention as N
from feedweave.operators import similarity as S
from feedweave.operators import validation as V
from feedweave.operators.classify import Classifier, Issue, Near, Person, Rules, classified, segments
from feedweave.operators.components import components


def rows(spark, items):
    usual = {"type": "news", "sourceType": "news", "title": "t", "summary": "", "url": "https://e.example/", "originalUrl": "https://e.example/", "publisher": "p", "publishedAt": "2026-01-10T00:00:00Z", "collectedAt": "2026-01-10T01:00:00Z"}
    usual |= {"matchedKeywords": [], "issueTags": [], "personTags": [], "isOfficial": False, "relevanceScore": 0}
    blank = dict.fromkeys(I.ITEM.fieldNames())
    return spark.createDataFrame([blank | usual | x for x in items], I.ITEM)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(10, 30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 10 for i in range(10, 31)} | {i: 100 for i in range(100, 140)} | {7: 7}


def test_secondary_items_are_hidden_until_searched(spark):
    items = I.feed_items(rows(spark, [{"id": "a", "relevanceTier": "secondary", "title": "Cup"}, {"id": "b", "title": "cup"}, {"id": "v", "type": "youtube", "sourceType": "youtube", "relevanceTier": "secondary", "title": "cup"}]))
    ids = lambda f: sorted(r["id"] for r in I.filter_items(items, f).collect())
    assert ids(I.Filters()) == ["b"]
    assert ids(I.Filters(query="CUP")) == ["a", "b", "v"]
    assert ids(I.Filters(query="cup", type="youtube")) == []
    assert ids(I.Filters(scope="all", type="youtube")) == ["v"]


def test_search_may_span_fields_and_is_literal(spark):
    items = I.feed_items(rows(spark, [{"id": "a", "title": "x 50%", "summary": "off"}]))
    n = lambda q: I.filter_items(items, I.Filters(query=q)).count()
    assert (n("% off"), n("5_%"), n("50%")) == (1, 0, 1)


@pytest.mark.parametrize(("raw", "page"), [(("10", "5"), (10, 5)), (("-1", "0"), (0, 1)), (("01", "1e2"), (0, 30)), ((None, "1000"), (0, 100))])
def test_pages(raw, page):
    assert (I.Page.of(*raw).offset, I.Page.of(*raw).limit) == page


def test_filters_from_parameters():
    f = I.Filters.of({"scope": ["all", "x"], "type": "film", "issue": "i", "q": "  a" + "b" * 300}, issues={"i"})
    assert f == I.Filters("all", "all", "i", "all", "a" + "b" * 199) and I.Filters.of(f.params(), {"i"}) == f
    with pytest.raises(I.SnapshotMismatch):
        I.check_snapshot(I.Page(30), "old", "new")
    I.check_snapshot(I.Page(0), "old", "new")


def test_budgets_are_apart_and_official_is_primary(spark):
    made = [{"id": f"p{i}", "publishedAt": f"2026-01-0{i + 1}T00:00:00Z"} for i in range(5)]
    made += [{"id": f"s{i}", "relevanceTier": "secondary"} for i in range(5)]
    made += [{"id": "o", "type": "official", "sourceType": "official", "relevanceTier": "secondary"}, {"id": "old", "publishedAt": "2025-01-01T00:00:00Z"}, {"id": "none", "publishedAt": "x"}]
    now = F.lit("2026-01-11 00:00:00").cast("timestamp")
    kept = N.retain(rows(spark, made), now, N.Budgets(90, 3, 2, 1), [F.desc("publishedAt"), F.asc("id")])
    assert sorted(r["id"] for r in kept.collect()) == ["o", "p3", "p4", "s0", "s1"]


def test_dice_is_that_of_the_definition(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))) for _ in range(8)]
    docs = spark.createDataFrame([(i, t, texts[-i - 1]) for i, t in enumerate(texts)], "id int, title string, summary string")
    grams = lambda t: Counter([t[i : i + 3] for i in range(len(t) - 2)] if len(t) > 2 else [t] if t else [])
    df = Counter(g for i, t in enumerate(texts) for g in {*grams(t), *grams(texts[-i - 1])})
    idf = {g: math.log((len(texts) + 1) / (n + 1)) + 1 for g, n in df.items()}
    vec = lambda t: {g: n * idf[g] for g, n in grams(t).items()}

    def dice(a, b):
        x, y = vec(a), vec(b)
        every = sum(x.values()) + sum(y.values())
        return 2 * sum(min(v, y.get(g, 0)) for g, v in x.items()) / every if every else 0

    pairs = spark.createDataFrame([(a, b) for a in range(8) for b in range(a + 1, 8)], "a int, b int")
    for r in S.compare(pairs, docs, S.model(docs, F.lower), F.lower).collect():
        t, s = dice(texts[r["a"]], texts[r["b"]]), dice(texts[-r["a"] - 1], texts[-r["b"] - 1])
        assert (r["title_sim"], r["summary_sim"], r["combined"]) == pytest.approx((t, s, 0.75 * t + 0.25 * s))


def test_pairs_within_meet_once(spark):
    rng = random.Random(2)
    times = [rng.randrange(1000) for _ in range(60)]
    got = sorted(tuple(r) for r in S.pairs_within(spark.createDataFrame(list(enumerate(times)), "id int, ms long"), 50).collect())
    assert got == [(a, b) for a in range(60) for b in range(a + 1, 60) if abs(times[a] - times[b]) <= 50]


def stories(spark, items):
    return sorted(sorted(r["memberIds"]) for r in K.build(rows(spark, items)).collect())


def test_stories_are_complete_links_within_the_window(spark):
    same = "Council opens inquiry into stadium contract"
    items = [{"id": "a", "title": same}, {"id": "b", "title": same, "publisher": "q", "publishedAt": "2026-01-11T12:00:00Z"}, {"id": "c", "title": same, "publisher": "r", "publishedAt": "2026-01-11T12:00:01Z"}, {"id": "x", "title": "Weather stays dry"}]
    assert stories(spark, items) == [["a", "b"]]  # c is in b's window but not in a's


@pytest.mark.parametrize(("title", "n"), [("abcdefghij", 1), ("abcdefghi", 0)])
def test_ten_characters_make_an_exact_title(spark, title, n):
    assert len(stories(spark, [{"id": "a", "title": title}, {"id": "b", "title": title, "publisher": "q"}])) == n


def test_facts_make_a_story_of_different_titles(spark):
    facts = [("a", "North bridge", "x"), ("b", "Ferry queue", "y"), ("c", "Tunnel plan", "z")]
    items = [{"id": i, "title": t, "summary": "모두 1,234명", "publisher": p, "issueTags": ["k"]} for i, t, p in facts]
    assert stories(spark, items) == [["a", "b", "c"]]
    assert stories(spark, [x | {"issueTags": []} for x in items]) == []


def test_news_stories_do_not_depend_on_videos(spark):
    news = [{"id": f"n{i}", "title": "Council opens inquiry into contract", "publisher": f"p{i}"} for i in range(3)]
    videos = [{"id": f"v{i}", "type": "youtube", "sourceType": "youtube", "title": "Council opens inquiry into contract", "issueTags": ["k"]} for i in range(2)]
    assert stories(spark, news + videos) == [["n0", "n1", "n2"], ["v0", "v1"]]
    assert stories(spark, news) == [["n0", "n1", "n2"]]


def test_feed_groups_after_filters_and_official_stays_alone(spark):
    made = [{"id": i, "title": t, "relevanceScore": s, "issueTags": g} for i, t, s, g in (("a", "one two", 10, ["k"]), ("b", "one two", 90, ["k"]), ("c", "one two", 50, []))]
    made.append({"id": "o", "type": "official", "sourceType": "official", "title": "one two", "relevanceScore": 99, "issueTags": ["k"]})
    items = I.feed_items(rows(spark, made))
    stories = spark.createDataFrame([("s", "a", ["a", "b", "c", "o"], 1)], "id string, seedItemId string, memberIds array<string>, ms long")
    page = G.feed_page(items, stories, I.Filters(issue="k"), I.Page(0, 1), "relevance")
    assert (page.total, page.total_items, page.has_more) == (2, 3, True)
    assert [r["id"] for r in page.rows.collect()] == ["o"]
    second = G.feed_page(items, stories, I.Filters(issue="k"), I.Page(1, 1), "relevance").rows.first()
    assert (second["id"], second["representative"]["id"], [x["id"] for x in second["related"]], second["itemCount"]) == ("s", "b", ["a"], 2)


def test_new_items_ignore_changed_ids(spark):
    before = rows(spark, [{"id": "a"}, {"id": "b"}])
    after = rows(spark, [{"id": "z"}, {"id": "b"}, {"id": "c"}, {"id": "n", "collectedAt": "2026-01-12T00:00:00Z"}])
    assert R.new_items(after, before).first()["new_items"] == 2


def test_violations(spark):
    bad = rows(spark, [{"id": "a"}, {"id": "a", "relevanceScore": 101, "url": "ftp://x", "type": "film"}, {"id": "c", "issueTags": ["none"]}])
    found = {r["rule"] for r in V.bundle_violations(bad, spark.createDataFrame([("k",)], "id string"), spark.createDataFrame([], "id string"), 4).collect()}
    assert found == {"unique id", "score", "url", "type", "source type", "issue tag", "total"}
    with pytest.raises(V.Invalid):
        V.check(V.item_violations(bad))
    V.check(V.item_violations(rows(spark, [{"id": "a"}])))


RULES = Rules(strong=("Harbour Board",), weak=("board",), near={"board": Near("board", ("election", "audit"), 200)}, high_interest=("audit",), labels={"audit": "mentions an audit"}, base_queries=("Harbour Board",), query_prefix="harbour")
ISSUES = [Issue("vote", ("ballot",), required=(("election", "vote"),), excluded=("school",), priority=2), Issue("money", ("budget",), priority=1)]
PEOPLE = [Person("kim", "Kim", ("Kim",), context=("Board",))]


def test_classifier_scores_and_contexts():
    c = Classifier(RULES, ISSUES, PEOPLE)
    got = c.classify("Harbour Board election ballot. Kim of the Board", "audit of the budget", True)
    assert got["issueTags"] == ["vote", "money"] and got["personTags"] == ["kim"]
    assert got["titleRelevanceScore"] == 20 + 10 + 8 and got["summaryRelevanceScore"] == 4 + 2
    assert got["relevanceScore"] == 30 + 38 + 6 and got["labels"] == ["공식 출처", "인물 언급", "mentions an audit"]
    assert c.classify("school election ballot", "", False)["issueTags"] == []
    assert c.classify("ballot. audit", "", False)["issueTags"] == []  # no segment has a word that is required
    assert c.classify("Kim wins", "Board meets. Later", False)["personTags"] == ["kim"]  # across fields
    assert c.classify("Kim wins. Rain", "Board meets", False)["personTags"] == []
    assert c.search_queries()[:3] == ["Harbour Board", "harbour budget", "harbour ballot"]


def test_segments():
    assert segments("one 1.5 two. three!\n\nfour…five") == ["one 1.5 two", "three", "four", "five"]


def test_classified_frame(spark):
    frame = spark.createDataFrame([("Harbour Board", None, None), (None, None, None)], "title string, summary string, isOfficial boolean")
    assert sorted(r["s"] for r in classified(frame, lambda: Classifier(RULES, ISSUES, PEOPLE)).select(F.col("classification.relevanceScore").alias("s")).collect()) == [0, 20]


def test_videos_in_other_languages():
    from feedweave.operators.classify import multilingual_governance, video_segments

    assert video_segments("a | b - c//d 1/2", None) == ["a", "b", "c", "d 1", "2"]
    assert multilingual_governance("Korean Football Association faces sanction", None)
    assert multilingual_governance("STY dan KFA: sanksi FIFA", "") and not multilingual_governance("KFA", "sanction") and not multilingual_governance("STY KFA sanksi", "")


def test_a_join_without_hot_keys_is_a_left_join(spark):
    from feedweave.operators.components import spread_join

    many = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), (None, 2), ("c", 3)], "k string, n long")
    one = spark.createDataFrame([("a", "x"), ("b", "y"), ("z", "z")], "k string, v string")
    got = spread_join(many, one, "k", "n")
    assert got.columns == ["k", "n", "v"]
    assert sorted(map(str, got.collect())) == sorted(map(str, many.join(one, "k", "left").collect()))


def test_bursts_equal_brute_force_and_look_at_a_member_once(spark):
    rng = random.Random(3)
    rows = [(f"a{rng.randrange(30)}", rng.choice([None, "p", "q", "r"]), rng.choice([None, *range(40)])) for _ in range(400)]
    rows += [("same", "p", i) for i in range(9)] + [("nulls", p, 5) for p in ("p", None, None, "q")]
    frame = spark.createDataFrame(rows, "anchor string, publisher string, ms long")
    for window, least in ((0, 1), (2, 3), (4, 4), (9, 6)):
        want = set()
        for a, _, t in rows:
            near = [p for b, p, u in rows if t is not None and b == a and u is not None and t <= u <= t + window]
            if len(near) >= least and len({p for p in near if p is not None}) >= 2:
                want.add(a)
        found = K.bursts(frame, window, least)
        assert {r["anchor"] for r in found.collect()} == want
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()

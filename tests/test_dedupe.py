import itertools
import random
from datetime import datetime, timedelta, timezone

import pytest

from feedweave.operators.dedupe import DAY_MS, dedupe, resolve
from feedweave.operators.items import ITEM

START = datetime(2026, 3, 1, tzinfo=timezone.utc)


def item(n, ms=0, title="One title", publisher="Daily", url=None, original=None, collected=0, official=False, state=None):
    at = lambda x: (START + timedelta(milliseconds=x)).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    base = dict.fromkeys(ITEM.fieldNames())
    kind = "official" if official else "news"
    return base | {
        "id": f"i{n}",
        "type": kind,
        "sourceType": kind,
        "title": title,
        "summary": f"s{n}",
        "url": url or f"https://example.com/{n}",
        "originalUrl": original or url or f"https://example.com/{n}",
        "publisher": publisher,
        "publishedAt": at(ms),
        "collectedAt": at(ms + collected),
        "matchedKeywords": [],
        "issueTags": [],
        "personTags": [],
        "isOfficial": official,
        "relevanceScore": 10,
        "discoveryQueries": [f"q{n}"],
        "dedupeState": state,
    }


def groups(items):
    return sorted(tuple(sorted(x["discoveryQueries"])) for x in resolve(items))


@pytest.mark.parametrize(("gap", "n"), [(DAY_MS, 1), (DAY_MS + 1, 2)])
def test_a_day_is_the_limit_for_titles(gap, n):
    assert len(resolve([item(1), item(2, gap)])) == n


def test_a_span_covers_the_whole_group():
    assert groups([item(1), item(2, DAY_MS // 2), item(3, DAY_MS + 1)]) == [("q1", "q2"), ("q3",)]


def test_any_order_gives_the_same_groups():
    items = [item(1), item(2, DAY_MS // 3), item(3, DAY_MS), item(4, DAY_MS + 5), item(5, 7, url="https://example.com/1?utm_source=x")]
    assert len({tuple(groups(list(p))) for p in itertools.permutations(items)}) == 1


def test_urls_join_without_a_limit_of_time():
    chain = [item(1, title="a", url="https://a.example/x", original="https://b.example/y"), item(2, 90 * DAY_MS, title="b", url="https://b.example/y", original="https://c.example/z"), item(3, 180 * DAY_MS, title="c", url="https://c.example/z")]
    assert groups(chain) == [("q1", "q2", "q3")]


def test_a_kept_state_goes_on_in_later_runs():
    first = resolve([item(1), item(2, DAY_MS)])
    assert first[0]["dedupeState"]["latestPublishedAt"] - first[0]["dedupeState"]["earliestPublishedAt"] == DAY_MS
    assert len(resolve([*first, item(3, DAY_MS + 1)])) == 2  # the span is kept though the item's own time is its first
    assert len(resolve([*first, item(4, DAY_MS // 2)])) == 1


def test_stories_of_a_state_are_those_seen():
    first = resolve([item(1, title="a", url="https://e.example/1"), item(2, 3 * DAY_MS, title="b", url="https://e.example/1", collected=5)])
    # b's title at a's time was never seen, so an item like that is another story
    assert first[0]["title"] == "b" and first[0]["publishedAt"].startswith("2026-03-01")
    assert all("|b|" not in s or "2026-03-04" in s for s in first[0]["dedupeState"]["stories"])


def test_the_official_item_stands_for_a_group_and_first_times_are_kept():
    found = resolve([item(1, title="t", url="https://e.example/1", official=True), item(2, 1000, title="u", url="https://e.example/1", collected=99)])
    assert len(found) == 1 and found[0]["isOfficial"] and found[0]["publishedAt"].endswith("00:00:00.000Z")


def test_resolving_again_changes_nothing():
    rng = random.Random(5)
    items = [item(n, rng.randrange(5) * DAY_MS // 2, title=rng.choice("abc"), publisher=rng.choice("xy"), url=f"https://e.example/{rng.randrange(12)}") for n in range(25)]
    once = resolve(items)
    assert sorted(x["id"] for x in resolve(once)) == sorted(x["id"] for x in once)


def test_components_give_what_one_pass_over_all_gives(spark):
    rng = random.Random(7)
    items = [item(n, rng.randrange(8) * DAY_MS // 2, title=rng.choice("abcd"), publisher=rng.choice("xyz"), url=f"https://e.example/{rng.randrange(40)}") for n in range(60)]
    got = dedupe(spark.createDataFrame(items, ITEM)).collect()
    assert sorted((r["id"], tuple(r["discoveryQueries"])) for r in got) == sorted((x["id"], tuple(x["discoveryQueries"])) for x in resolve(items))


def test_empty(spark):
    assert dedupe(spark.createDataFrame([], ITEM)).count() == 0


def test_a_title_of_every_week_is_no_component(spark):
    from feedweave.operators.dedupe import with_components

    items = [item(n, n * 7 * DAY_MS) for n in range(30)] + [item(40, DAY_MS // 2), item(41, 7 * DAY_MS + 5)]
    odd = [item(50, title="Odd"), item(51, 40 * DAY_MS, title="Odd") | {"publishedAt": "soon"}, item(52, 90 * DAY_MS, title="Odd")]
    frame = spark.createDataFrame([{"row": i, **x} for i, x in enumerate(items + odd)], "row long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ITEM.fields))
    sizes = {r["component"]: r["count"] for r in with_components(frame).where("component is not null").groupBy("component").count().collect()}
    assert sizes == {0: 2, 1: 2, 32: 3}  # and none of 32 items


def test_many_items_of_a_title_take_time_in_proportion():
    import time

    def took(n):
        began = time.process_time()
        assert len(resolve([item(i, i * 2 * DAY_MS) for i in range(n)])) == n
        return time.process_time() - began

    took(500)
    assert took(8000) < 5 * 4 * took(2000)  # four times the items; every group was tried with each before, sixteen times

"""Paged lists of videos and look-ups, over landed responses."""

import json
from datetime import UTC, datetime

from pyspark.sql import functions as F

from feedweave.sources import videos as S


def land(folder, request, body):
    place = folder / f"request={request}"
    place.mkdir()
    (place / "part-0.txt").write_text(body if isinstance(body, str) else json.dumps(body))


def upload(video, day, privacy=None):
    item = {"contentDetails": {"videoId": video}}
    if day:
        item["contentDetails"]["videoPublishedAt"] = f"2026-01-{day:02d}T00:00:00Z"
    return item | ({"status": {"privacyStatus": privacy}} if privacy else {})


def uploads(folder):
    land(folder, "uploads-A-first", {"nextPageToken": "t2", "items": [upload("a9", 9), upload("a8", 8, "private"), upload("a7", 7, "public")]})
    land(folder, "uploads-A-t2", {"nextPageToken": "t3", "items": [upload("a6", 6), upload("ax", None), upload("a3", 3), {"odd": 1}, 5]})
    land(folder, "uploads-A-t3", {"items": [upload("a2", 2)]})
    land(folder, "uploads-B-first", "{not json")
    land(folder, "uploads-C-first", {"items": None})
    return json.dumps(["A", "B", "C", "D", "A"])


def test_uploads_stop_at_the_cut_off(spark, tmp_path):
    spark.dataSource.register(S.VideoPages)
    pages = spark.read.format("video_pages").options(folder=str(tmp_path), lists=uploads(tmp_path))
    rows = lambda df: sorted((r["page"], r["videoId"]) for r in df.collect())
    assert rows(pages.load()) == [(1, "a7"), (1, "a9"), (2, "a3"), (2, "a6"), (3, "a2")]
    assert rows(pages.option("pages", 1).load()) == [(1, "a7"), (1, "a9")]
    assert rows(pages.option("pages", 5).option("after", "2026-01-05T00:00:00Z").option("before", "2026-01-09T00:00:00Z").load()) == [(1, "a7"), (2, "a6")]


def test_a_lower_bound_is_pushed_to_the_pages(spark, tmp_path):
    spark.dataSource.register(S.VideoPages)
    name = "spark.sql.python.filterPushdown.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        df = spark.read.format("video_pages").options(folder=str(tmp_path), lists=uploads(tmp_path), pushdown="true").load()
        late = df.where(F.col("publishedAt") >= F.lit(datetime(2026, 1, 5, tzinfo=UTC)))
        assert sorted(r["videoId"] for r in late.collect()) == ["a6", "a7", "a9"]
        plan = late._jdf.queryExecution().executedPlan().toString()
        assert "publishedAt" in plan and "Filter (publishedAt" not in plan.replace("isnotnull(publishedAt", "")
    finally:
        spark.conf.set(name, was)


def test_searches_and_where_videos_were_seen(spark, tmp_path):
    spark.dataSource.register(S.VideoPages)
    hit = lambda v, c: {"id": {"videoId": v}, "snippet": {"channelId": c, "publishedAt": "2026-01-01T00:00:00Z"}}
    land(tmp_path, "search-q-first", {"nextPageToken": "x", "items": [hit("v1", "c"), {"id": {}}, hit("v2", "d")]})
    land(tmp_path, "search-q-x", {"nextPageToken": "y", "items": [hit("v1", "c")]})
    land(tmp_path, "search-q-y", {"items": [hit("v9", "c")]})  # beyond the pages of a search
    land(tmp_path, "search-r-first", {"items": [hit("v2", "d")]})
    df = spark.read.format("video_pages").options(folder=str(tmp_path), kind="search", lists='["q", "r"]').load()
    assert sorted((r["videoId"], r["channelId"]) for r in df.collect()) == [("v1", "c"), ("v1", "c"), ("v2", "d"), ("v2", "d")]
    assert {r["videoId"]: r["queries"] for r in S.observed(df, "s:").collect()} == {"v1": ["s:q"], "v2": ["s:q", "s:r"]}


def test_look_ups_ask_in_batches(spark, tmp_path):
    log = str(tmp_path / "asked")

    def client():
        def answer(ids):
            with open(log, "a") as f:
                f.write(f"{len(ids)}\n")
            if "7" in ids:
                raise OSError("no")
            return json.dumps({"items": [{"id": i, "contentDetails": {"duration": "PT1M"}} for i in ids if i != "3"]})

        return answer

    ids = spark.createDataFrame([(str(i),) for i in range(9)] + [("1",), (None,)], "videoId string").coalesce(1)
    got = S.looked_up(ids, client, S.DETAIL_ROW, batch=4).collect()
    assert len(got) == 11 and max(map(int, open(log).read().split())) <= 4
    found = {r["videoId"] for r in got if r["found"]}
    assert "3" not in found and "7" not in found and all(r["found"]["contentDetails"]["duration"] == "PT1M" for r in got if r["found"])
    assert S.looked_up(ids.limit(0), client, S.DETAIL_ROW).count() == 0


def test_details_are_landed_by_shelves_and_each_is_opened_once(spark, tmp_path):
    from pyspark.sql import functions as F

    for k in range(3):
        (tmp_path / f"request=s-{k}").mkdir()
        (tmp_path / f"request=s-{k}" / "part-0").write_text("".join(json.dumps({"id": str(i), "snippet": {"title": f"t{i}\u2028"}}, ensure_ascii=False) + "\n" for i in range(k, 60, 4)))
    opened = spark.sparkContext.accumulator(0)

    def client():
        answer = S.shelved(str(tmp_path), lambda i: f"s-{int(i) % 4}")  # the fourth shelf isn't there

        def counted(ids):
            opened.add(len({int(i) % 4 for i in ids}))
            return answer(ids)

        return counted

    ids = spark.range(64).select(F.col("id").cast("string").alias("videoId"))
    got = {int(r["videoId"]): r["found"] for r in S.looked_up(ids, client, S.DETAIL_ROW, batch=4, place=lambda c: c.cast("int") % 4).collect()}
    assert {i for i, f in got.items() if f} == {i for i in range(60) if i % 4 < 3} and got[5]["snippet"]["title"] == "t5\u2028"
    assert opened.value <= 16 + 6  # 16 batches of 4 ids, of which a few hold ids of two shelves


def test_details_of_parts_make_few_files(spark, tmp_path, monkeypatch):
    from feedweave.plans import sources

    monkeypatch.setattr(sources, "shared_folder", lambda s: str(tmp_path))
    rows = sources.looked_up_details(spark, "/root/testdata/sf0.01")
    n = rows.count()
    assert n == rows.where("title is not null").count() + rows.where("title is null").count() > 0
    assert len(list((tmp_path / "details").glob("request=*/part-*"))) <= n // 1000 + 1

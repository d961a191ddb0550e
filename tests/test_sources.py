import json

import pytest
from pyspark.sql import functions as F

from feedweave.operators.items import ITEM
from feedweave.operators.retention import Budgets
from feedweave.sources import connectors as C
from feedweave.sources import files as P
from feedweave.streaming import runs
from tests.test_operators import rows


def test_shards_replace_the_last_version(spark, tmp_path):
    root = str(tmp_path)
    assert P.read_versions(spark, root).count() == 0
    P.write_shards(rows(spark, [{"id": "a"}, {"id": "b", "publishedAt": "2026-02-01T00:00:00Z"}]), root)
    P.write_shards(P.read_versions(spark, root).drop("shard_date").where("id = 'a'"), root)
    assert [(r["id"], str(r["shard_date"])) for r in P.read_versions(spark, root).collect()] == [("a", "2026-01-10")]


def test_json_shards(spark, tmp_path):
    (tmp_path / "2026-01-10.json").write_text(json.dumps([{"id": "a", "title": "x", "unknown": 1}], indent=1))
    (tmp_path / "notes.json").write_text("[]")
    got = P.read_shards(spark, str(tmp_path))
    assert got.schema == ITEM and [r["id"] for r in got.collect()] == ["a"]
    assert P.read_json(spark, f"{tmp_path}/none.json", P.CLUSTER).count() == 0


def test_snapshots_are_checked(spark, tmp_path):
    root = str(tmp_path)
    clock = [0.0]
    loader = P.SnapshotLoader(spark, root, clock=lambda: clock[0])
    with pytest.raises(P.BadSnapshot):
        loader.get()
    body, manifest = P.serialize(rows(spark, [{"id": "a"}]), {"issues": []}, "2026-01-01T00:00:00Z")
    P.publish(spark, root, body, manifest)
    assert [x["id"] for x in loader.get()["items"]] == ["a"]
    for change in ({"byteLength": 1}, {"sha256": "0"}, {"collectedAt": "x"}):
        with pytest.raises(P.BadSnapshot):
            P.parse(body, manifest | change)
    P.write_text(spark, f"{root}/current.json", "{")
    clock[0] = 61
    assert loader.get() and loader.stale  # the old one is kept


def test_revision_ignores_order(spark):
    a, b = rows(spark, [{"id": "a"}, {"id": "b"}]), rows(spark, [{"id": "b"}, {"id": "a"}])
    assert P.revision(a).first() == P.revision(b.repartition(3)).first()
    assert P.revision(a).first() != P.revision(rows(spark, [{"id": "a"}])).first()


def test_official_pages(spark):
    html = """<table><tr><td class="tit_wrap"><a href="/v?id=1" title="A long enough title">x</a></td><td aria-label="게시일">2026.01.05</td></tr>
    <tr><td class="tit_wrap"><a href="/v?id=1">Again the same link</a></td></tr><tr><td class="tit_wrap"><a href="https://other.example/">Another origin here</a></td></tr></table>"""
    pages = spark.createDataFrame([(1, html, "mcst_press", "https://e.example/list"), (2, "<a href='/z'>short</a><a href='/y'>Long enough text</a>", "any", "https://e.example/"), (3, None, "any", None)], "k int, h string, s string, b string")
    got = [tuple(r) for r in C.official_links(pages, "k", "h", "s", "b").orderBy("k").collect()]
    assert got == [(1, "A long enough title", "https://e.example/v?id=1", "2026.01.05"), (2, "Long enough text", "https://e.example/y", None)]


def test_news_rows(spark, tmp_path):
    good = {"title": "<b>A</b> &amp; B", "link": "https://n.example/1", "originallink": "", "description": "d", "pubDate": "Mon, 05 Jan 2026 09:00:00 +0900"}
    (tmp_path / "r.json").write_text(json.dumps({"query": "q", "items": [good, {"title": "no link"}]}))
    got = C.news_items(C.read_news(spark, f"{tmp_path}/r.json")).collect()
    assert [(r["title"], r["publisher"], r["url"]) for r in got] == [("A & B", "n.example", "https://n.example/1")]


def test_retries():
    seen = []

    def fetch():
        seen.append(1)
        return (503, "") if len(seen) < 3 else (200, "ok")

    assert C.fetch_with_retry(fetch, sleep=lambda s: None) == "ok" and len(seen) == 3
    with pytest.raises(OSError):
        C.fetch_with_retry(lambda: (404, ""), sleep=lambda s: None)
    pages = {None: ([1, 2], "b"), "b": ([3, 0], "c"), "c": ([9], None)}
    assert list(C.paged(pages.get, 5)) == [1, 2, 3, 0, 9]
    assert list(C.paged(pages.get, 5, keep=bool)) == [1, 2, 3]


def test_feeds(spark):
    items = rows(spark, [{"id": "a", "title": "x <y>"}, {"id": "b", "publishedAt": "2026-01-12T00:00:00Z"}])
    text = P.rss(items, "T", "https://e.example")
    assert text.index("<guid>b</guid>") < text.index("<guid>a</guid>") and "x &lt;y&gt;" in text
    latest = spark.createDataFrame([("k", "2026")], "id string, latest string")
    assert P.sitemap("https://e.example", ["/"], latest, latest).count() == 3


def test_a_run_and_its_stream(spark, tmp_path):
    now = F.lit("2026-01-11 00:00:00").cast("timestamp")
    old, new = rows(spark, [{"id": "a", "title": "q"}]), rows(spark, [{"id": "b", "title": "q"}, {"id": "c", "title": "w", "url": "https://e.example/c", "originalUrl": "https://e.example/c"}])
    run = runs.prepare(old, new, now, 2, 1, 1)
    assert (run.items.count(), run.status) == (2, "partial")
    landed = tmp_path / "landed"
    new.unionByName(old).write.parquet(str(landed))
    for _ in range(2):
        runs.stream_items(spark.readStream.schema(ITEM).parquet(str(landed)), str(tmp_path / "out"), str(tmp_path / "state"), lambda: now, Budgets()).awaitTermination()
    assert P.read_versions(spark, str(tmp_path / "out")).count() == 2


def test_states_after_runs():
    r = lambda a, s, f: {"attempted": a, "succeeded": s, "failed": f}
    out = runs.collector_states({"x": {"lastCollectedAt": "old", "lastRunStatus": "success"}}, {"x": r(2, 0, 2), "y": r(0, 0, 0)}, {"x": 5}, {}, "now")
    assert out["x"]["lastCollectedAt"] == "old" and out["x"]["lastRunStatus"] == "failed" and out["y"]["lastRunStatus"] == "never"
    assert runs.blocking_failures([("x", r(1, 0, 1), True), ("y", r(1, 0, 1), False)]) == ["x"]


def test_a_lost_pointer_is_no_empty_table(spark, tmp_path):
    root = str(tmp_path)
    for name in "ab":
        P.write_shards(rows(spark, [{"id": name}]), root)
    (tmp_path / "current.json").unlink()
    with pytest.raises(P.LostPointer):
        P.read_versions(spark, root)


def test_a_step_that_fails_leaves_the_last_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    story = spark.createDataFrame([("s", "a", ["a", "b"])], P.CLUSTER)
    P.write_shards(rows(spark, [{"id": "a"}, {"id": "b"}]), root, story)
    broken = story.select("id", "seedItemId", F.raise_error(F.lit("no")).alias("memberIds"))
    with pytest.raises(Exception, match="no"):
        P.write_shards(rows(spark, [{"id": "c"}]), root, broken)  # after the items, before the stories
    monkeypatch.setattr(P, "_replace", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError, match="stopped"):
        P.write_shards(rows(spark, [{"id": "d"}]), root, story)  # before the pointer
    monkeypatch.undo()
    assert sorted(r["id"] for r in P.read_versions(spark, root).collect()) == ["a", "b"]
    assert [r["memberIds"] for r in P.read_stories(spark, root).collect()] == [["a", "b"]]
    P.write_shards(rows(spark, [{"id": "e"}]), root)
    assert P.read_stories(spark, root).count() == 0 and len(P.drop_old_versions(spark, root, 1)) == 3
    assert [r["id"] for r in P.read_versions(spark, root).collect()] == ["e"] and not list(tmp_path.glob("*.tmp"))


def test_revision_sees_stories_and_videos(spark):
    a = rows(spark, [{"id": "a"}, {"id": "b"}])
    one, two = (spark.createDataFrame([("s", "a", m)], P.CLUSTER) for m in (["a", "b"], ["a", "c"]))
    seen = {P.revision(a).first()[0], P.revision(a, one).first()[0], P.revision(a, two).first()[0], P.revision(a.withColumn("youtube", F.struct(F.lit("v").alias("videoId")))).first()[0]}
    assert len(seen) == 4 and P.revision(a, one).first() == P.revision(a.repartition(2), one).first()


def test_one_of_many_callers_refreshes(spark, tmp_path):
    import threading

    body, manifest = P.serialize(rows(spark, [{"id": "a"}]), {}, "2026-01-01T00:00:00Z")
    P.publish(spark, str(tmp_path), body, manifest)
    loader, times = P.SnapshotLoader(spark, str(tmp_path)), []
    inner = loader._refresh
    loader._refresh = lambda: (times.append(1), inner())
    callers = [threading.Thread(target=loader.get) for _ in range(6)]
    for c in callers:
        c.start()
    for c in callers:
        c.join()
    assert len(times) == 1 and [r["id"] for r in P.load_items(spark, loader=loader).collect()] == ["a"]
    with pytest.raises(ValueError):
        P.load_items(spark)


def test_the_first_of_late_events_holds(spark, tmp_path):
    source, out = tmp_path / "in", {}
    made = [[(1, "2024-01-05 00:00:00", 7), (1, "2024-01-05 00:00:00", 6), (2, "2024-01-06 00:00:00", 1), (3, None, 9)], [(1, "2024-01-04 00:00:00", 8), (2, "2024-01-07 00:00:00", 2)]]
    for i, part in enumerate(made):
        spark.createDataFrame(part, "k long, t string, id long").select("k", F.col("t").cast("timestamp").alias("t"), "id").coalesce(1).write.mode("append").parquet(str(source))
        events = spark.readStream.schema("k long, t timestamp, id long").parquet(str(source))
        keep = lambda b, n: [out.setdefault(r["k"], []).append(r["id"]) for r in b.collect()]
        runs.stream_first_seen(events, "k", "t", "id").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert out == {1: [6, 8], 2: [1]}


def test_history_reads_each_content_of_a_day_once(spark, tmp_path):
    from feedweave.sources import files as P

    root = str(tmp_path / "items")
    item = lambda i, day, score: {"id": i, "publishedAt": f"2026-01-{day:02d}T00:00:00Z", "relevanceScore": score}
    frame = lambda *rows: spark.createDataFrame([tuple(r.get(f.name) for f in P.ITEM.fields) for r in rows], P.ITEM)
    assert P.history(spark, root).count() == 0
    P.write_shards(frame(item("a", 1, 1), item("b", 2, 1), item("c", 3, 1)), root)
    P.write_shards(frame(item("a", 1, 1), item("b", 2, 5)), root)  # a day as before, one changed, one gone
    P.write_shards(frame(item("a", 1, 1), item("b", 2, 1), item("a", 4, 9)), root)  # and one as at first
    rows = P.history(spark, root)
    assert sorted((r["id"], r["relevanceScore"]) for r in rows.collect()) == [("a", 1), ("a", 9), ("b", 1), ("b", 5), ("c", 1)]
    seen = {r["id"]: r["relevanceScore"] for r in P.first_seen(spark, root).collect()}
    assert seen == {"a": 1, "b": 1, "c": 1}  # of the second day, the newest content
    assert len(rows.inputFiles()) >= 5
    P.drop_old_versions(spark, root, 1)
    assert sorted(r["id"] for r in P.history(spark, root).collect()) == ["a", "a", "b"]
    assert P.read_versions(spark, root).count() == 3


def test_a_day_of_few_items_is_one_file(spark, tmp_path):
    path = P.write_shards(rows(spark, [{"id": f"i{n}", "publishedAt": f"2026-02-{n % 9 + 1:02d}T00:00:00Z"} for n in range(90)]), str(tmp_path))
    from pathlib import Path

    assert len(list(Path(path).glob("shard_date=*/*.parquet"))) == 9

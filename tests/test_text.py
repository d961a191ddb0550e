from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from feedweave.functions import text as X
from feedweave.functions.url import canonical, publisher, resolve


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("url", "form"),
    [
        ("https://youtu.be/abc?t=1", "https://www.youtube.com/watch?v=abc"),
        ("https://m.youtube.com/shorts/x_1/", "https://www.youtube.com/watch?v=x_1"),
        ("https://www.youtube.com/watch?list=1&v=q", "https://www.youtube.com/watch?v=q"),
        ("HTTPS://WWW.Example.COM:443/a/?b=2&a=1&utm_x=1&FBCLID=3#f", "https://www.example.com/a/?a=1&b=2"),
        ("http://example.com/", "http://example.com"),
        ("http://example.com:8080/a?x=a b", "http://example.com:8080/a?x=a+b"),
        (" not a url ", "not a url"),
        (None, None),
    ],
)
def test_canonical_urls(url, form):
    assert canonical(url) == form


def test_resolved_links_stay_on_a_secure_origin():
    assert resolve("/a?b=1", "https://e.example/x/y") == "https://e.example/a?b=1"
    assert resolve("https://other.example/", "https://e.example/") is None
    assert resolve("http://e.example/", "https://e.example/") is None
    assert resolve("javascript:x()", "https://e.example/") is None


def test_publisher(spark):
    assert one(spark, publisher("v"), "https://WWW.Example.com/x") == "example.com"
    assert one(spark, publisher("v"), "nothing") == "출처 미확인"


@pytest.mark.parametrize(("raw", "text"), [("<b>a</b>&amp;&nbsp;c\n d", "a & c d"), ("", ""), (None, None)])
def test_strip_html(spark, raw, text):
    assert one(spark, X.strip_html("v"), raw) == text


def test_strict_stripping_decodes_what_a_semicolon_closes(spark):
    raw = "ein &amp</title> &amp;lt; &#38 &#x26;&nosuch; &ampx; &copy;"
    assert one(spark, X.strip_html("v", strict=True), raw) == "ein &amp &lt; &#38 &&nosuch; &ampx; ©"
    assert one(spark, X.strip_html("v"), raw) == "ein & &lt; & &&nosuch; &x; ©"


def test_the_query_strip_html_leaves_cut_entities(spark, tmp_path):
    from feedweave.plans import feed

    spark.createDataFrame([(1, "<p>und&amp</p>&amp;")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert feed.strip_html(spark, str(tmp_path)).first()["text"] == "und&amp &"


def test_truncate_summary(spark):
    assert one(spark, X.truncate_summary("v", 10), "abcdefgh ijkl") == "abcdefgh..."
    assert one(spark, X.truncate_summary("v", 10), "abcdefghij") == "abcdefghij"


@pytest.mark.parametrize(("text", "grams"), [("", []), ("ab", ["ab"]), ("abcd", ["abc", "bcd"]), ("a😀bc", ["a😀b", "😀bc"]), (None, [])])
def test_trigrams(spark, text, grams):
    assert one(spark, X.trigrams("v"), text) == grams


def test_story_text_is_bare():
    assert X.normalize_story("[속보] 축구협회, 감독 선임 (종합2보)") == "축구협회감독선임"
    assert X.normalize_story("ＫＦＡ Cup!") == "kfacup"


def test_dates(spark):
    at = lambda *a: datetime(*a, tzinfo=timezone.utc).replace(tzinfo=None)
    assert one(spark, X.parse_date("v"), "Mon, 05 Jan 2026 09:00:00 +0900") == at(2026, 1, 5)
    assert one(spark, X.parse_date("v"), "2026-01-05T00:00:00Z") == at(2026, 1, 5)
    assert one(spark, X.parse_date("v"), "soon") is None
    assert one(spark, X.official_date("v", F.lit(None).cast("timestamp")), "등록일 2026.1.5 (월) 9:30") == at(2026, 1, 5, 0, 30)
    assert one(spark, X.duration_seconds("v"), "P1DT2H3M4.6S") == 86400 + 7200 + 180 + 5
    assert one(spark, X.duration_seconds("v"), "3 minutes") == 0


def test_facts(spark):
    row = spark.createDataFrame([("3,000 명 참가", "12억 원과 3000명")], "t string, s string")
    assert row.select(X.fact_anchors("t", "s").alias("r")).first()["r"] == ["3000명", "12억원"]


def test_highlight(spark):
    got = spark.createDataFrame([("aXbx", "x")], "t string, q string").select(X.highlight_parts("t", "q").alias("r")).first()["r"]
    assert [(p["start"], p["text"], p["highlighted"]) for p in got] == [(0, "a", False), (1, "X", True), (2, "b", False), (3, "x", True)]


def test_person_words_and_shorts(spark):
    assert one(spark, X.looks_like_person("v"), "홍 길동") and not one(spark, X.looks_like_person("v"), "감독 선임")
    row = lambda t, tags: spark.createDataFrame([(t, tags)], "t string, g array<string>").select(X.explicit_shorts("t", F.lit(""), "g").alias("r")).first()["r"]
    assert row("a #Shorts", None) and row("a", ["#쇼츠"]) and not row("a #shortstory", ["long"])


def test_lengths_are_in_utf16_units(spark):
    wide = "\U0001f600"
    rows = [(wide * 110,), (wide * 111,), ("a" * 220,), ("a" * 221,), ("a" + wide * 120,), (None,), ("a &amp; b",)]
    got = [r["s"] for r in spark.createDataFrame(rows, "t string").select(X.truncate_summary("t").alias("s")).collect()]
    assert got == [wide * 110, wide * 109 + "...", "a" * 220, "a" * 219 + "...", "a" + wide * 109 + "...", None, "a & b"]
    parts = spark.createDataFrame([(wide + "xAx", "X"), ("abc", ""), ("", "a"), (None, "a")], "t string, q string").select(X.highlight_parts("t", "q").alias("r")).collect()
    assert [[(p["start"], p["text"], p["highlighted"]) for p in r["r"]] if r["r"] else None for r in parts] == [[(0, wide, False), (2, "x", True), (3, "A", False), (4, "x", True)], [(0, "abc", False)], [(0, "", False)], None]


def test_dates_as_shown(spark):
    made = [("2024-01-31 23:30:00", 30), ("2024-02-01 02:00:00", 60 * 5), ("2024-01-31 00:00:00", 60 * 24 * 3), ("2023-12-31 15:00:00", 60 * 24 * 9)]
    df = spark.createDataFrame(made, "t string, m int").select(F.col("t").cast("timestamp").alias("t"), "m")
    now = F.timestamp_millis(F.unix_millis("t") + F.col("m") * 60_000)
    assert [tuple(r) for r in df.select(X.seoul_date("t", now), X.seoul_date("t")).collect()] == [("30분 전", "2024.02.01"), ("5시간 전", "2024.02.01"), ("3일 전", "2024.01.31"), ("2024.01.01", "2024.01.01")]


def test_highlighted_parts_are_handed_on_by_slices():
    import pandas as pd

    texts = pd.Series(["the " * 200_000] * 4 + ["a The", None, ""])
    got = list(X.highlight_parts.func(iter([(texts, pd.Series(["the"] * 7))])))
    assert len(got) > 2 and sum(map(len, got)) == 7  # one list of all parts before
    assert list(got[-1])[-3:] == [[{"start": 0, "text": "a ", "highlighted": False}, {"start": 2, "text": "The", "highlighted": True}], None, [{"start": 0, "text": "", "highlighted": False}]]

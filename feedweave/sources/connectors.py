"""Connectors: landed responses of news, video and official sources as rows."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedweave.functions import text as X
from feedweave.functions.url import canonical_url, publisher, resolve
from feedweave.sources.files import NEWS_ROW, read_json

NEWS_PAGE, VIDEO_PAGE, DETAIL_BATCH = 40, 50, 50
ENVELOPE = T.StructType([T.StructField("query", T.StringType()), T.StructField("items", T.ArrayType(NEWS_ROW))])


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """(query, title, link, original, description, published) of landed search responses, one
    JSON line each; rows without the fields that a news item needs are left out."""
    rows = read_json(spark, path, ENVELOPE, lines=True).select("query", F.explode("items").alias("i")).select("query", "i.*")
    good = F.col("title").isNotNull() & F.col("link").isNotNull() & F.col("description").isNotNull() & F.col("pubDate").isNotNull()
    return rows.where(good).select(
        "query",
        X.strip_inline_html("title").alias("title"),
        "link",
        F.when(F.coalesce("originallink", F.lit("")) != "", F.col("originallink")).otherwise(F.col("link")).alias("original"),
        X.truncate_summary("description").alias("description"),
        X.parse_date("pubDate").alias("published"),
    )


def news_items(rows: DataFrame) -> DataFrame:
    """News rows with their canonical URL, id and publisher."""
    url = rows.withColumn("url", canonical_url("original"))
    return url.withColumns({"id": X.item_id("url"), "publisher": publisher("original")})


def search_url(base: str, **parameters) -> str:
    return f"{base}?{urlencode({k: v for k, v in parameters.items() if v is not None})}"


def chunks(values: list, size: int = DETAIL_BATCH) -> Iterator[list]:
    for i in range(0, len(values), size):
        yield values[i : i + size]


def paged(fetch: Callable[[str | None], tuple[list, str | None]], most: int, keep: Callable[[object], bool] | None = None) -> Iterator:
    """Rows of pages that name the next, `most` pages at most; a page with a row that
    `keep` turns down is the last."""
    token = None
    for _ in range(most):
        rows, token = fetch(token)
        good = [r for r in rows if keep is None or keep(r)]
        yield from good
        if token is None or len(good) < len(rows):
            return


def retryable(status: int) -> bool:
    return status in (408, 429) or status >= 500


def retry_delay(attempt: int, base: float = 0.5, jitter: Callable[[], float] = random.random) -> float:
    """Seconds before another attempt: doubled each time, up to a quarter more."""
    return base * 2 ** (attempt - 1) * (1 + 0.25 * jitter())


def fetch_with_retry(fetch: Callable[[], tuple[int, str]], attempts: int = 3, sleep: Callable[[float], None] | None = None) -> str:
    """The body of a response below 400; network errors and passing states are tried again."""
    import time

    for n in range(1, attempts + 1):
        try:
            status, body = fetch()
        except OSError:
            if n == attempts:
                raise
        else:
            if status < 400:
                return body
            if not retryable(status) or n == attempts:
                raise OSError(f"status {status}")
        (sleep or time.sleep)(retry_delay(n))
    raise OSError("no attempts")


# Links of official pages


@dataclass
class _Node:
    tag: str
    attrs: dict
    children: list
    parent: _Node | None

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def all(self, test) -> Iterator[_Node]:
        for c in self.children:
            if isinstance(c, _Node):
                if test(c):
                    yield c
                yield from c.all(test)

    def up(self, tag: str) -> _Node | None:
        node = self.parent
        while node is not None and node.tag != tag:
            node = node.parent
        return node

    def has(self, name: str) -> bool:
        return name in (self.attrs.get("class") or "").split()


class _Tree(HTMLParser):
    _VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
    _AGAIN = frozenset(("li", "td", "tr", "p"))

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.here = _Node("", {}, [], None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in self._AGAIN and self.here.tag == tag:
            self.here = self.here.parent
        node = _Node(tag, dict(attrs), [], self.here)
        self.here.children.append(node)
        if tag not in self._VOID:
            self.here = node

    def handle_endtag(self, tag):
        node = self.here
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        self.here.children.append(data)


def _squeezed(s: str) -> str:
    return " ".join(s.split())


def _cards(root: _Node, base: str):
    for a in root.all(lambda n: n.tag == "a" and "view_contents" in (n.attrs.get("onclick") or "")):
        found = re.search(r"view_contents\(\s*['\"]?(\w+)['\"]?\s*,\s*['\"]?(\w+)['\"]?", a.attrs["onclick"])
        caption = next(a.all(lambda n: n.has("caption")), None)
        title = _squeezed(next((n.text() for n in caption.all(lambda n: n.tag == "p")), "")) if caption else ""
        date = _squeezed(next((n.text() for n in caption.all(lambda n: n.has("date"))), "")) if caption else ""
        url = resolve(f"/bbs/bbs.php?act=bbs_view&idx={found[1]}&con={found[2]}", base) if found else None
        yield title or _squeezed(a.text()), url, date


def _rows(root: _Node, base: str):
    for a in _links(root, "tit_wrap"):
        title = a.attrs.get("title") or "".join(n.text() for n in a.all(lambda n: n.has("tit"))) or a.text()
        row = a.up("tr")
        date = next((n.text() for n in row.all(lambda n: n.tag == "td" and n.attrs.get("aria-label") == "게시일")), "") if row else ""
        yield _squeezed(title), resolve(a.attrs["href"], base), _squeezed(date)


def _board(root: _Node, base: str):
    for a in _links(root, "tit"):
        found = re.search(r"bbsView\w*\(\s*['\"]?(\w+)", a.attrs["href"])
        url = resolve(f"/sports/bbs/BMSR00001/view.do?boardId={found[1]}&menuNo=200024" if found else a.attrs["href"], base)
        row = a.up("tr")
        mobile = [t for n in (row.all(lambda n: n.tag == "li") if row else ()) if "등록일" in (t := _squeezed(n.text()))]
        wide = [_squeezed(n.text()) for n in (row.all(lambda n: n.tag == "td" and n.has("pc")) if row else ())]
        yield _squeezed(a.text()), url, mobile[0].replace("등록일", "") if mobile else (wide[-1] if wide else "")


def _any_link(root: _Node, base: str):
    for a in root.all(lambda n: n.tag == "a" and n.attrs.get("href")):
        yield _squeezed(a.text()), resolve(a.attrs["href"], base), ""


def _links(root: _Node, cell: str):
    for td in root.all(lambda n: n.tag == "td" and n.has(cell)):
        yield from td.all(lambda n: n.tag == "a" and n.attrs.get("href"))


#: How the pages of each source list what they link to.
LISTINGS = {"kfa_media": _cards, "mcst_press": _rows, "sports_council": _board}
TITLE_LEAST = 8


@F.udtf(returnType=T.StructType([T.StructField(c, T.StringType()) for c in ("title", "url", "date_text")]))
class OfficialLinks:
    """(title, url, date_text) of a page's links on its own origin with a title of eight
    characters or more; the first of each URL."""

    def eval(self, html: str, source: str, base: str):
        seen = set()
        for title, url, date in LISTINGS.get(source, _any_link)(_Tree(html or "").root, base or ""):
            if url and len(title) >= TITLE_LEAST and url not in seen:
                seen.add(url)
                yield title, url, date or None


def official_links(pages: DataFrame, key: str, html: str, source: str, base: str) -> DataFrame:
    """The links of each page, with the page's key."""
    spark = pages.sparkSession
    spark.udtf.register("official_links", OfficialLinks)
    pages.select(F.col(key).alias("k"), F.col(html).alias("h"), F.col(source).alias("s"), F.col(base).alias("b")).createOrReplaceTempView("_official_pages")
    return spark.sql(f"SELECT p.k AS {key}, l.* FROM _official_pages p, LATERAL official_links(p.h, p.s, p.b) l")


# Formats of videos

SHORTS_LONGEST = 180


def video_format(duration="durationSeconds", explicit="explicit", cached="cached", probed="probed"):
    """regular, shorts or unknown: by length, by explicit marks, by what is cached, by a probe."""
    return F.when(F.col(duration) > SHORTS_LONGEST, "regular").when(F.col(explicit), "shorts").otherwise(F.coalesce(F.col(cached), F.col(probed), F.lit("unknown")))


def probe_healthy(shorts: str, regular: str) -> bool:
    """Whether a probe tells the two videos apart that it is known for."""
    return shorts == "shorts" and regular == "regular"

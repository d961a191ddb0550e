"""Main text of web pages by consensus host paths.

Each page is parsed once into blocks of text and a tree of the containers around them,
each with the hash of its generalised path: the tags and classes from the root on,
numbers and identifiers left out.  Containers are scored on the page; Spark adds up the
votes for each path of a host, and every page's text is then taken from the containers
of its host's winning path and of its mates: paths beside it that have a fair share of its
votes, as an article may be split over several elements.  A page without that path uses
its own best container and the containers beside that with a fair share of its score.

What was parsed, without markup and without what is dropped, is kept and read twice: for
the votes, which are summed before they are shuffled, and to meet the host's winner, which
goes to each of the places over which the host's pages are dealt.  The plan is the same
for any number of hosts and no host is a hot key.  Parsing takes time and memory in
proportion to the page, however deep its elements are nested.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedweave.llm import text as tx
from feedweave.llm.session import cut
from feedweave.operators.components import spread_join

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that close an open paragraph.
_CLOSES_P = _BLOCK - {"html", "body", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "optgroup", "option"}
#: Elements that hold no main text wherever they stand.
_DROPPED = frozenset("script style nav footer header aside noscript template button select textarea svg math iframe object canvas audio video map dialog menu title head search input label option".split())
#: Words in classes, ids and roles of elements that hold no main text: wherever they stand, and outside an article only.
_MARKS = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo|promotion|breadcrumbs?|comments?|disqus|replies|respond|cookies?|consent|notices?|popup|modal|newsletter|subscri\w*|signup|menu|menubar|navbar|navigation|sidebar|"
    r"site-?header|page-?header|site-?footer|page-?footer|related|recommend\w*|sharing|social|pagination|complementary|contentinfo)",
    re.I,
)
_OUTSIDE = re.compile(r"(?:banner|notifications?|alerts?|overlay|login|nav|topbar|toolbar|masthead|footer|foot|side|rail|widgets?|share|toc|pager|search|tags)", re.I)
#: What readers say, articles among it.
_TALK = re.compile(r"(?:comments?|disqus|replies|respond)", re.I)
#: Parts that leave a name with a mark, such as comment-list, that of an element that holds nothing else.
_FILLERS = re.compile(
    r"(?:\d+|areas?|articles?|author|bars?|blocks?|body|bottom|box|boxes|btn|buttons?|cards?|container|content|count|form|group|head|header|heading|icons?|inner|items?|left|links?|lists?|main|meta|module|outer|panel|"
    r"posts?|primary|reply|right|secondary|sections?|share|slot|stories|tags|text|thread|title|top|units?|widgets?|wrap|wrapper)",
    re.I,
)
#: Parts of names that say something else of the page, such as with-sidebar.
_OTHERWISE = re.compile(r"(?:has|with|no|without|is|not)[-_]\w+", re.I)
#: Elements that a page's main text often is.
_LIKELY = re.compile(r"(?:^|[\s_-])(?:article|story|post|entry|content|main|body|text)(?:$|[\s_-])", re.I)
#: The share of the winner's votes, or of the best score on a page, from which a container beside it is part of the text.
FAIR = 0.25
#: The share of a page's letters that a marked element may hold before it is taken for the page itself.
MOST = 0.5
#: Weight of articles and main elements.
_WEIGHT = 3.0
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_FAMILIES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt")}


@lru_cache(maxsize=100_000)
def _shape(tag: str, classes: str) -> int:
    names = sorted({re.sub(r"\d+", "#", c.lower()) for c in classes.split()})
    return int.from_bytes(blake2b(".".join([tag, *names]).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def _under(path: int, shape: int) -> int:
    """Hash of the path of an element of a shape below a path, as a 64-bit integer with sign."""
    h = ((path & (1 << 64) - 1) * 0x9E3779B97F4A7C15 + shape) & (1 << 64) - 1
    h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
    return (h ^ h >> 32) - (1 << 63)


def path_of(*shapes: str) -> int:
    """The path of nested containers, each a tag with its classes after points."""
    path = 0
    for s in shapes:
        tag, _, classes = s.partition(".")
        path = _under(path, _shape(tag, classes.replace(".", " ")))
    return path


def _whole(name: str, marks: re.Pattern) -> bool:
    """Whether a name is a mark, or has one and besides only parts that say nothing."""
    parts = [p for p in re.split("[_-]+", name) if p]
    return bool(marks.fullmatch(name)) or (any(marks.fullmatch(p) for p in parts) and all(marks.fullmatch(p) or _FILLERS.fullmatch(p) for p in parts))


@lru_cache(maxsize=100_000)
def _marked(names: str, within: int) -> tuple[bool, bool, bool]:
    """Whether classes, ids and roles mark an element; whether they do if most of its letters
    are in links; and whether it holds what readers say.  Outside of all that is likely to be
    the text (`within` 0) any part of a name is a mark, inside only a whole name."""
    given = [name for name in names.split() if not _OTHERWISE.fullmatch(name)]
    patterns = (_MARKS, _OUTSIDE)[: 1 if within >= _MAIN else 2]
    part = any(m.fullmatch(p) for m in patterns for name in given for p in (name, *re.split("[_-]+", name)))
    whole = any(_whole(name, m) for m in patterns for name in given)
    return whole if within else part, part, any(_whole(name, _TALK) for name in given)


#: What an element is within: a likely container, the main part of the page, an article.
_SOME, _MAIN, _ARTICLE = 1, 2, 3


class _Element:
    __slots__ = ("tag", "container", "dropped", "mark", "within", "talk")

    def __init__(self, tag, container, dropped, mark, within, talk):
        self.tag, self.container, self.dropped, self.mark, self.within, self.talk = tag, container, dropped, mark, within, talk


class Page(HTMLParser):
    """Blocks of a page in order, each with its text, its letters in links, the innermost
    container and the innermost marked element around it (-1: none), and whether it is a
    heading (2: an h1 outside links, 1: another); and the containers, each with its parent
    (-1: none), path and weight.

    An article's own header is part of it, another header is not.  Inside an article and
    inside what is likely to be the text, a name with a mark among other words, such as
    social-policy, counts only on an element that holds mostly links.  Articles among what
    readers say aren't articles of the page.  A form with an article in it is the page."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int, int, int]] = []
        self.parents: list[int] = []
        self.paths: list[int] = []
        self.weights: list[float] = []
        self.marks: list[int] = []  # marked elements, each with the one around it (-1: none)
        self.weak: list[bool] = []  # those that are marked only if they hold mostly links
        self.forms: set[int] = set()
        self.holds: set[int] = set()  # those with an article in them
        self.articles = 0
        self.stack: list[_Element] = [_Element("", -1, False, -1, 0, False)]
        self.open: dict[str, list[int]] = {}  # places of open elements in the stack, by tag
        self.open_blocks: list[int] = [0]
        self.pieces: list[str] = []
        self.linked = 0
        self.feed(html)
        self.close()
        self._flush()
        self._unmark()

    def _flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            top, tag = self.stack[-1], self.stack[self.open_blocks[-1]].tag
            heading = (2 if tag == "h1" and self.linked < len(text) else 1) if tag in _HEADINGS else 0
            self.blocks.append((text, self.linked, top.container, top.mark, heading))
        self.pieces, self.linked = [], 0

    def _pop(self, at: int) -> None:
        while len(self.stack) > at:
            self.open[self.stack.pop().tag].pop()
        while self.open_blocks[-1] >= at:
            self.open_blocks.pop()

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._flush()
        elif tag in ("br", "wbr"):
            self.pieces.append(" " if tag == "br" else "")
        if tag in _VOID:
            return
        if tag in _CLOSES_P and self.stack[self.open_blocks[-1]].tag == "p":
            self._pop(self.open_blocks[-1])
        if tag in _FAMILIES:
            if self.stack[self.open_blocks[-1]].tag == "p":
                self._pop(self.open_blocks[-1])
            if self.stack[self.open_blocks[-1]].tag in _FAMILIES[tag]:
                self._pop(self.open_blocks[-1])
        up = self.stack[-1]
        values = dict(attrs)
        names = " ".join(filter(None, (values.get("class"), values.get("id"), values.get("role"))))
        hidden = "hidden" in values or values.get("aria-hidden") == "true"
        page = tag in ("html", "body")
        marked, partly, talk = _marked(names, up.within) if names and not page else (False, False, False)
        talk = talk or up.talk
        main = (tag in ("article", "main") or values.get("role") == "main") and not talk
        dropped = up.dropped or hidden or (tag in _DROPPED and not (tag == "header" and up.within == _ARTICLE))
        mark = up.mark
        if main and not dropped:
            self.articles += 1
            while mark >= 0 and mark not in self.holds:
                self.holds.add(mark)
                mark = self.marks[mark]
            mark = up.mark
        elif marked or partly or tag == "form":
            mark = len(self.marks)
            self.marks.append(up.mark)
            self.weak.append(not marked and tag != "form")
            if tag == "form":
                self.forms.add(mark)
        container = up.container
        if tag in _BLOCK and tag not in ("p", "html") and not re.fullmatch("h[1-6]|li|t[dhr]|d[dt]", tag):
            container = len(self.parents)
            self.parents.append(up.container)
            self.paths.append(_under(self.paths[up.container] if up.container >= 0 else 0, _shape(tag, values.get("class") or "")))
            self.weights.append(_WEIGHT if main else 1.5 if names and _LIKELY.search(names) else 1.0)
        at = len(self.stack)
        self.open.setdefault(tag, []).append(at)
        if tag in _BLOCK:
            self.open_blocks.append(at)
        within = (_ARTICLE if tag == "article" else _MAIN) if main else _SOME if names and not page and _LIKELY.search(names) else 0
        self.stack.append(_Element(tag, container, dropped, mark, max(up.within, within), talk))

    def handle_startendtag(self, tag, attrs):
        # a slash on a tag that isn't void means nothing in HTML
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in _BLOCK or tag == "br":
            self._flush()
        places = self.open.get(tag)
        # an inline element ends within the block that it began in
        if places and (tag in _BLOCK or places[-1] > self.open_blocks[-1]):
            self._pop(places[-1])

    def handle_data(self, data):
        if not self.stack[-1].dropped:
            self.pieces.append(data)
            if self.open.get("a"):
                self.linked += len(data)

    def unknown_decl(self, data):
        pass

    def _unmark(self) -> None:
        """Leave out the blocks in marked elements.  A mark doesn't count on an element that
        holds an article nor, on a page without articles, on one other than a form that holds
        most of the letters outside links; a page without articles on which no block is left
        keeps all but its forms."""
        letters = [0] * len(self.marks)
        links = [0] * len(self.marks)
        total = 0
        for text, linked, _, mark, _ in self.blocks:
            total += max(0, len(text) - linked)
            if mark >= 0:
                letters[mark] += max(0, len(text) - linked)
                links[mark] += min(len(text), linked)
        for m in range(len(letters) - 1, -1, -1):  # a marked element comes after the one around it
            if self.marks[m] >= 0:
                letters[self.marks[m]] += letters[m]
                links[self.marks[m]] += links[m]
        gone: list[bool] = []
        form: list[bool] = []
        for m, up in enumerate(self.marks):
            form.append((m in self.forms and m not in self.holds) or (up >= 0 and form[up]))
            stays = m in self.holds or (self.weak[m] and links[m] <= letters[m]) or (not self.articles and not form[m] and letters[m] > MOST * total)
            gone.append(not stays or (up >= 0 and gone[up]))
        kept = [b for b in self.blocks if b[3] < 0 or not gone[b[3]]]
        self.blocks = kept if kept or self.articles else [b for b in self.blocks if b[3] < 0 or not form[b[3]]]

    def scores(self) -> list[float]:
        """Score of each container: letters outside links of the blocks in it, more for
        likely elements, less the deeper the blocks stand, so that the closest wins."""
        held = [0.0] * len(self.parents)
        for text, linked, container, _, _ in self.blocks:
            if container >= 0:
                held[container] += max(0, len(text) - 2 * linked)
        for c in range(len(held) - 1, -1, -1):  # a container comes after its parent
            if self.parents[c] >= 0:
                held[self.parents[c]] += 0.7 * held[c]
        return [h * w for h, w in zip(held, self.weights, strict=True)]

    def text(self, path: int | None, mates: Iterable[int] = ()) -> str:
        """Main text from the containers of a path and its mates, or of the best and those
        beside it if the page has none."""
        return _text(*(list(c) for c in zip(*((b[0], b[2], b[4]) for b in self.blocks), strict=True)), *self.containers(), path, mates) if self.blocks else ""

    def containers(self) -> tuple[list[int], list[int], list[float], list[float]]:
        return self.parents, self.paths, self.weights, self.scores()


def _text(texts: list[str], at: list[int], heads: list[int], parents: list[int], paths: list[int], weights: list[float], scores: list[float], path: int | None, mates: Iterable[int] | None) -> str:
    """The blocks in the chosen containers; before them the page's only h1 if it stands in an
    element around them, they have no heading and the page has no main element for them."""

    def inside(chosen: set[int]) -> list[int]:
        held: list[bool] = []
        for c, parent in enumerate(parents):
            held.append(c in chosen or (parent >= 0 and held[parent]))
        return [i for i, c in enumerate(at) if c >= 0 and held[c]]

    chosen = {c for c, p in enumerate(paths) if p == path} if path is not None else set()
    found = inside(chosen)
    if found:
        beside = set(mates or ())
        found = inside(chosen := chosen | {c for c, p in enumerate(paths) if p in beside})
    elif scores:
        best = min(range(len(scores)), key=lambda c: (-scores[c], c))
        if scores[best] > 0 or at:
            same = lambda c: parents[c] == parents[best] and (weights[c] == _WEIGHT) == (weights[best] == _WEIGHT)
            found = inside(chosen := {best} | {c for c, s in enumerate(scores) if s > 0 and s >= FAIR * scores[best] and same(c)})
    if not found:
        return "\n".join(texts)
    lead = [i for i, h in enumerate(heads) if h == 2]
    if len(lead) == 1 and lead[0] < found[0] and not any(heads[i] for i in found) and all(weights[c] < _WEIGHT for c in chosen):
        around = at[found[0]]
        while around >= 0 and around != at[lead[0]]:
            around = parents[around]
        found = [*lead, *found] if around == at[lead[0]] else found
    return "\n".join(texts[i] for i in found)


_PARSED = [("texts", T.BinaryType()), ("at", T.ArrayType(T.IntegerType())), ("heads", T.ArrayType(T.IntegerType())), ("parents", T.ArrayType(T.IntegerType())), ("paths", T.ArrayType(T.LongType())), ("weights", T.ArrayType(T.DoubleType())), ("scores", T.ArrayType(T.DoubleType()))]


def parsed(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, host, texts, at, heads, parents, paths, weights, scores): blocks and
    containers of each page, of which `at` are those of the blocks.  The texts are joined by
    line feeds and compressed, as they are written and shuffled once each.  A null or empty page has none.  The host
    is that of the URL in lower case, without port; null if there is none."""
    schema = T.StructType([T.StructField("key", pages.schema[key].dataType), T.StructField("url", pages.schema[url].dataType), *(T.StructField(n, t) for n, t in _PARSED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                rows = [Page(h.as_py() or "") for h in part.column(2)]
                columns = [
                    pa.array([zlib.compress("\n".join(b[0] for b in p.blocks).encode()) for p in rows], pa.binary()),
                    pa.array([[b[2] for b in p.blocks] for p in rows], pa.list_(pa.int32())),
                    pa.array([[b[4] for b in p.blocks] for p in rows], pa.list_(pa.int32())),
                    pa.array([p.parents for p in rows], pa.list_(pa.int32())),
                    pa.array([p.paths for p in rows], pa.list_(pa.int64())),
                    pa.array([p.weights for p in rows], pa.list_(pa.float64())),
                    pa.array([p.scores() for p in rows], pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], schema.names)
        tx.release()

    host = F.lower(F.regexp_extract("url", r"^\s*[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(key, url, html).mapInArrow(run, schema).withColumn("host", F.when(host != "", host))


def host_paths(read: DataFrame) -> DataFrame:
    """(host, path, mates) from what `parsed` gives: the path with most votes of each host,
    the smallest of equals, and the paths with the same parent that have a fair share of its
    votes; beside an article or main element only others such.  A page gives each container
    the share that its score is of the best, if that is more than a fifth; rows without a
    host have no vote.  Were there more than some dozen mates, their parent would win."""
    ups = F.transform("parents", lambda p: F.coalesce(F.get("paths", p), F.lit(0)))
    one = read.where("host is not null").select("host", F.array_max("scores").alias("most"), F.explode(F.arrays_zip("paths", "scores", "weights", ups.alias("ups"))).alias("c"))
    share = F.round(F.col("c.scores") / F.col("most"), 3)
    main = (F.col("c.weights") == _WEIGHT).alias("main")
    votes = one.where("most > 0 and c.scores > 0.2 * most").select("host", F.col("c.paths").alias("path"), F.col("c.ups").alias("up"), main, (share * 1000).cast("long").alias("vote"))
    summed = votes.groupBy("host", "path").agg(F.sum("vote").alias("vote"), F.min("up").alias("up"), F.max("main").alias("main"))
    best = summed.groupBy("host").agg(F.min(F.struct((-F.col("vote")).alias("order"), "path", "up", "main")).alias("best")).select("host", "best.*")
    beside = summed.withColumnsRenamed({"path": "mate", "main": "alike"}).join(best, ["host", "up"]).where((F.col("mate") != F.col("path")) & (F.col("alike") == F.col("main")) & (F.col("vote") >= -FAIR * F.col("order")))
    mates = beside.groupBy("host").agg(F.sort_array(F.collect_set("mate")).alias("mates"))
    return best.select("host", "path").join(mates, "host", "left")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of each row of `pages`.

    Blocks of the main containers in page order, white space within a block as one space,
    blocks joined by a line feed; nothing is cut.  A null or empty page has text "" and
    n_chars 0.  Rows with null or repeated keys are each extracted; a row whose URL is
    null or has no host uses its own best container.  An empty table gives no rows.
    """
    read = cut(parsed(pages, key, url, html))
    joined = spread_join(read.withColumn("_row", F.monotonically_increasing_id()), host_paths(read).withColumnRenamed("path", "winner"), "host", "_row")
    names = [n for n, _ in _PARSED]
    schema = T.StructType([T.StructField("key", read.schema["key"].dataType), T.StructField("url", read.schema["url"].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                rows = zip(*(part.column(i).to_pylist() for i in range(2, 4 + len(names))), strict=True)
                texts = [_text(zlib.decompress(packed).decode().split("\n"), *row) if row[0] else "" for packed, *row in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], schema.names)
        tx.release()

    out = joined.select("key", "url", *names, "winner", "mates").mapInArrow(run, schema)
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))

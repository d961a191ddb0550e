"""Text functions: Columns where Spark has the parts, pandas UDFs where it hasn't."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from html.entities import html5
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the feed's patterns count it: Java's \s and the Unicode spaces beside it.
SPACE = r"[\s   -     　﻿]"
AUTO_LABEL = "자동 수집"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column | str) -> Column:
    """White space as single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_col(c), f"{SPACE}+", " "), "^ | $", "")


def trimmed(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^{SPACE}+|{SPACE}+$", "")


@F.pandas_udf(T.StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


def decode_closed(text: str) -> str:
    """Entities that a semicolon closes decoded; "&amp" without one, as a cut leaves it, stays as it is."""
    return _CLOSED.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0]), text)


@F.pandas_udf(T.StringType())
def decode_closed_entities(s: pd.Series) -> pd.Series:
    return s.map(decode_closed, na_action="ignore")


def strip_html(c: Column | str, tag: str = " ", strict: bool = False) -> Column:
    """Text without tags (each becomes `tag`), entities decoded, white space squeezed.  As browsers do, old
    names ("&amp") are decoded without a semicolon, too; if `strict`, none is.  The decoder runs in Python; it
    gets the texts with an ampersand and null for the others."""
    bare = F.regexp_replace(_col(c), "<[^>]*>", tag)
    decode = decode_closed_entities if strict else decode_entities
    return squeeze(F.coalesce(decode(F.when(bare.contains("&"), bare)), bare))


def strip_inline_html(c: Column | str) -> Column:
    return strip_html(c, "")


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count two."""
    c = _col(c)
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def utf16_prefix(c: Column | str, units: int) -> Column:
    """The longest beginning of a text that has no more than so many UTF-16 units."""
    wide = F.regexp_replace(F.substring(_col(c), 1, units), r"([\x{10000}-\x{10FFFF}])", "$1\ufdd0")  # a noncharacter after each that counts two
    cut = F.substring(wide, 1, units)
    return F.replace(F.regexp_replace(cut, r"[\x{10000}-\x{10FFFF}]$", ""), F.lit("\ufdd0"), F.lit(""))


def truncate_summary(c: Column | str, limit: int = 220) -> Column:
    """Stripped text; one of more than `limit` UTF-16 units is cut to limit - 1, trimmed,
    with "..." after.  A character of two units isn't split."""
    text = strip_html(c)
    # a text that is longer in characters is longer in units, whatever they are
    over = (F.length(text) > limit) | (utf16_length(F.substring(text, 1, limit)) > limit)
    return F.when(over, F.concat(trimmed(utf16_prefix(text, limit - 1)), F.lit("..."))).otherwise(text)


def search_terms(keywords: Column | str, labels: Column | str) -> Column:
    """Keywords and the labels but the automatic one, joined by spaces."""
    kept = F.filter(F.coalesce(_col(labels), F.array().cast("array<string>")), lambda x: x != AUTO_LABEL)
    return F.array_join(F.concat(_col(keywords), kept), " ")


def join_summary_and_tags(summary: Column | str, tags: Column | str) -> Column:
    parts = F.concat(F.array(F.coalesce(_col(summary), F.lit(""))), F.coalesce(_col(tags), F.array().cast("array<string>")))
    return F.array_join(F.filter(F.transform(parts, trimmed), lambda x: x != ""), " ")


def contains_fold(text: Column | str, word: Column | str) -> Column:
    """Whether `word` occurs in `text` whatever the case, as a literal."""
    return F.contains(F.lower(_col(text)), F.lower(_col(word)))


# Markers that headlines carry before and after their text.
_LEADING = re.compile(r"^\s*(?:[\[({〈《【]?\s*(?:속보|단독|오피셜|공식발표|자막뉴스|종합(?:\s*\d+\s*보?)?)\s*[\])}〉》】]?\s*[:\-–—]?\s*)+")
_TRAILING = re.compile(r"\s*(?:[\[({〈《【]?\s*종합(?:\s*\d+\s*보?)?\s*[\])}〉》】]?|[\[({〈《【]\s*(?:자막뉴스|현장영상|공식|전문|상보)\s*[\])}〉》】])\s*(?:…|\.{3})?\s*$")


def normalize_story(value: str | None) -> str | None:
    """Text for comparison: compatibility form, lower case, no markers, marks or spaces."""
    if value is None:
        return None
    text = unicodedata.normalize("NFKC", value).lower()
    text = _TRAILING.sub("", _LEADING.sub("", text))
    return "".join(c for c in text if unicodedata.category(c)[0] not in "PS" and not c.isspace() and c != "﻿")


@F.pandas_udf(T.StringType())
def normalize_story_text(s: pd.Series) -> pd.Series:
    return s.map(normalize_story, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def trigrams(c: Column | str) -> Column:
    """Character trigrams in order; a shorter text is one of its own, an empty one has none.
    The text is split into characters once, so long texts take time in proportion."""
    c = _col(c)
    chars = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    cut = lambda cs: F.transform(F.sequence(F.lit(0), F.size(cs) - 3), lambda i: F.concat(F.get(cs, i), F.get(cs, i + 1), F.get(cs, i + 2)))
    n = F.coalesce(F.length(c), F.lit(0))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < 3, F.array(c)).otherwise(F.flatten(F.transform(F.array(chars), cut)))


# Fixed value: the units of numeric facts in headlines.
FACT_ANCHOR = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\s*만(?:\s*(?:\d{1,3}(?:,\d{3})+|\d+))?)?(?:\.\d+)?\s*(?:배|명|개월|년|일|곳|개|건|표|%|억\s*원|만\s*원)"


def fact_anchors(title: Column | str, summary: Column | str, pattern: str = FACT_ANCHOR) -> Column:
    """Distinct numeric facts of a title and summary, without spaces and commas."""
    text = F.concat_ws(" ", _col(title), _col(summary))
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.regexp_replace(x, r"[\s,]+", "")))


def title_overlap_ratio(title: Column | str, summary: Column | str) -> Column:
    """Share of a title's different words that occur somewhere in the summary."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(_col(title)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    text = F.lower(_col(summary))
    found = F.size(F.filter(words, lambda w: F.contains(text, w)))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(found / F.size(words))


def title_overlap_count(title: Column | str, summary: Column | str) -> Column:
    """Number of words of two characters or more that title and summary share."""
    words = lambda c: F.filter(F.split(F.lower(_col(c)), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2)
    return F.size(F.array_intersect(words(title), words(summary)))


def completeness(title: Column | str, summary: Column | str) -> Column:
    """0.4 for a title that isn't cut off, 0.3 of the overlap, 0.3 for a summary up to 120 characters."""
    whole = ~F.regexp_like(trimmed(title), F.lit(r"(?:\.{2,}|…+)\s*$"))
    return F.when(whole, 0.4).otherwise(0.0) + 0.3 * title_overlap_ratio(title, summary) + 0.3 * F.least(F.length(trimmed(summary)) / 120, F.lit(1.0))


PART = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("highlighted", T.BooleanType())])


def _split(t: str | None, q: str | None) -> list[dict] | None:
    if t is None:
        return None
    wanted = (q or "").strip()
    pieces = re.split(f"({re.escape(wanted)})", t, flags=re.I) if wanted else [t]  # every second is a match
    starts = accumulate((len(p.encode("utf-16-le")) // 2 for p in pieces), initial=0)
    parts = [{"start": a, "text": p, "highlighted": i % 2 == 1} for i, (a, p) in enumerate(zip(starts, pieces, strict=False)) if p]
    return parts or [{"start": 0, "text": "", "highlighted": False}]


@F.pandas_udf(T.ArrayType(PART), F.PandasUDFType.SCALAR_ITER)
def highlight_parts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A text split at the matches of the query, whatever the case; starts are in UTF-16
    units.  Without a query or a match the text is one part.  Parts are handed on by slices of a batch."""
    from feedweave.operators.evidence import slices

    for batch in batches:
        for texts, queries in slices(*batch):
            yield pd.Series([_split(t, q) for t, q in zip(texts, queries, strict=True)])


#: What SQL puts around matches to split a text at them.
_MARK = "\x01"


def _marked(t: str | None, q: str | None) -> list[dict] | None:
    if t is None:
        return None
    wanted = (q or "").strip()
    pieces = (re.sub(f"({re.escape(wanted)})", rf"{_MARK}\1{_MARK}", t, flags=re.I) if wanted else t).split(_MARK)
    starts = accumulate(map(len, pieces), initial=0)
    return [{"start": a, "text": p, "highlighted": i % 2 == 1} for i, (a, p) in enumerate(zip(starts, pieces, strict=False)) if p]


@F.pandas_udf(T.ArrayType(PART), F.PandasUDFType.SCALAR_ITER)
def marked_parts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """As highlight_parts, the way SQL has it that splits at marks (chr(1)) put around the matches: starts are
    in characters, an empty text has no part, and marks in the text itself end parts, aren't counted and turn
    what is highlighted behind them."""
    from feedweave.operators.evidence import slices

    for batch in batches:
        for texts, queries in slices(*batch):
            yield pd.Series([_marked(t, q) for t, q in zip(texts, queries, strict=True)])


def normalize_ellipses(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"\.{2,}|…+", " ")


def summary_lead(segments: Column | str) -> Column:
    """The first 100 characters of the first segment."""
    return F.coalesce(F.substring(F.get(_col(segments), 0), 1, 100), F.lit(""))


# Fixed value: words that say that a keyword is a subject and no person's name.
NO_NAME = "축구|협회|감독|사령탑|선임|후보|후임|차기|위원|선거|선출|출마|지원|도전|복귀|감사|해명|사퇴|정관|지도자|유소년|거버넌스|육성|시스템|제도|규정|조사|결과|혁신|개혁|책임|논란|비판|반발|발언|청문회"


def looks_like_person(keyword: Column | str) -> Column:
    """Two to eight Hangul syllables without a word that names a subject."""
    bare = F.regexp_replace(_col(keyword), f"{SPACE}+", "")
    return F.regexp_like(bare, F.lit("^[가-힣]{2,8}$")) & ~F.regexp_like(bare, F.lit(f"(?:{NO_NAME})"))


def xml_escape(c: Column | str) -> Column:
    out = _col(c)
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


# Identifiers


def item_id(url: Column | str) -> Column:
    return F.concat(F.lit("item_"), F.substring(F.sha1(_col(url)), 1, 16))


def cluster_id(seed: Column | str) -> Column:
    return F.concat(F.lit("story_"), F.substring(F.sha2(F.concat(F.lit("cluster-v1:"), _col(seed)), 256), 1, 20))


def video_id(c: Column | str) -> Column:
    return F.concat(F.lit("youtube_"), _col(c))


# Dates and durations


def parse_date(c: Column | str) -> Column:
    """Timestamp of an ISO or mail date; null for anything else."""
    c = _col(c)
    bare = F.regexp_replace(c, r"^\s*[A-Za-z]{3},\s*", "")
    mail = F.when(F.regexp_like(bare, F.lit(r"^\d{1,2} [A-Za-z]{3} \d{4} ")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")))
    return F.coalesce(mail, F.try_to_timestamp(c))


def seoul_date(c: Column | str, now: Column | None = None) -> Column:
    """A timestamp as it is shown: minutes, hours and days ago up to a week with `now`, or
    the date in Seoul."""
    c = _col(c)
    day = F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(c, F.current_timezone()), "Asia/Seoul"), "yyyy.MM.dd")
    if now is None:
        return day
    minutes = F.floor((F.unix_millis(now) - F.unix_millis(c)) / 60_000)
    shown = F.when(minutes < 1, "방금 전").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("분 전")))
    shown = shown.when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("시간 전")))
    return shown.when(minutes < 10_080, F.concat(F.floor(minutes / 1440).cast("string"), F.lit("일 전"))).otherwise(day)


def official_date(c: Column | str, fallback: Column) -> Column:
    """Date and time in Seoul of a text like 2026.1.5 9:30, what is in parentheses left out."""
    bare = F.regexp_replace(_col(c), r"\([^)]*\)", " ")
    pattern = r"(\d{4})[.-](\d{1,2})[.-](\d{1,2})\.?(?:\s+(\d{1,2}):(\d{2}))?"
    part = lambda i: F.regexp_extract(bare, pattern, i)
    pad = lambda i: F.lpad(F.when(part(i) == "", "0").otherwise(part(i)), 2, "0")
    stamp = F.concat(part(1), F.lit("-"), pad(2), F.lit("-"), pad(3), F.lit("T"), pad(4), F.lit(":"), pad(5), F.lit(":00+09:00"))
    return F.coalesce(F.when(part(1) != "", F.try_to_timestamp(stamp)), fallback)


def duration_seconds(c: Column | str) -> Column:
    """Seconds of an ISO-8601 duration of days to seconds; 0 if it is none."""
    pattern = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    part = lambda i: F.coalesce(F.regexp_extract(_col(c), pattern, i).try_cast("double"), F.lit(0.0))
    return F.coalesce(F.floor(part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4) + 0.5).cast("long"), F.lit(0).cast("long"))


def feed_millis(c: Column | str) -> Column:
    """Milliseconds since 1970 of an ISO text or a timestamp; 0 if it is none."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(_col(c).cast("string"))), F.lit(0).cast("long"))


# Marks of short videos.
SHORTS_HASHTAG = r"(?i)(?:^|\s)#(?:shorts?|쇼츠|숏츠)(?=$|\s|[.,!?])"
SHORTS_TAGS = ("short", "shorts", "쇼츠", "숏츠")


def explicit_shorts(title: Column | str, description: Column | str, tags: Column | str) -> Column:
    marked = F.regexp_like(F.concat_ws(" ", _col(title), _col(description)), F.lit(SHORTS_HASHTAG))
    bare = lambda t: F.lower(F.regexp_replace(trimmed(t), "^#", ""))
    return marked | F.exists(F.coalesce(_col(tags), F.array().cast("array<string>")), lambda t: bare(t).isin(*SHORTS_TAGS))

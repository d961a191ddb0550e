"""Rule classification of short texts: organisations, issues, people and a score.

The rules are data (Rules); the functions here only apply them.  A text is cut into
segments, and evidence counts only where all that it needs stands in one segment.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedweave.functions.text import join_summary_and_tags


@dataclass(frozen=True)
class Issue:
    """keywords are evidence; every group of `required` needs one of its words and `context`
    one of them in the segment; a word of `excluded` rules a segment out."""

    id: str
    keywords: tuple[str, ...]
    required: tuple[tuple[str, ...], ...] = ()
    context: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    queries: tuple[str, ...] | None = None
    priority: int = 0


@dataclass(frozen=True)
class Person:
    """A person whose name others may have needs a word of `context` beside it."""

    id: str
    name: str
    keywords: tuple[str, ...]
    context: tuple[str, ...] = ()
    queries: tuple[str, ...] | None = None
    priority: int = 0
    published: bool = True


@dataclass(frozen=True)
class Near:
    """A name counts where one of `words` stands at most `within` characters before or
    after it, as long as the text holds none of `unless`."""

    name: str
    words: tuple[str, ...]
    within: int
    unless: tuple[str, ...] = ()

    def pattern(self) -> re.Pattern:
        words, gap = "|".join(w.replace(" ", r"\s*") for w in self.words), f".{{0,{self.within}}}"
        return re.compile(f"(?:{self.name}){gap}(?:{words})|(?:{words}){gap}(?:{self.name})", re.I)


@dataclass(frozen=True)
class Rules:
    """Organisations that count in full (`strong`), and those that need something about them:
    `near` has the names, each with what has to stand near it, and a word of `domestic` in
    the segment stands for that with the names of `weak`.  A word of `ambiguous` means what
    is meant if the first pattern says so or the second says nothing else."""

    strong: tuple[str, ...]
    weak: tuple[str, ...] = ()
    domestic: tuple[str, ...] = ()
    near: dict[str, Near] = field(default_factory=dict)
    high_interest: tuple[str, ...] = ()
    ambiguous: dict[str, tuple[str, str]] = field(default_factory=dict)
    forbidden_labels: tuple[str, ...] = ()
    labels: dict[str, str] = field(default_factory=dict)
    base_queries: tuple[str, ...] = ()
    query_prefix: str = ""
    subject_words: tuple[str, ...] = ()


OFFICIAL_LABEL, PERSON_LABEL = "공식 출처", "인물 언급"
RESULT = T.StructType(
    [T.StructField(c, T.ArrayType(T.StringType())) for c in ("issueTags", "personTags", "matchedKeywords", "labels", "titleIssueTags", "summaryIssueTags", "titlePersonTags", "summaryPersonTags", "titleMatchedKeywords", "summaryMatchedKeywords")]
    + [T.StructField(c, T.IntegerType()) for c in ("relevanceScore", "titleRelevanceScore", "summaryRelevanceScore")]
)


#: What ends a segment wherever it stands, what closes it if quotes or brackets follow, and these.
_STOPS, _MARKS, _CLOSING = frozenset("\r\n;；…"), frozenset(".!?"), frozenset("\"'’”)}]〉》」』】")


def segments(text: str, stops: frozenset[str] = _STOPS, stroke=lambda text, i: False, strokes: str = "") -> list[str]:
    """Sentences and lines of a text, trimmed, none empty.

    A mark ends a sentence, and quotes and brackets after it are no part of the next; a
    single point beside a digit isn't a mark.  `stroke` says of a place with one of the
    characters `strokes` whether it is an end.
    """
    out, begin, size = [], 0, len(text)
    for found in _ending(stops, strokes).finditer(text):
        i, c = found.start(), found[0]
        if i < begin:
            continue
        near = text[i - 1 : i] + text[i + 1 : i + 2] if i else text[1:2]
        mark = c in _MARKS and (c != "." or "." in near or not any(map(str.isdigit, near)))
        if mark or c in stops or (c in strokes and stroke(text, i)):
            out.append(text[begin:i])
            begin = i + 1
            while mark and begin < size and text[begin] in _CLOSING:
                begin += 1
    out.append(text[begin:])
    return [s for s in map(str.strip, out) if s]


@lru_cache(maxsize=8)
def _ending(stops: frozenset[str], strokes: str) -> re.Pattern:
    return re.compile(f"[{re.escape(''.join(sorted(stops | _MARKS)) + strokes)}]")


_lower = lru_cache(maxsize=2_000)(str.lower)


def has(text: str, word: str) -> bool:
    return _lower(word) in _lower(text)


def distinct(values) -> list[str]:
    return list(dict.fromkeys(values))


@dataclass
class Field:
    """What one field of an item shows."""

    issues: list[str]
    people: list[str]
    keywords: list[str]
    organisations: list[str]
    high: list[str]


class Classifier:
    def __init__(self, rules: Rules, issues: list[Issue], people: list[Person]):
        self.rules, self.issues, self.people = rules, issues, people
        self.near = {name: (n.pattern(), re.compile("|".join(w.replace(" ", r"\s*") for w in n.unless) or r"(?!)", re.I)) for name, n in rules.near.items()}
        self.ambiguous = {k: (re.compile(a), re.compile(b)) for k, (a, b) in rules.ambiguous.items()}

    def _beside(self, name: str, segment: str) -> bool:
        found, other = self.near[name]
        return bool(found.search(segment)) and not other.search(segment)

    def domestic(self, segment: str) -> bool:
        """Whether a segment is about football at home: a word says so, or a name of the
        association that needs others beside it has them."""
        short = [n for n in self.rules.near if n not in self.rules.weak or n in self.rules.strong]
        return any(has(segment, w) for w in self.rules.domestic) or any(self._beside(n, segment) for n in short)

    def _organisation(self, word: str, segment: str) -> bool:
        if word not in self.near:
            return True
        return (word in self.rules.weak and self.domestic(segment)) or self._beside(word, segment)

    def organisations(self, parts: list[str]) -> list[str]:
        """Names with evidence in a segment; one that a longer name found holds is left out."""
        r, whole = self.rules, "\n".join(parts)
        found = [w for w in distinct([*r.strong, *r.weak, *r.near]) if has(whole, w) and any(has(s, w) and self._organisation(w, s) for s in parts)]
        return [w for w in found if not any(len(o) > len(w) and has(o, w) for o in found)]

    def means(self, word: str, text: str) -> bool:
        """Whether an ambiguous word stands for what is meant: said so, or nothing else said."""
        if word not in self.ambiguous:
            return True
        meant, other = self.ambiguous[word]
        return bool(meant.search(text)) or not other.search(text)

    def issue_evidence(self, issue: Issue, parts: list[str]) -> list[str]:
        good = [
            s
            for s in parts
            if not any(has(s, w) for w in issue.excluded) and all(any(has(s, w) for w in group) for group in issue.required) and (not issue.context or any(has(s, w) for w in issue.context))
        ]
        words = distinct([*issue.keywords, *(w for group in issue.required for w in group)])
        return [w for w in words if any(has(s, w) and all(self.means(a, s) for a in self.ambiguous if a in w) for s in good)]

    @staticmethod
    def person_evidence(person: Person, text: str, context: str) -> list[str]:
        found = [w for w in person.keywords if has(text, w)]
        return found if found and (not person.context or any(has(context, w) for w in person.context)) else []

    def cut(self, text: str) -> list[str]:
        return segments(text)

    def both(self, title: str, summary: str) -> tuple[Field, Field]:
        """What title and summary show."""
        return self.field(title), self.field(summary)

    def field(self, text: str) -> Field:
        parts = self.cut(text)
        whole = "\n".join(parts)
        out = Field([], [], [], self.organisations(parts), [])
        out.keywords += out.organisations
        for issue in self.issues:
            if found := self.issue_evidence(issue, parts):
                out.issues.append(issue.id)
                out.keywords += found
        for person in self.people:
            if person.published and any(has(whole, w) for w in person.keywords) and (found := distinct(w for s in parts for w in self.person_evidence(person, s, s))):
                out.people.append(person.id)
                out.keywords += found
        out.high = [w for w in self.rules.high_interest if has(text, w) and self.means(w, text)]
        out.keywords = distinct([*out.keywords, *out.high])
        return out

    def points(self, f: Field, title: bool) -> int:
        """20 or 10 for organisations in a title (6 or 3 below), 10 an issue (4), 8 a person
        (3), and 5 (2) for each of two words of high interest."""
        strong = any(w in self.rules.strong for w in f.organisations)
        names = (20 if strong else 10) if title else (6 if strong else 3)
        issue, person, high = (10, 8, 5) if title else (4, 3, 2)
        return (names if f.organisations else 0) + issue * len(f.issues) + person * len(f.people) + high * min(2, len(f.high))

    def across(self, person: Person, subject: str, context: str) -> list[str]:
        """A person named in a field of one segment, with the context in the other's first."""
        one, lead = self.cut(subject), self.cut(context)[:1]
        return self.person_evidence(person, one[0], lead[0]) if len(one) == 1 and lead else []

    def classify(self, title: str | None, summary: str | None, official: bool | None) -> dict:
        title, summary = title or "", summary or ""
        t, s = self.both(title, summary)
        crossed = [(p.id, w) for p in self.people if p.published for w in distinct([*self.across(p, title, summary), *self.across(p, summary, title)])]
        people = distinct([*t.people, *s.people, *(p for p, _ in crossed)])
        keywords = distinct([*t.keywords, *s.keywords, *(w for _, w in crossed)])
        labels = [OFFICIAL_LABEL] * bool(official) + [PERSON_LABEL] * bool(people) + [label for w, label in self.rules.labels.items() if w in keywords]
        a, b = self.points(t, True), self.points(s, False)
        return {
            "issueTags": distinct([*t.issues, *s.issues]),
            "personTags": people,
            "matchedKeywords": keywords,
            "labels": [x for x in distinct(labels) if x not in self.rules.forbidden_labels],
            "titleIssueTags": t.issues,
            "summaryIssueTags": s.issues,
            "titlePersonTags": t.people,
            "summaryPersonTags": s.people,
            "titleMatchedKeywords": t.keywords,
            "summaryMatchedKeywords": s.keywords,
            "relevanceScore": min(100, 30 * bool(official) + a + b),
            "titleRelevanceScore": a,
            "summaryRelevanceScore": b,
        }

    def search_queries(self, limit: int | None = 100) -> list[str]:
        """Base queries, then those of issues and people by priority, distinct, up to a limit."""
        r = self.rules

        def with_subject(word: str) -> str:
            known = any(has(word, w) for w in (*r.strong, *r.weak, *r.near, *r.subject_words))
            return word if known or not r.query_prefix else f"{r.query_prefix} {word}"

        out = list(r.base_queries)
        for issue in sorted(self.issues, key=lambda i: i.priority):
            out += [with_subject(w) for w in (issue.queries if issue.queries is not None else issue.keywords)]
        for p in sorted(self.people, key=lambda p: p.priority):
            if p.published:
                about = (r.strong[0] if r.strong else "", r.query_prefix, "선거", "해명", "감사")
                out += p.queries if p.queries is not None else [f'"{p.name}" {w}' for w in about]
        return distinct(out)[:limit]


def classified(
    items: DataFrame, make: Callable[[], Classifier], tags: Column | str | None = None, name: str = "classification", title: str = "title", summary: str = "summary", official: Column | str = "isOfficial"
) -> DataFrame:
    """`items` (title, summary, isOfficial) with a struct of what the rules find.

    One Arrow-batched function; `make` makes the classifier in each worker from rules that people
    write by hand, so their size is bounded.
    """
    told = F.col(summary) if tags is None else join_summary_and_tags(summary, tags)

    def run(frames: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        c = make()
        for t, s, o in frames:
            yield pd.DataFrame([c.classify(*row) for row in zip(t, s, o, strict=True)], columns=RESULT.fieldNames())

    found = F.pandas_udf(run, RESULT, F.PandasUDFType.SCALAR_ITER)
    return items.withColumn(name, found(F.coalesce(title, F.lit("")), F.coalesce(told, F.lit("")), F.coalesce(official, F.lit(False))))


#: Columns of an item that a classification replaces.
REPLACED = ("issueTags", "personTags", "matchedKeywords", "labels", "relevanceScore")


def reclassified(items: DataFrame, make: Callable[[], Classifier]) -> DataFrame:
    """`items` with the tags, keywords, score and labels that the rules give now."""
    return classified(items, make).withColumns({f: F.col(f"classification.{f}") for f in REPLACED}).drop("classification")


def scoped(found: Column | str, to: str) -> Column:
    """A classification as if one field, title or summary, were all that there is: its own
    issues, people, keywords and score, with the labels of the whole."""
    c = F.col(found) if isinstance(found, str) else found
    empty = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(c[f"{to}IssueTags"], empty).alias("issueTags"),
        F.coalesce(c[f"{to}PersonTags"], empty).alias("personTags"),
        F.coalesce(c[f"{to}MatchedKeywords"], empty).alias("matchedKeywords"),
        c["labels"].alias("labels"),
        F.coalesce(c[f"{to}RelevanceScore"], F.lit(0)).alias("relevanceScore"),
    )


def kept_news(items: DataFrame, tier: Column | str = "relevanceTier") -> DataFrame:
    """Items without the news that a tier rejects; a null tier and other kinds stay."""
    t = F.col(tier) if isinstance(tier, str) else tier
    return items.where((F.col("sourceType") != "news") | ~F.coalesce(t == "reject", F.lit(False)))


def video_rows(videos: DataFrame, policy: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Videos that are public, were uploaded whole, are no older than `days` and whose channel
    isn't blocked, with the channel's status; null states count as public and processed."""
    public = F.coalesce("privacyStatus", F.lit("public")) == "public"
    whole = F.coalesce("uploadStatus", F.lit("processed")) == "processed"
    young = F.try_to_timestamp(F.col("publishedAt").cast("string")) >= now - F.make_dt_interval(F.lit(days))
    joined = videos.where(public & whole & young).join(policy.select(F.col("channel_id").alias("channelId"), "status"), "channelId", "left")
    return joined.withColumn("channelStatus", F.coalesce("status", F.lit("unlisted"))).drop("status").where("channelStatus <> 'blocked'")


# Videos


_VIDEO_STOPS = _STOPS | frozenset("|｜／‒–—―")


def _video_stroke(text: str, i: int) -> bool:
    """Hyphens in a row or between spaces, and a stroke that is no part of an address."""
    c, before, after = text[i], text[i - 1 : i] if i else "", text[i + 1 : i + 2]
    if c == "-":
        return "-" in (before, after) or (before.isspace() and after.isspace())
    first = len(text[: i + 1]) - len(text[: i + 1].rstrip("/"))
    return text[i - first : i - first + 1] != ":"


# Names of the association, its and a coach's initials, words of football and of governance, in other languages.
_EVIDENCE = {
    "named": r"Korea(?:n)?\s+Football\s+Association|(?:Asosiasi|Federasi)\s+Sepak\s+Bola\s+Korea\s+Selatan|koreanisch\w*\s+Fußball(?:verband)?|(?<![A-Za-z0-9_])KFA(?![A-Za-z0-9_]).{0,140}(?:Shin\s+Tae-yong|Korea\s+Selatan|Sepak\s+Bola\s+Korea|koreanisch\w*\s+Fußball)|(?:Shin\s+Tae-yong|Korea\s+Selatan|Sepak\s+Bola\s+Korea|koreanisch\w*\s+Fußball).{0,140}(?<![A-Za-z0-9_])KFA(?![A-Za-z0-9_])",
    "coach": r"(?<![A-Za-z0-9_])STY(?![A-Za-z0-9_])",
    "initials": r"(?<![A-Za-z0-9_])KFA(?![A-Za-z0-9_])",
    "football": r"Persija|Timnas|pemain|pelatih|sepak\s*bola|FIFA",
    "governance": r"sanction|disciplin|suspension|banned?|sanksi|dihukum|dikenakan\s+sanksi|larangan|disiplin|pemeriksaan\s+disiplin|corrupt\w*|korup\w*|korrupt\w*|skandal\w*|vetternwirtschaft",
}
#: Any of these sets of evidence in one segment will do.
_ENOUGH = ({"named", "governance"}, {"coach", "initials", "football", "governance"})


def video_segments(*fields: str | None) -> list[str]:
    """Parts of titles and descriptions, which are cut at strokes and bars as well."""
    return [s for f in fields for s in segments(f or "", _VIDEO_STOPS, _video_stroke, "-/")]


def multilingual_governance(title: str | None, summary: str | None) -> bool:
    """Whether one segment names the association, or a coach and it by initials with a word
    of football, and a matter of governance."""
    seen = ({kind for kind, pattern in _EVIDENCE.items() if re.search(pattern, s, re.I)} for s in video_segments(title, summary))
    return any(enough <= kinds for kinds in seen for enough in _ENOUGH)

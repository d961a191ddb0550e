"""Tiers of news and videos: an ordered list of rules over the cues of title and summary.

Cues of texts and segments are read once for the classification and the rules
(operators.football, operators.evidence); the first rule that holds decides, and its name is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedweave.functions.text import NO_NAME, join_summary_and_tags
from feedweave.operators.classify import REPLACED, RESULT, Issue, Person, has, multilingual_governance
from feedweave.operators.evidence import Reading, RuleList, View, decide, slices, with_cues
from feedweave.operators.football import FOOTBALL_WORDS, STRONG_ISSUE_WORDS, Football, FootballClassifier
from feedweave.operators.reports import effective_tier

PRIMARY, SECONDARY, REJECT = "primary", "secondary", "reject"
# Words that say little by themselves.
GENERIC, BROAD_AUDIT = frozenset({"축구협회", "축구협회장"}), frozenset({"감사", "축구협회 감사"})
SUBJECT_WORD = re.compile(r"(?:대한\s*축구협회|대한\s*축구협회장|축구협회|축구협회장|축협|KFA|한국\s*축구|대한민국\s*축구)", re.I)
_LEAD = 100
_STRONG, _FOOTBALL = frozenset(STRONG_ISSUE_WORDS), frozenset(FOOTBALL_WORDS)
_NO_NAME = re.compile(NO_NAME)


def looks_like_person(word: str) -> bool:
    """As functions.text.looks_like_person."""
    bare = "".join(word.split())
    return bool(re.fullmatch("[가-힣]{2,8}", bare)) and not _NO_NAME.search(bare)


def _held(words: list[str], segment: str) -> list[str]:
    return [w for w in words if has(segment, w)]


def _person_matter(segment: str, cues: frozenset[str], words: list[str]) -> bool:
    """Whether one of `words` names a person in the segment, and a matter of governance is there, too."""
    here = _held(words, segment)
    return any(map(looks_like_person, here)) and (not cues.isdisjoint(("tracked", "accountable", "person_governance")) or not _STRONG.isdisjoint(here))


def _related(segment: str, cues: frozenset[str], words: list[str], issues: list[str]) -> bool:
    """Whether a segment shows that an issue's words are about the association."""
    if not cues.isdisjoint(("accountable", "national_governance")):
        return True
    if not any(not SUBJECT_WORD.fullmatch(w) and not looks_like_person(w) for w in _held(words, segment)):
        return False
    home = "korean_football_context" in cues and (bool(issues) or not cues.isdisjoint(("tracked", "person_governance")))
    return home or _person_matter(segment, cues, words)


class Seen:
    """Title and summary as the rules see them: each as it is, the headline without its dots, both
    together, the first segment of each, and the title with the summary's beginning; and what was
    classified in them.  Each fact is worked out when a rule asks for it."""

    def __init__(self, football: Football, title: str, summary: str, found: dict):
        self.c = found
        view = lambda text: View(football.cues, football.segments, text)
        first = next(iter(football.segments(title)), "")
        lead = next(iter(football.segments(summary)), "")[:_LEAD]
        self.title, self.summary, self.text = view(title), view(summary), view(f"{title} {summary}")
        self.headline = view(re.sub(r"\.{2,}|…+", " ", title))
        self.title_lead, self.lead, self.start = view(first), view(lead), view(f"{title} {lead}")
        self.people, self.issues = bool(found["titlePersonTags"]), bool(found["titleIssueTags"])
        self.field_people = self.people or bool(found["summaryPersonTags"])
        self.words, self.title_words, self.summary_words = found["matchedKeywords"], found["titleMatchedKeywords"], found["summaryMatchedKeywords"]

    @cached_property
    def governed(self) -> bool:
        return self.text.has("tracked") or self.text.some("accountable", "person_governance")

    @cached_property
    def coach_named(self) -> bool:
        return self.title.has("korean_coach", "coach_replaced")

    @cached_property
    def structures_compared(self) -> bool:
        return {"compared", "structure"} <= self.title.cues and {"home_body", "structure"} <= self.lead.cues and self.summary.has("foreign_body")

    @cached_property
    def compared(self) -> bool:
        return self.structures_compared or self.text.some("kfa_compared") or {"home_body", "compared"} <= self.title_lead.cues

    @cached_property
    def coach_process(self) -> bool:
        shown = self.summary.has("home_name", "kfa") and not self.summary.has("other_kfa")
        return self.headline.any(lambda s, c: "coach_process" in c and ("kfa_context" in c or ("hong" in c and shown)))

    @cached_property
    def coach_in_summary(self) -> bool:
        went_away = not self.title.has("korea_plain") and self.lead.has("was_candidate") and self.start.has("abroad", "left_chain")
        return (not went_away and self.lead.has("coach_summary")) or (self.headline.has("korean_coach") and self.title.has("wanted_coach"))

    @cached_property
    def audit_in_summary(self) -> bool:
        return self.summary.some("korean_football_context") and self.summary.some("ministry_audit")

    @cached_property
    def association_leads(self) -> bool:
        return self.lead.has("national_name") and (self.people or self.start.has("lead_matter"))

    def _person_beside(self, *cues: str) -> bool:
        return self.title.any(lambda s, c: not c.isdisjoint(cues) and any(map(looks_like_person, _held(self.title_words, s))))

    @cached_property
    def local_headline(self) -> bool:
        return self.people and self.issues and self.headline.has("direct") and self._person_beside("local_body")

    @cached_property
    def hearing(self) -> bool:
        about = self.summary.has("hearing_body") or bool(self.c["summaryPersonTags"]) or "kfa-executives" in self.c["issueTags"]
        return {"hearing", "hearing_topic"} <= self.title.cues and about

    @cached_property
    def local_actor(self) -> bool:
        if not (self.people and self.title.has("local_body", "local_coop")):
            return False
        return self.title.has("local_actor_near") or (self.text.has("local_topic") and self.title.has("local_actor_more") and self._person_beside("local_body", "local_coop"))

    @cached_property
    def kept_though_local(self) -> bool:
        return self.title.has("bridge", "local_actor_near") or self.summary.some("home_governance") or self.local_actor or self.local_headline

    @cached_property
    def national_lead(self) -> bool:
        return self.people and self.issues and self.title_lead.some("national_governance")

    @cached_property
    def cooperative(self) -> bool:
        if self.title.some("livestock") or self.summary.some("livestock"):
            return True
        national = self.summary.any(lambda s, c: "home_body" in c and not c.isdisjoint(("kfa_cue", "national")))
        return not national and self.title.has("short") and self.summary.has("coop_cue")

    @cached_property
    def broad_audit(self) -> bool:
        broad = bool(self.words) and (BROAD_AUDIT | GENERIC).issuperset(self.words)
        return broad and "mcst-audit" in self.c["issueTags"] and not self.text.some("strong_audit")

    @cached_property
    def subject(self) -> bool:
        return self.title.has("title_subject") or self.headline.some("national_governance") or self.people

    def _summary_segment(self, s: str, c: frozenset[str]) -> bool:
        if "association_governance" in c or ("korean_football_context" in c and _person_matter(s, c, self.summary_words)):
            return True
        return bool(self.c["summaryPersonTags"]) and "person_governance" in c and any(map(looks_like_person, _held(self.summary_words, s)))

    @cached_property
    def summary_shows(self) -> bool:
        impact = bool(self.c["summaryIssueTags"]) and self.summary.has("impact_near") and self.summary.some("korean_football_context")
        return impact or self.summary.any(self._summary_segment)

    @cached_property
    def governed_play(self) -> bool:
        headline = self.headline.some("accountable", "national_governance")
        return self.title.has("tracked") or headline or self.title.some("bare_structure") or self.title.any(lambda s, c: _person_matter(s, c, self.title_words))

    @cached_property
    def about_person(self) -> bool:
        return self.governed or not _STRONG.isdisjoint(self.words)

    @cached_property
    def about_issue(self) -> bool:
        only_generic = bool(self.words) and GENERIC.issuperset(self.words)
        return bool(self.c["issueTags"]) and not only_generic and not self.broad_audit and self.c["relevanceScore"] >= 20 and self.text.some("korean_football_context")

    @cached_property
    def in_context(self) -> bool:
        if self.text.some("bare_structure"):
            return True
        if self.field_people:
            return self.text.some("korean_football_context") or self.about_person
        if self.c["issueTags"]:
            return self.text.any(lambda s, c: _related(s, c, self.words, self.c["issueTags"]))
        return self.c["relevanceScore"] >= 20 and not _FOOTBALL.isdisjoint(self.words)

    @cached_property
    def other_evidence(self) -> bool:
        structure = self.headline.has("structure_bridge") and self.summary.both("home_body", "structure")
        return self.structures_compared or self.hearing or self.coach_in_summary or structure or self.audit_in_summary or self.association_leads or self.local_actor or self.summary_shows

    @cached_property
    def hearing_title(self) -> bool:
        if not self.title.has("hearing"):
            return False
        person = self.field_people and self.text.has("any_body") and not self.text.has("other_field")
        return person or self.headline.some("accountable", "national_governance") or self.text.some("association_governance")


def _direct(s: str, c: frozenset[str]) -> bool:
    return "direct" in c and c.isdisjoint(("livestock", "local_body")) and not c.isdisjoint(("kfa_context", "short_context", "direct_subject"))


NEWS_RULES: RuleList = [
    ("other_identity", REJECT, lambda v: v.text.has("other_kfa") and not v.text.has("home_identity")),
    ("farm_cooperative_title", REJECT, lambda v: v.title.has("farm_title") and not v.title.has("football_title")),
    ("other_sport", REJECT, lambda v: (v.title.has("other_sport") or v.summary.some("other_body")) and not (v.title.has("football_title") or v.association_leads or v.hearing)),
    ("other_sport_coach", REJECT, lambda v: (v.title.some("other_coach") or v.summary.some("other_coach")) and not (v.association_leads or v.hearing)),
    ("mixed_sports_title", REJECT, lambda v: v.title.some("football_title") and v.title.some("other_body") and not v.title.any(lambda s, c: "football_title" in c and not c.isdisjoint(("accountable", "national_governance", "coach_process")))),
    ("livestock_cooperative", REJECT, lambda v: v.cooperative and not v.local_actor and not v.title.has("title_home")),
    ("listing", REJECT, lambda v: v.title.has("listing") and not v.title.some("accountable")),
    ("bundle", REJECT, lambda v: v.title.has("bundled")),
    ("gratitude", REJECT, lambda v: v.text.has("gratitude") and not v.governed),
    ("foreign_title", REJECT, lambda v: v.title.has("foreign_body") and not (v.coach_named or v.coach_process or v.compared)),
    ("foreign_summary", REJECT, lambda v: v.summary.has("foreign_body") and not (v.coach_named or v.coach_process or v.coach_in_summary or v.compared)),
    ("foreign_club_coach", REJECT, lambda v: v.title.has("foreign_club") and not (v.title.has("korean_coach") or v.coach_process)),
    ("foreign_only", REJECT, lambda v: v.text.has("foreign_body") and not v.text.some("korean_football_context")),
    ("local_title", REJECT, lambda v: v.title.has("local_body") and not (v.kept_though_local or v.national_lead)),
    ("local_summary", REJECT, lambda v: v.summary.has("local_body") and v.title.has("hangul_association") and not (v.text.has("home_identity") or v.kept_though_local)),
    ("roster", REJECT, lambda v: v.text.has("roster") and not v.governed),
    ("political_analogy", REJECT, lambda v: v.text.has("politics") and not (v.text.some("association_governance") or v.audit_in_summary)),
    ("local_contest", REJECT, lambda v: v.text.has("contest") and not v.text.has("tracked")),
    ("performance_but_governed", SECONDARY, lambda v: v.start.has("low_value") and not v.governed_play and v.summary.some("association_governance")),
    ("performance", REJECT, lambda v: v.start.has("low_value") and not v.governed_play),
    ("broad_audit", REJECT, lambda v: v.broad_audit and not v.audit_in_summary),
    ("national_headline", PRIMARY, lambda v: v.headline.any(_direct)),
    ("summary_only", SECONDARY, lambda v: not v.subject and (v.other_evidence or v.hearing_title)),
    ("no_subject", REJECT, lambda v: not v.subject),
    ("officiating_in_context", SECONDARY, lambda v: v.title.has("officiating") and v.in_context),
    ("officiating", REJECT, lambda v: v.title.has("officiating")),
    ("person", PRIMARY, lambda v: bool(v.c["personTags"]) and v.about_person and v.headline.any(lambda s, c: _person_matter(s, c, v.title_words))),
    ("accountable_headline", PRIMARY, lambda v: v.c["titleRelevanceScore"] > 0 and v.headline.some("accountable")),
    ("issue", PRIMARY, lambda v: v.issues and v.about_issue and v.headline.any(lambda s, c: _related(s, c, v.title_words, v.c["titleIssueTags"]))),
    ("other_evidence", SECONDARY, lambda v: v.in_context or v.other_evidence),
]
NOTHING = ("nothing", REJECT)
_FOUND = T.StructType([T.StructField("classification", RESULT), T.StructField("gate", T.StructType([T.StructField(c, T.StringType()) for c in ("rule", "outcome")]))])


def tiered(
    items: DataFrame, issues: list[Issue], people: list[Person], localities: tuple[str, ...] = (), districts: tuple[str, ...] = (), tags: Column | str | None = None, when: Column | None = None
) -> DataFrame:
    """`items` (title, summary) with `classification` and `gate`, a struct of the rule that decided and
    its outcome: primary, secondary or reject.

    Items with the texts of one before them are not read again (evidence.spread brings them together).
    Tags are read with the summary.  Where `when` doesn't hold, nothing is read and both are null.
    Null titles and summaries are empty; an item without evidence is rejected by no_subject.
    """
    summary = F.coalesce("summary", F.lit("")) if tags is None else join_summary_and_tags("summary", tags)
    asked = F.lit(True) if when is None else F.coalesce(when, F.lit(False))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        classifier = FootballClassifier(issues, people, localities, districts)

        @lru_cache(maxsize=32)  # items that are alike may come one after another
        def one(title: str | None, summary: str | None) -> tuple[dict | None, dict | None]:
            if title is None:
                return None, None
            found = classifier.classify(title, summary, False)
            rule = decide(NEWS_RULES, NOTHING, Seen(classifier.football, title, summary, found))
            return found, dict(zip(("rule", "outcome"), rule, strict=True))

        for titles, summaries in (part for batch in batches for part in slices(*batch)):
            yield pd.DataFrame([one(*row) for row in zip(titles, summaries, strict=True)], columns=["classification", "gate"])

    find = F.pandas_udf(run, _FOUND, F.PandasUDFType.SCALAR_ITER).asNondeterministic()  # or a filter on what is found reads all again
    found = items.withColumn("_found", find(F.when(asked, F.coalesce("title", F.lit(""))), F.when(asked, summary)))
    return found.withColumns({"classification": F.col("_found.classification"), "gate": F.col("_found.gate")}).drop("_found")


def _stored(tier: Column) -> Column:
    """A tier as items hold it: null is primary."""
    return F.when(tier == SECONDARY, SECONDARY)


def reclassified_news(items: DataFrame, issues: list[Issue], people: list[Person], localities: tuple[str, ...] = (), districts: tuple[str, ...] = ()) -> DataFrame:
    """Items with what the rules find now in news: tags, words, score, labels and tier; news that they
    reject goes, items of other kinds stay as they are."""
    news = F.col("sourceType") == "news"
    found = tiered(items, issues, people, localities, districts, when=news)
    found = found.where(~F.coalesce(news, F.lit(False)) | (F.col("gate.outcome") != REJECT))
    now = {f: F.when(news, F.col(f"classification.{f}")).otherwise(F.col(f)) for f in REPLACED}
    return found.withColumns(now | {"relevanceTier": F.when(news, _stored(F.col("gate.outcome"))).otherwise(F.col("relevanceTier"))}).drop("classification", "gate")


# Videos


def video_tiers(videos: DataFrame, issues: list[Issue], people: list[Person], localities: tuple[str, ...] = (), districts: tuple[str, ...] = (), tags: str = "tags") -> DataFrame:
    """`videos` (title, summary, tags) with `classification`, `contentTier` and `stage`.

    What title and description show decides; the later stages see only what that rejects.  Evidence
    in other languages makes a video secondary.  Tags, which publishers copy from video to video, can
    save one only where they name the association itself, add an issue, and title or
    description tie football at home to governance; they never make it primary.
    """
    seen = tiered(videos, issues, people, localities, districts).withColumnsRenamed({"classification": "_visible", "gate": "_gate"})
    rejected = F.col("_gate.outcome") == REJECT
    hear = F.pandas_udf(lambda t, s: t.combine(s, multilingual_governance), "boolean")
    asked = lambda c: F.when(rejected, F.coalesce(c, F.lit(""))).otherwise("")
    seen = seen.withColumn("_spoken", hear(asked("title"), asked("summary")))
    spoken = F.col("_spoken")
    named = F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.trim(t).rlike(r"(?i)^(?:대한\s*축구협회|KFA)$"))
    may = rejected & ~spoken & F.coalesce(named, F.lit(False))

    def reading() -> Reading:
        return Reading(Football(localities, districts).reader, lambda text: [], lambda text: {"visible": text})

    visible = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit("")))
    seen = with_cues(seen, [F.when(may, visible)], ("visible",), reading, "_shown")
    shows = lambda cue: F.array_contains("_shown.visible.cues", cue)
    tied = ~shows("rescue_excluded") & (shows("rescued") | (~shows("local_body") & shows("rescue_association_near")))
    seen = seen.withColumn("_may", may & tied).drop("_shown")
    tagged = tiered(seen, issues, people, localities, districts, tags=tags, when=F.col("_may"))
    added = F.size(F.array_except("classification.issueTags", "_visible.issueTags")) > 0
    saved = F.coalesce(F.col("_may") & added & (F.col("gate.outcome") != REJECT), F.lit(False))
    initials = F.coalesce("title", F.lit("")).rlike(r"(?i)(?<![A-Za-z0-9_])KFA(?![A-Za-z0-9_])")
    visible_class = F.col("_visible")
    spoken_class = visible_class.withField("matchedKeywords", F.array_distinct(F.concat(visible_class["matchedKeywords"], F.array(F.lit("KFA"))))).withField(
        "relevanceScore", F.greatest(visible_class["relevanceScore"], F.when(initials, 20).otherwise(6))
    )
    outcome = F.when(~rejected, F.col("_gate.outcome")).when(spoken | saved, SECONDARY).otherwise(REJECT)
    stage = F.when(~rejected, "visible").when(spoken, "spoken").when(saved, "tags").otherwise("none")
    final = F.when(spoken, spoken_class).when(F.col("_may"), F.col("classification")).otherwise(visible_class)
    return tagged.withColumns({"contentTier": outcome, "stage": stage, "classification": final}).drop("_visible", "_gate", "_spoken", "_may", "gate")


#: Channels of a policy that are broadcast, at most.
_CHANNELS = 100_000


def reclassified_videos(items: DataFrame, policy: DataFrame, issues: list[Issue], people: list[Person], localities: tuple[str, ...] = (), districts: tuple[str, ...] = ()) -> DataFrame:
    """Items with what the rules find now in videos (sourceType youtube, a struct `youtube` with channelId,
    tags, channelStatus and contentRelevanceTier): those without the struct, of blocked channels
    or without evidence go; the tier is primary for primary contents of preferred channels, else secondary."""
    video = F.coalesce(F.col("sourceType") == "youtube", F.lit(False))
    rows = items.where(~video | F.col("youtube").isNotNull()).withColumn("_channel", F.when(video, F.col("youtube.channelId")))
    known = policy.select(F.col("channel_id").alias("_channel"), F.col("status").alias("_status"))
    if policy.limit(_CHANNELS + 1).count() <= _CHANNELS:
        known = F.broadcast(known)  # the texts of videos stay where they are
    rows = rows.join(known, "_channel", "left").withColumn("_status", F.coalesce("_status", F.lit("unlisted"))).where(~video | (F.col("_status") != "blocked"))
    rows = rows.withColumn("_tags", F.when(video, F.col("youtube.tags")))
    others, videos = rows.where(~video), rows.where(video)
    found = video_tiers(videos, issues, people, localities, districts, "_tags").where(F.col("contentTier") != REJECT)
    tier = effective_tier(F.col("_status"), F.col("contentTier"))
    now = {f: F.col(f"classification.{f}") for f in REPLACED}
    now |= {"relevanceTier": _stored(tier), "youtube": F.col("youtube").withField("channelStatus", F.col("_status")).withField("contentRelevanceTier", F.col("contentTier"))}
    found = found.withColumns(now).drop("classification", "contentTier", "stage")
    return others.unionByName(found).drop("_channel", "_status", "_tags")

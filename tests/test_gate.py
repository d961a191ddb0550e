"""The cue engine against regular expressions, and the tiers of headlines written for these tests."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from feedweave.operators import evidence as E
from feedweave.operators import football, gate
from feedweave.operators.classify import Issue, Person
from feedweave.operators.evidence import Lexicon, Link, Reader, clauses, each, words

ISSUES = [
    Issue("election", ("회장 선거", "선거인단")),
    Issue("mcst-audit", ("문체부 감사", "감사 결과", "조사 결과")),
    Issue("coach-appointment", ("감독 선임", "감독 후보"), context=("대표팀", "대한축구협회", "KFA")),
    Issue("kfa-executives", ("임원", "전무", "부회장")),
]
PEOPLE = [Person("hong", "홍명보", ("홍명보",)), Person("lee", "이영표", ("이영표",), context=("축구", "KFA")), Person("person_lee_im_saeng", "이임생", ("이임생",)), Person("off", "아무개", ("아무개",), published=False)]
PLACES, DISTRICTS = ("부산", "부산진", "금산"), ("해운대",)


def test_engine_equals_regular_expressions():
    """Every family, chain and pair of the feed's lexicon on random texts of its own words."""
    rng = random.Random(2)
    lexicon = football.lexicon()
    reader = Reader(lexicon)

    def pattern(name):
        plain = name in lexicon.literal or name in lexicon.exact
        out = []
        for w in lexicon.families[name]:
            bare = re.escape(w.strip("<>")).replace("␣", r"\s+")
            out.append((r"(?<![A-Za-z0-9_])" if w[0] == "<" else "") + (bare if plain else bare.replace(r"\ ", r"\s*")) + (r"(?![A-Za-z0-9_])" if w[-1] == ">" else ""))
        after = lexicon.unless.get(name)
        return "(?:" + "|".join(out) + ")" + (r"(?!\s*(?:" + "|".join(after).replace("를전", r"를\s*전") + "))" if after else "")

    def flags(*names):
        return 0 if any(n in lexicon.exact for n in names) else re.I

    rules = {n: (pattern(n), flags(n)) for n, group in lexicon.families.items() if group}
    for kind in (lexicon.chains, lexicon.either):
        for name, options in kind.items():
            chains = [o for o in options] + ([o[::-1] for o in options] if kind is lexicon.either else [])
            rules[name] = ("|".join("".join(pattern(p) if i % 2 == 0 else f".{{0,{p}}}" for i, p in enumerate(c)) for c in chains), flags(*(c for o in options for c in o[::2])))
    compiled = {n: re.compile(p, f) for n, (p, f) in rules.items()}
    every = sorted({w for group in lexicon.families.values() for w in group})
    hits = 0
    for _ in range(400):
        picked = [rng.choice(every).strip("<>").replace("␣", " ") for _ in range(rng.randrange(1, 8))]
        text = "".join(w.replace(" ", rng.choice([" ", "", "  "])) + rng.choice(["", " ", " 가나다 ", "\n", "x" * rng.randrange(70)]) for w in picked)
        got = reader.cues(text)
        for n, p in compiled.items():
            assert (n in got) == bool(p.search(text)), (n, text)
            hits += n in got
    assert hits > 2000


def test_links_and_words():
    reader = Reader(Lexicon({"place": ("Ham", "Hamburg"), "club": ("club",)}, links={"local": (Link("place", r"\s*(?:city)?\s*", "club", "[A-Za-z]"),)}))
    assert all("local" in reader.cues(t) for t in ("Ham club", "Hamburg city club", "the Ham  cityclub"))
    assert not any("local" in reader.cues(t) for t in ("xHam club", "Ham old club", "club Ham", ""))
    assert each(("a", "b"), "-", ("c", "")) == ("a-c", "a-", "b-c", "b-") and words("a b, c ,") == ("a b", "c")
    assert clauses("a, B, c,  D", lambda clause, before: clause.isupper()) == ["a", "B, c", "D"]


def test_segments_part_where_the_subject_changes():
    cut = football.Football(PLACES).segments
    assert cut("축구협회 개혁, 정관 개정. 일본 축구협회 방문") == ["축구협회 개혁, 정관 개정", "일본 축구협회 방문"]
    assert cut("축구협회 감사, 일본 축구협회 방문") == ["축구협회 감사", "일본 축구협회 방문"]
    assert cut("대한축구협회, 독일 축구협회 사례 참고") == ["대한축구협회, 독일 축구협회 사례 참고"]
    assert cut("정관 개정, 대한체육회 소식, 농구 대표팀 승리") == ["정관 개정", "대한체육회 소식", "농구 대표팀 승리"]


#: (title, summary, tier, rule)
CASES = [
    ("대한축구협회 회장 선거 선거인단 확정", "", "primary", "national_headline"),
    ("축구협회, 감독 선임 논란에 해명", "대한축구협회는 절차를 설명했다.", "primary", None),
    ("홍명보 감독 선임 의혹 수사", "대표팀 감독 선임 과정을 조사한다.", "primary", None),
    ("KFA(한국패션협회) 시상식", "패션 행사를 열었다.", "reject", "other_identity"),
    ("농협 조합장 회의", "축협도 참석했다.", "reject", "farm_cooperative_title"),
    ("야구 대표팀 감독 선임", "KBO가 발표했다.", "reject", "other_sport"),
    ("축협 한우 농가 지원", "조합원이 모였다.", "reject", "livestock_cooperative"),
    ("[오늘의 주요일정] 축구", "", "reject", "listing"),
    ("이 시각 주요 뉴스", "축구협회 소식", "reject", "bundle"),
    ("팬들께 감사합니다", "축구 선수의 인사", "reject", "gratitude"),
    ("일본 축구협회 감독 선임", "새 사령탑을 뽑았다.", "reject", "foreign_title"),
    ("독일축구협회 KFA 방문", "", "reject", None),
    ("부산축구협회 체육대회", "지역 동호인이 모였다.", "reject", "local_title"),
    ("해운대구 축구협회 모임", "", "reject", "local_title"),
    ("축구협회 새 소식", "금산군 축구협회가 모였다.", "reject", "local_summary"),
    ("올스타전 출전 로스터", "", "reject", "roster"),
    ("민주당 전당대회 한판승부", "축구처럼", "reject", "political_analogy"),
    ("고교 축구 대회 우승", "", "reject", "local_contest"),
    ("월드컵 탈락 원흉", "전술 문제가 있었다.", "reject", "performance"),
    ("월드컵 탈락 원흉", "대한축구협회 회장 선거 제도 개혁이 필요하다.", "secondary", "performance_but_governed"),
    ("날씨 소식", "비가 온다.", "reject", "no_subject"),
    ("관련 의혹 조사", "대한축구협회 정관과 선거인단을 다룬다.", "secondary", "summary_only"),
    ("K리그 심판 오심", "", "reject", "officiating"),
    ("K리그 심판 판정 논란", "대한축구협회 이사회가 책임을 논의했다.", None, None),
    (None, None, "reject", "no_subject"),
    ("", "x" * 5000, "reject", "no_subject"),
]


def frame(spark):
    return spark.createDataFrame([(i, t, s, "y") for i, (t, s, _, _) in enumerate(CASES)], "i int, title string, summary string, rule string")


def test_tiers(spark):
    got = {r["i"]: r for r in gate.tiered(frame(spark), ISSUES, PEOPLE, PLACES, DISTRICTS).collect()}
    assert len(got) == len(CASES)
    for i, (title, _, tier, rule) in enumerate(CASES):
        assert tier in (None, got[i]["gate"]["outcome"]) and rule in (None, got[i]["gate"]["rule"]), (title, got[i]["gate"])
    assert gate.tiered(frame(spark).limit(0), ISSUES, PEOPLE).count() == 0
    names = [n for n, _, _ in gate.NEWS_RULES]
    assert len(set(names)) == len(names) == 30


def test_classification_of_the_feed():
    c = football.FootballClassifier(ISSUES, PEOPLE, PLACES, DISTRICTS)
    one = lambda title, summary="": c.classify(title, summary, False)
    assert one("대한축구협회 회장 선거")["titleRelevanceScore"] == 30
    assert one("축협 조합장과 농가")["matchedKeywords"] == [] and one("축협 회장 책임론")["matchedKeywords"] == ["축협"]
    assert "감사" not in one("팬들에게 감사의 마음")["matchedKeywords"] and "감사" in one("문체부 특정감사 착수")["matchedKeywords"]
    assert one("부산축구협회 소식")["matchedKeywords"] == [] and one("축구협회 정관 개정")["matchedKeywords"] == ["축구협회", "정관"]
    assert one("KFA fashion show")["matchedKeywords"] == [] and "KFA" in one("KFA 회장 선거")["matchedKeywords"]
    assert one("일본 대표팀 감독 선임")["issueTags"] == [] and one("한국 축구 대표팀 감독 선임")["issueTags"] == ["coach-appointment"]
    assert one("이임생 전무이사 사임")["issueTags"] == ["kfa-executives"] and one("전무이사 사임")["issueTags"] == []
    assert one("문체부, 축구협회 감사 결과 발표")["issueTags"] == ["mcst-audit"] and one("학교 감사 결과")["issueTags"] == []
    assert one("이영표 말하다", "축구 개혁")["personTags"] == ["lee"] and one("아무개")["personTags"] == []
    crossed = one("축구협회장 입장 발표", "한국 축구 개혁을 말했다.")
    assert crossed["titleRelevanceScore"] == 10 and "축구협회장" in crossed["titleMatchedKeywords"]


def test_stored_news(spark):
    empty = F.array().cast("array<string>")
    items = frame(spark).withColumns({"sourceType": F.when(F.col("i") == 3, "official").when(F.col("i") == 4, None).otherwise("news"), "relevanceTier": F.lit("secondary"), "relevanceScore": F.lit(7), **dict.fromkeys(("issueTags", "personTags", "matchedKeywords", "labels"), empty)})
    got = {r["i"]: r for r in gate.reclassified_news(items, ISSUES, PEOPLE, PLACES, DISTRICTS).collect()}
    kept = {i for i, c in enumerate(CASES) if c[2] in ("primary", "secondary")} | {3, 4}
    assert kept <= set(got) and not {i for i, c in enumerate(CASES) if c[2] == "reject"} - {3, 4} & set(got)
    assert got[0]["relevanceTier"] is None and got[19]["relevanceTier"] == "secondary" and "election" in got[0]["issueTags"]
    assert got[3]["relevanceScore"] == got[4]["relevanceScore"] == 7


VIDEOS = [
    (1, "대한축구협회 회장 선거", "", ["무엇"], "primary", "visible"),
    (2, "Korean Football Association faces sanction", "", None, "secondary", "spoken"),
    (3, "한국 축구 이야기 감독 선임", "야구 대표팀 감독 이야기", ["KFA"], "reject", "none"),
    (4, "농촌 이야기", "", ["KFA", "회장 선거"], "reject", "none"),
    (5, None, None, None, "reject", "none"),
]


def test_video_stages(spark):
    df = spark.createDataFrame([v[:4] for v in VIDEOS], "id int, title string, summary string, tags array<string>")
    got = {r["id"]: r for r in gate.video_tiers(df, ISSUES, PEOPLE, PLACES).collect()}
    for i, _, _, _, tier, stage in VIDEOS:
        assert (got[i]["contentTier"], got[i]["stage"]) == (tier, stage), i
    assert got[2]["classification"]["relevanceScore"] == 6 and "KFA" in got[2]["classification"]["matchedKeywords"]


def test_tags_save_a_video_but_never_make_it_primary(spark):
    text = "전력강화위원회 이야기"
    rows = [(1, "지난 이야기", text, ["KFA", "대한축구협회 회장 선거"]), (2, "지난 이야기", text, ["축구", "대한축구협회 회장 선거"]), (3, "지난 이야기", text + " 하이라이트", ["KFA", "대한축구협회 회장 선거"]), (4, "지난 이야기", text, ["KFA"])]
    df = spark.createDataFrame(rows, "id int, title string, summary string, tags array<string>")
    got = {r["id"]: (r["contentTier"], r["stage"]) for r in gate.video_tiers(df, ISSUES, PEOPLE).collect()}
    seen = {r["id"]: r["gate"]["outcome"] for r in gate.tiered(df, ISSUES, PEOPLE).collect()}
    assert got[2] == got[3] == got[4] == ("reject", "none") if seen[1] == "reject" else got[1][1] == "visible"
    assert got[1][0] in ("secondary", "reject") and got[1] == (("secondary", "tags") if seen[1] == "reject" else (seen[1], "visible"))


def test_stored_videos(spark):
    rows = [(i, t, s, "youtube", (c, g, None, None) if c else None) for i, t, s, c, g in [(1, "대한축구협회 회장 선거", "", "a", []), (2, "대한축구협회 회장 선거", "", "b", []), (3, "대한축구협회 회장 선거", "", "c", []), (4, "x", "", "c", []), (5, "대한축구협회 회장 선거", "", None, None)]]
    rows.append((6, "x", "", "news", None))
    empty = F.array().cast("array<string>")
    df = spark.createDataFrame(rows, "id int, title string, summary string, sourceType string, youtube struct<channelId:string,tags:array<string>,channelStatus:string,contentRelevanceTier:string>")
    df = df.withColumns({"relevanceTier": F.lit(None).cast("string"), "relevanceScore": F.lit(0), **dict.fromkeys(("issueTags", "personTags", "matchedKeywords", "labels"), empty)})
    policy = spark.createDataFrame([("a", "preferred"), ("b", "blocked")], "channel_id string, status string")
    got = {r["id"]: r for r in gate.reclassified_videos(df, policy, ISSUES, PEOPLE).collect()}
    assert set(got) == {1, 3, 6}
    assert got[1]["relevanceTier"] is None and got[3]["relevanceTier"] == "secondary"
    assert got[3]["youtube"]["channelStatus"] == "unlisted" and got[3]["youtube"]["contentRelevanceTier"] == "primary"


def test_gazetteer(spark):
    names = spark.createDataFrame([("부산",), ("부산",), (" ",), (None,), ("금산",)], "name string")
    assert football.gazetteer(names) == ("금산", "부산")
    with pytest.raises(ValueError, match="more than 1"):
        football.gazetteer(names, 1)


def test_plain_words_are_found_without_a_test_of_each(monkeypatch):
    asked = []
    whole = E.Reader._stands
    monkeypatch.setattr(E.Reader, "_stands", lambda self, name, word, *x: asked.append(word) or whole(self, name, word, *x))
    reader = E.Reader(E.Lexicon({"a": ("축구 협회", "감독"), "b": ("<kfa>", "축구협회"), "c": ("감␣독",)}, {"near": (("a", 3, "b"),)}))
    assert reader.places("감독 축구협회 축구  협회 축 구협회") == {"a": [(0, 2), (3, 7), (8, 14)], "b": [(3, 7)]}
    assert set(asked) == {"감␣독"}
    assert reader.cues("감 독") == {"c"} and reader.cues("감독\n축구협회") == {"a", "b"} and reader.cues("감독, KFA") == {"a", "b", "near"}


def test_slices_are_small_and_lose_no_row():
    texts = pd.Series([None, "x" * 700_000, "y" * 700_000, *("z",) * 1200])
    parts = [a for a, _ in E.slices(texts, texts)]
    assert pd.concat(parts).equals(texts) and max(map(len, parts)) <= 500 and [len(p) for p in parts] == [1, 1, 1, 500, 500, 200]
    assert list(E.slices(texts[:0])) == []


def test_whole_texts_need_no_segments_and_lines_are_spread(spark):
    from feedweave.plans import gate as plans

    assert plans._read_documents(spark, "/root/testdata/sf0.001").where("size(e.segments) > 0").count() == 0
    assert plans.local_bodies(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


TOLD = ["서울축구협회 우승. 대한축구협회, 국민의힘 감사 결과; 농협 조합장 축협 회장", "한국 축구 대표팀 감독 선임 문체부 감사 KFA 정관", "대한체육회 KFA 회장 선거. 야구 감독, 일본 축구협회 비교 대신 KFA", "감사합니다 팬 여러분, 국회 청문회 홍명보 후임 3. 프로야구 KBO 협회"]


def test_cues_that_are_asked_for_one_by_one_are_those_of_the_whole_reading():
    from feedweave.operators.football import Football, lexicon

    for told in (*TOLD, " \n".join(TOLD * 4)):
        f = Football(("서울",), ("중",))
        names = [*E.Reader(lexicon(("서울",), ("중",))).lexicon.families, *f.reader.options, *f.reader.gaps, *f.reader.shapes, *f.reader.order]
        want = f.reader.cues(told)
        assert want and {n for n in names if n in E.Cues(f.reader, told)} == want
        parts = f.segments(told)
        assert all(i in parts.where(n) for i, s in enumerate(parts) for n in f.reader.cues(s)) and parts.where("other_body") < set(range(len(parts)))


def test_a_rule_reads_only_segments_that_can_decide_it():
    from feedweave.operators.football import Football

    f, read = Football(), []
    found = f.reader.found
    f.reader.found = lambda text, *families: (read.append(text.text), found(text, *families))[1]
    view = E.View(f.cues, f.segments, ". ".join(f"경기 소식 {i} 선수" for i in range(99)) + ". 프로야구 KBO 감독. 한국 축구")
    assert view.some("other_body") and not view.some("ministry_audit")
    assert len(read) < 5  # a hundred before


def test_rows_that_are_alike_come_one_after_another(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 6 else f"t{i % 7}") for i in range(70)], "id long, text string").repartition(5)
    got = E.spread(rows, F.col("text")).select("id", "text", F.spark_partition_id().alias("p")).collect()
    assert sorted(r["id"] for r in got) == list(range(70)) and set(got[0].asDict()) == {"id", "text", "p"}
    runs = sum(a["text"] != b["text"] for a, b in zip(got, got[1:], strict=False)) + 1
    assert runs == 7 and len({(r["text"], r["p"]) for r in got}) == 7

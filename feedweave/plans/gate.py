"""Cues, rules and tiers over the driver tables.  `documents` are read as they are by a lexicon of their own
words, or, for the feed's rules, with each word put into Korean: the word of FEED at the place of its hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.operators import classify as A
from feedweave.operators import evidence as E
from feedweave.operators import gate
from feedweave.operators import reports as R
from feedweave.operators.football import Football, gazetteer
from feedweave.plans.catalogue import query
from feedweave.plans.feed import read

_LEXICON = E.Lexicon(
    families={"insult": E.words("idiot, stupid, moron, worthless"), "license": E.words("license, apache, warranty"), "joined": E.words("of the, de la, of a"), "small": E.words("<is>, <et>"), "tion": E.words("tion")},
    chains={"license_then_tion": (("license", 60, "tion"),)},
    either={"joined_near_small": (("joined", 25, "small"),)},
)
_SQL_CUES = {
    "insult": r"(?i)idiot|stupid|moron|worthless",
    "license": r"(?i)license|apache|warranty",
    "joined": r"(?i)of\s*the|de\s*la|of\s*a",
    "license_then_tion": r"(?i)(?:license|apache|warranty).{0,60}tion",
    "joined_near_small": r"(?i)(?:of\s*the|de\s*la|of\s*a).{0,25}\b(?:is|et)\b|\b(?:is|et)\b.{0,25}(?:of\s*the|de\s*la|of\s*a)",
}
_CUT = r"""list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(text, '([0-9])\.', '\1' || chr(1), 'g'), '\.([0-9])', chr(1) || '\1', 'g'), '[\r\n;；…]|[.!?][\x22''’”)}\]〉》」』】]*'),
  lambda s: regexp_replace(replace(s, chr(1), '.'), '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""


#: Cuts a text into no segments, where only the cues of whole texts are asked for.
_WHOLE = lambda text: []


def _read_documents(spark: SparkSession, sf: str) -> DataFrame:
    make = lambda: E.Reading(E.Reader(_LEXICON), _WHOLE, lambda text: {"text": text})
    return E.with_cues(read(spark, sf, "documents"), [F.col("text")], ("text",), make).withColumn("e", F.col("evidence.text"))


@query("evidence_segments", f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS parts FROM (SELECT doc_id, {_CUT} AS s FROM documents)")
def evidence_segments(spark: SparkSession, sf: str) -> DataFrame:
    cut = F.pandas_udf(lambda texts: texts.map(lambda t: A.segments(t or "")), "array<string>")
    rows = read(spark, sf, "documents").withColumn("s", cut("text"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "\n")).alias("parts"))


@query("text_cues", "SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{p}') AS {k}" for k, p in _SQL_CUES.items()) + " FROM documents")
def text_cues(spark: SparkSession, sf: str) -> DataFrame:
    return _read_documents(spark, sf).select("doc_id", *(F.array_contains("e.cues", k).alias(k) for k in _SQL_CUES))


@query(
    "ruled_documents",
    f"""WITH s AS (SELECT doc_id, text, {_CUT} AS s FROM documents),
h AS (SELECT doc_id, regexp_matches(text, '{_SQL_CUES["insult"]}') AS insult, regexp_matches(text, '{_SQL_CUES["license_then_tion"]}') AS terms,
  len(list_filter(s, lambda x: regexp_matches(x, '{_SQL_CUES["license"]}') AND regexp_matches(x, '{_SQL_CUES["joined"]}'))) > 0 AS same,
  len(list_filter(s, lambda x: regexp_matches(x, '{_SQL_CUES["joined_near_small"]}') AND NOT regexp_matches(x, '(?i)tion'))) > 0 AS plain FROM s)
SELECT doc_id, CASE WHEN insult AND NOT terms THEN 'insult' WHEN same THEN 'terms' WHEN plain THEN 'plain' ELSE 'none' END AS rule,
  CASE WHEN insult AND NOT terms THEN 'reject' WHEN same THEN 'primary' WHEN plain THEN 'secondary' ELSE 'reject' END AS tier FROM h""",
)
def ruled_documents(spark: SparkSession, sf: str) -> DataFrame:
    rules = [
        ("insult", "reject", lambda v: v.has("insult") and not v.has("license_then_tion")),
        ("terms", "primary", lambda v: v.both("license", "joined")),
        ("plain", "secondary", lambda v: v.any(lambda s, c: "joined_near_small" in c and "tion" not in c)),
    ]
    make = lambda: (E.Reading(E.Reader(_LEXICON), A.segments, lambda text: {"text": text}), rules, ("none", "reject"))
    return E.ruled(read(spark, sf, "documents"), F.col("text"), make).select("doc_id", "gate.rule", F.col("gate.outcome").alias("tier"))


@query(
    "local_bodies",
    """WITH names AS (SELECT string_agg(n_name, '|' ORDER BY length(n_name) DESC, n_name) AS p FROM nation),
t AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '가' ELSE c_mktsegment || ' ' END || n_name || CASE c_custkey % 3 WHEN 0 THEN '시 ' WHEN 1 THEN '' ELSE ' 시민' END || '축구협회' AS t FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, regexp_matches(t, '(?:^|[^가-힣])(?:' || p || ')(?:도|시|군|구)?\\s*축구협회') AS local FROM t, names""",
)
def local_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of the places that `nation` names, in lines about customers."""
    nation, n = read(spark, sf, "nation"), F.col("c_custkey")
    places = gazetteer(nation.select("n_name"))
    line = F.concat(F.when(n % 5 == 0, "가").otherwise(F.concat("c_mktsegment", F.lit(" "))), "n_name", F.when(n % 3 == 0, "시 ").when(n % 3 == 1, "").otherwise(" 시민"), F.lit("축구협회"))
    rows = read(spark, sf, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", line.alias("line"))
    make = lambda: E.Reading(Football(places).reader, _WHOLE, lambda text: {"text": text})
    return E.with_cues(E.spread(rows), [F.col("line")], ("text",), make).select("c_custkey", F.array_contains("evidence.text.cues", "local_body").alias("local"))


# The feed's rules

#: Words that stand for those of the documents; some only fill.
FEED = E.words(
    "경기, 소식, 오늘, 서울, 선수, 시즌, 팬, 구장, 훈련, 일정, 대한축구협회, KFA, 축구협회, 축협, 한국 축구, 대표팀, 감독, 감독 선임, 회장 선거, 선거인단, 정관, 청문회, 감사, 감사 결과, 문체부, 국회, 책임, 개혁, 해명, 사퇴, 김회장, 박위원, 야구, 일본, 독일, 농협, 조합장, 심판, 월드컵, 일본 언론, 로스터, 민주당, 서울축구협회, 우승, 고교, 감사합니다, 주요 뉴스, 전력강화위원회"
)
ISSUES = [
    A.Issue("election", ("회장 선거", "선거인단"), priority=1),
    A.Issue("mcst-audit", ("감사 결과", "감사"), priority=2),
    A.Issue("coach-appointment", ("감독 선임", "감독"), context=("대표팀", "대한축구협회", "KFA"), priority=3),
    A.Issue("kfa-executives", ("임원", "전무", "김회장"), priority=4),
]
PEOPLE = [A.Person("kim", "김회장", ("김회장",)), A.Person("park", "박위원", ("박위원",), context=("축구", "KFA")), A.Person("hidden", "팬", ("팬",), published=False)]
PLACES = ("서울", "부산")


def _korean(text: Column) -> Column:
    """Each line of a text in words of the feed, most of which are fillers."""
    word = lambda w: F.get(F.array(*map(F.lit, FEED)), F.when(F.crc32(w) % 4 == 0, F.crc32(F.concat(w, F.lit("x"))) % len(FEED)).otherwise(F.crc32(w) % 10).cast("int"))
    line = lambda s: F.array_join(F.transform(F.split(s, " "), word), " ")
    return F.array_join(F.transform(F.split(F.regexp_replace(text, r"\.\s*", "\n"), "\n"), line), ". ")


def _korean_items(spark: SparkSession, sf: str) -> DataFrame:
    d = E.spread(read(spark, sf, "documents"), F.col("text")).withColumn("text", F.coalesce("text", F.lit("")))
    first = F.substring_index("text", ".", 1)
    return d.select("doc_id", _korean(first).alias("title"), _korean(F.expr("substring(text, length(substring_index(text, '.', 1)) + 2)")).alias("summary"), "lang", "source")


@query("news_tiers")
def news_tiers(spark: SparkSession, sf: str) -> DataFrame:
    found = gate.tiered(_korean_items(spark, sf), ISSUES, PEOPLE, PLACES)
    return found.select("doc_id", "gate.rule", F.col("gate.outcome").alias("tier"), F.col("classification.relevanceScore").alias("score"))


@query("reclassified_news")
def reclassified_news(spark: SparkSession, sf: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    items = _korean_items(spark, sf).withColumns({"sourceType": F.when(F.col("lang") == "en", "news").otherwise("official"), "relevanceTier": F.lit("secondary"), "relevanceScore": F.lit(1), **dict.fromkeys(("issueTags", "personTags", "matchedKeywords", "labels"), empty)})
    return gate.reclassified_news(items, ISSUES, PEOPLE, PLACES).select("doc_id", "sourceType", "relevanceTier", "relevanceScore", "issueTags")


@query("reclassified_videos")
def reclassified_videos(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as videos of a channel a source, whose tags are two words of the feed."""
    empty = F.array().cast("array<string>")
    tags = F.array(F.get(F.split("title", " "), 0), F.when(F.col("lang") == "de", "KFA").otherwise("축구"))
    none = F.lit(None).cast("string")
    video = F.struct(F.col("source").alias("channelId"), tags.alias("tags"), none.alias("channelStatus"), none.alias("contentRelevanceTier"))
    items = _korean_items(spark, sf).withColumns({"sourceType": F.lit("youtube"), "youtube": video, "relevanceTier": none, "relevanceScore": F.lit(1), **dict.fromkeys(("issueTags", "personTags", "matchedKeywords", "labels"), empty)})
    sources = read(spark, sf, "documents").select(F.col("source").alias("channel_id")).distinct()
    policy = R.policy_rows(sources.where("channel_id like '%1'"), sources.where("channel_id like '%7'"))
    found = gate.reclassified_videos(items, policy, ISSUES, PEOPLE, PLACES)
    return found.select("doc_id", "relevanceTier", "relevanceScore", F.col("youtube.channelStatus").alias("status"), F.col("youtube.contentRelevanceTier").alias("content"))

"""Further operators of the feed over the driver tables: documents stand in for items, some
of them with faults, parts for videos, and nations for issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.functions import text as X
from feedweave.operators import classify as A
from feedweave.operators import feed as G
from feedweave.operators import items as I
from feedweave.operators import reports as R
from feedweave.operators import retention as N
from feedweave.operators import validation as V
from feedweave.operators.components import shared_folder
from feedweave.plans.catalogue import query
from feedweave.plans.feed import EV, NOW, event_items, now, read
from feedweave.sources import connectors as C
from feedweave.sources import files as P


def document_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as items; some have a kind, time, URL, publisher, score or tier that isn't allowed."""
    d, n = read(spark, sf, "documents"), F.col("doc_id")
    kind = F.when(n % 10 == 0, "official").when(n % 10 == 1, "youtube").otherwise("news")
    iso = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + n * 600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    shown = {
        "id": F.concat(F.lit("d"), n),
        "type": kind,
        "sourceType": F.when(n % 101 == 0, "blog").otherwise(kind),
        "title": F.concat_ws(" ", "source", "lang"),
        "summary": F.col("text"),
        "url": F.concat(F.when(n % 89 == 0, "ftp").otherwise("https"), F.lit("://example.com/"), n),
        "originalUrl": F.concat(F.lit("https://example.com/"), n),
        "publisher": F.when(n % 83 == 0, "").otherwise(F.col("lang")),
        "publishedAt": F.when(n % 79 == 0, "soon").otherwise(iso),
        "collectedAt": iso,
        "matchedKeywords": F.array("lang", "source"),
        "issueTags": F.array(F.concat(F.lit("k"), n % 7)),
        "personTags": F.array(F.concat(F.lit("p"), n % 5)),
        "isOfficial": (kind == "official") | (n % 97 == 0),
        "relevanceScore": (n % 110).cast("int"),
        "relevanceTier": F.when(n % 13 == 0, "odd").when(n % 3 == 0, "secondary"),
        "labels": F.array(F.lit(X.AUTO_LABEL), "source"),
        "youtube": F.when(kind == "youtube", F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in I.VIDEO.fields))),
    }
    none = {f.name: F.lit(None).cast(f.dataType) for f in I.ITEM.fields if f.name not in shown}
    return d.select(*((shown | none)[f.name].alias(f.name) for f in I.ITEM.fields))


DI = """WITH di AS (SELECT *, 'd' || doc_id AS id, CASE doc_id % 10 WHEN 0 THEN 'official' WHEN 1 THEN 'youtube' ELSE 'news' END AS kind, source || ' ' || lang AS title, 1700000000 + doc_id * 600 AS s,
  strftime(to_timestamp(1700000000 + doc_id * 600) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS iso, CASE WHEN doc_id % 13 = 0 THEN 'odd' WHEN doc_id % 3 = 0 THEN 'secondary' END AS tier FROM documents)
"""


# Projections


@query("feed_projection", DI + "SELECT id, title, lang || ' ' || source || ' ' || source AS searchTerms FROM di")
def feed_projection(spark: SparkSession, sf: str) -> DataFrame:
    return I.feed_items(document_rows(spark, sf)).select("id", "title", "searchTerms")


@query("related_projection", DI + "SELECT id, title, CASE WHEN doc_id % 89 = 0 THEN 'ftp' ELSE 'https' END || '://example.com/' || doc_id AS url, CASE WHEN doc_id % 83 = 0 THEN '' ELSE lang END AS publisher, CASE WHEN doc_id % 79 = 0 THEN 'soon' ELSE iso END AS publishedAt FROM di")
def related_projection(spark: SparkSession, sf: str) -> DataFrame:
    return I.related_items(document_rows(spark, sf))


@query("link_projection", DI + "SELECT id, title, CASE WHEN doc_id % 101 = 0 THEN 'blog' ELSE kind END AS sourceType FROM di")
def link_projection(spark: SparkSession, sf: str) -> DataFrame:
    return I.source_links(document_rows(spark, sf)).select("id", "title", "sourceType")


@query("public_projection", DI + "SELECT id, false AS with_state, kind = 'youtube' AS video FROM di")
def public_projection(spark: SparkSession, sf: str) -> DataFrame:
    shown = I.public_items(document_rows(spark, sf))
    return shown.select("id", F.lit("dedupeState" in shown.columns).alias("with_state"), F.col("youtube").isNotNull().alias("video"))


@query("revision_projection", DI + "SELECT id, md5(text) AS summary, source AS label, kind = 'youtube' AS video FROM di")
def revision_projection(spark: SparkSession, sf: str) -> DataFrame:
    return I.revision_items(document_rows(spark, sf)).select("id", F.md5("summary").alias("summary"), F.get("labels", 1).alias("label"), F.col("youtube").isNotNull().alias("video"))


@query("thumbnail_choice", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'h' WHEN p_size % 3 = 1 THEN 'm' ELSE 'x' END AS url, CASE WHEN p_size % 3 = 0 THEN 480 ELSE p_size END AS width FROM part")
def thumbnail_choice(spark: SparkSession, sf: str) -> DataFrame:
    image = lambda u, w: F.struct(F.lit(u).alias("url"), w.cast("int").alias("width"), F.lit(10).alias("height"))
    own = F.col("p_size")
    images = F.when(own % 3 == 0, F.create_map(F.lit("medium"), image("m", own), F.lit("high"), image("h", F.lit(None)))).when(own % 3 == 1, F.create_map(F.lit("medium"), image("m", own))).otherwise(F.create_map(F.lit("odd"), image("y", own - 100), F.lit("other"), image("x", own)))
    return read(spark, sf, "part").withColumn("t", I.thumbnail(images)).select("p_partkey", "t.url", "t.width")


# Filters and guards


@query("official_keep_rule", DI + "SELECT id FROM di WHERE source = 'web' OR lang IN ('de', 'fr')")
def official_keep_rule(spark: SparkSession, sf: str) -> DataFrame:
    rows = document_rows(spark, sf).withColumn("sourceId", F.when(F.get("matchedKeywords", 1) == "web", "kfa_media").otherwise("other"))
    return rows.where(I.official_kept(("de", "fr"))).select("id")


@query("news_keep_rule", DI + "SELECT id FROM di WHERE CASE WHEN doc_id % 101 = 0 THEN 'blog' ELSE kind END <> 'news' OR coalesce(tier, '') <> 'odd'")
def news_keep_rule(spark: SparkSession, sf: str) -> DataFrame:
    rows = document_rows(spark, sf)
    return A.kept_news(rows, F.when(F.col("relevanceTier") == "odd", "reject").otherwise(F.col("relevanceTier"))).select("id")


VIDEOS = """v AS (SELECT o_orderkey AS videoId, o_custkey AS channelId, o_orderdate AS made, CASE o_orderstatus WHEN 'F' THEN 'private' WHEN 'O' THEN 'public' END AS privacy, CASE WHEN o_orderpriority <> '5-LOW' THEN 'processed' ELSE 'failed' END AS upload,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'blocked' WHEN 'BUILDING' THEN 'preferred' ELSE 'unlisted' END AS status FROM orders JOIN customer ON o_custkey = c_custkey)"""


def video_table(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("videoId"),
        F.col("o_custkey").alias("channelId"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
        F.when(F.col("o_orderstatus") == "F", "private").when(F.col("o_orderstatus") == "O", "public").alias("privacyStatus"),
        F.when(F.col("o_orderpriority") != "5-LOW", "processed").otherwise("failed").alias("uploadStatus"),
    )


@query("video_row_guards", f"WITH {VIDEOS} SELECT videoId, status AS channelStatus FROM v WHERE coalesce(privacy, 'public') = 'public' AND upload = 'processed' AND made >= TIMESTAMP '1996-01-01' - INTERVAL 700 DAY AND status <> 'blocked'")
def video_row_guards(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("channel_id"), "c_mktsegment")
    policy = R.policy_rows(c.where("c_mktsegment = 'BUILDING'"), c.where("c_mktsegment = 'MACHINERY'"))
    return A.video_rows(video_table(spark, sf), policy, F.lit("1996-01-01 00:00:00").cast("timestamp"), 700).select("videoId", "channelStatus")


@query("explicit_shorts", "SELECT p_partkey, p_size % 4 IN (0, 2) AS shorts FROM part")
def explicit_shorts(spark: SparkSession, sf: str) -> DataFrame:
    mark = F.col("p_size") % 4
    title = F.concat("p_name", F.when(mark == 0, " #Shorts!").when(mark == 1, " #shortsighted").otherwise(""))
    tags = F.when(mark == 2, F.array(F.lit("a"), F.lit(" #쇼츠 "))).otherwise(F.array(F.lit("short film")))
    return read(spark, sf, "part").select("p_partkey", X.explicit_shorts(title, F.lit("about"), tags).alias("shorts"))


@query(
    "video_formats",
    """SELECT p_partkey, CASE WHEN p_size * 10 > 180 THEN 'regular' WHEN p_size % 2 = 0 THEN 'shorts' WHEN p_size % 3 = 0 THEN 'regular' WHEN p_size % 5 = 0 THEN 'shorts' ELSE 'unknown' END AS format FROM part""",
)
def video_formats(spark: SparkSession, sf: str) -> DataFrame:
    p, n = read(spark, sf, "part"), F.col("p_size")
    rows = p.withColumns({"durationSeconds": n * 10, "explicit": n % 2 == 0, "cached": F.when(n % 3 == 0, "regular"), "probed": F.when(n % 5 == 0, "shorts")})
    return rows.select("p_partkey", C.video_format().alias("format"))


@query("person_keywords", "SELECT n_nationkey, n_nationkey % 4 IN (0, 2) AS person FROM nation")
def person_keywords(spark: SparkSession, sf: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, ("홍길동", "선거 위원", "김 철수", "Anna"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return read(spark, sf, "nation").select("n_nationkey", X.looks_like_person(word).alias("person"))


@query(
    "retention_defaults",
    DI + f""", a AS (SELECT *, CASE WHEN doc_id % 101 = 0 THEN 'blog' ELSE kind END AS st FROM di WHERE doc_id % 79 <> 0 AND to_timestamp(s) AT TIME ZONE 'UTC' >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY),
c AS (SELECT *, CASE WHEN st = 'youtube' THEN 'video' WHEN st = 'official' OR tier IS DISTINCT FROM 'secondary' THEN 'primary' ELSE 'secondary' END AS class FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY s DESC, id) AS n FROM c) SELECT id, class FROM r WHERE n <= CASE class WHEN 'primary' THEN 4000 WHEN 'secondary' THEN 700 ELSE 500 END""",
)
def retention_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return N.retain(document_rows(spark, sf), now(), N.Budgets(), [F.desc(X.feed_millis("publishedAt")), F.asc("id")]).select("id", N.item_class().alias("class"))


# Joins and reports


OBSERVED = "o AS (SELECT l_orderkey AS videoId, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS queries FROM lineitem WHERE l_quantity > 40 GROUP BY 1)"


@query("videos_with_observations", f"WITH {OBSERVED} SELECT o_orderkey AS videoId, o_custkey AS channelId, queries FROM orders JOIN o ON o_orderkey = videoId")
def videos_with_observations(spark: SparkSession, sf: str) -> DataFrame:
    seen = read(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("videoId"), "l_returnflag")
    found = R.with_observations(video_table(spark, sf), R.observed_queries(seen, "videoId", "l_returnflag"))
    return found.select("videoId", "channelId", F.array_join("queries", ",").alias("queries"))


@query("videos_with_format_cache", "SELECT o_orderkey AS videoId, CASE WHEN c_custkey IS NOT NULL THEN 'shorts' END AS classification FROM orders LEFT JOIN customer ON c_custkey = o_orderkey AND c_custkey % 40 <= 30")
def videos_with_format_cache(spark: SparkSession, sf: str) -> DataFrame:
    checked = F.date_format(now() - F.make_dt_interval((F.col("c_custkey") % 40).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    cache = read(spark, sf, "customer").select(F.col("c_custkey").alias("videoId"), F.lit("shorts").alias("classification"), F.lit("x").alias("evidence"), checked.alias("checkedAt"))
    return R.with_format_cache(video_table(spark, sf), cache, now()).select("videoId", "classification")


@query("videos_with_fetched_tags", "SELECT o_orderkey AS videoId, CAST(CASE WHEN c_custkey IS NULL THEN -1 WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS INT) AS n_tags FROM orders LEFT JOIN customer ON c_custkey = o_orderkey")
def videos_with_fetched_tags(spark: SparkSession, sf: str) -> DataFrame:
    fetched = read(spark, sf, "customer").select(F.col("c_custkey").alias("videoId"), F.when(F.col("c_custkey") % 2 == 1, F.array("c_name")).alias("tags"))
    return R.with_fetched_tags(video_table(spark, sf), fetched).select("videoId", F.when(F.col("fetchedTags").isNull(), -1).otherwise(F.size("fetchedTags")).alias("n_tags"))


@query("latest_collection", EV + "SELECT max(collectedAt) AS latest FROM ev")
def latest_collection(spark: SparkSession, sf: str) -> DataFrame:
    collectors = event_items(spark, sf).groupBy("sourceType").agg(F.max("collectedAt").alias("lastCollectedAt"))
    return R.latest_collection(collectors, F.lit("never"))


@query(
    "reclassification_report",
    EV + "SELECT id, CASE WHEN _pos % 7 = 0 THEN 'removed' ELSE 'tier' END AS change, coalesce(relevanceTier, 'primary') AS was, CASE WHEN _pos % 7 <> 0 THEN CASE WHEN relevanceScore >= 20 THEN 'primary' ELSE 'secondary' END END AS now FROM ev WHERE _pos % 7 = 0 OR coalesce(relevanceTier, 'primary') <> CASE WHEN relevanceScore >= 20 THEN 'primary' ELSE 'secondary' END",
)
def reclassification_report(spark: SparkSession, sf: str) -> DataFrame:
    items = event_items(spark, sf)
    after = items.where("_pos % 7 <> 0").withColumn("relevanceTier", F.when(F.col("relevanceScore") >= 20, "primary").otherwise("secondary"))
    return R.reclassification_report(items, after)


@query(
    "restore_report",
    EV + """SELECT (SELECT count(*) FROM ev WHERE _pos % 3 <> 0) AS before, (SELECT count(*) FROM ev WHERE _pos % 3 = 0) AS candidates, (SELECT count(*) FROM ev WHERE _pos % 6 <> 0) AS after,
  count(*) AS restored, min(publishedAt) AS earliest, max(publishedAt) AS latest, count(DISTINCT substring(publishedAt, 1, 10)) AS days FROM ev WHERE _pos % 6 = 3""",
)
def restore_report(spark: SparkSession, sf: str) -> DataFrame:
    items = event_items(spark, sf)
    return R.restore_report(items.where("_pos % 3 <> 0"), items.where("_pos % 3 = 0"), items.where("_pos % 6 <> 0"))


@query(
    "channel_totals",
    "WITH c AS (SELECT c_mktsegment AS m, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment) SELECT count(*) AS channels, CAST(sum(n) AS BIGINT) AS videos, count(*) FILTER (m = 'BUILDING') AS preferred, count(*) FILTER (m NOT IN ('BUILDING', 'MACHINERY')) AS unlisted, count(*) FILTER (m = 'MACHINERY') AS blocked FROM c",
)
def channel_totals(spark: SparkSession, sf: str) -> DataFrame:
    from feedweave.plans.feed import channel_report

    return R.channel_totals(channel_report(spark, sf))


# Validation


@query(
    "item_rules",
    DI + """, v AS (SELECT id, 'publisher' AS rule FROM di WHERE doc_id % 83 = 0 UNION ALL SELECT id, 'source type' FROM di WHERE doc_id % 101 = 0 UNION ALL SELECT id, 'official' FROM di WHERE doc_id % 97 = 0 AND kind <> 'official'
  UNION ALL SELECT id, 'score' FROM di WHERE doc_id % 110 > 100 UNION ALL SELECT id, 'tier' FROM di WHERE tier = 'odd' UNION ALL SELECT id, 'published' FROM di WHERE doc_id % 79 = 0 UNION ALL SELECT id, 'url' FROM di WHERE doc_id % 89 = 0)
SELECT rule, id AS key, '' AS detail FROM v""",
)
def item_rules(spark: SparkSession, sf: str) -> DataFrame:
    return V.item_violations(document_rows(spark, sf))


@query(
    "bundle_rules",
    EV + """, t AS (SELECT count(*) AS n FROM ev) SELECT 'total' AS rule, 'items' AS key, CAST(n AS VARCHAR) AS detail FROM t UNION ALL SELECT 'issue tag', id, tag FROM ev WHERE tag NOT IN ('k1', 'k2') UNION ALL SELECT 'unique person', 'p1', '2' UNION ALL SELECT 'person tag', id, person FROM ev WHERE person NOT IN ('p1', 'p2')""",
)
def bundle_rules(spark: SparkSession, sf: str) -> DataFrame:
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    return V.table_violations(event_items(spark, sf), ids("k1", "k2"), ids("p1", "p2", "p1"), -1)


@query("search_query_rules", "SELECT 'enabled' AS rule, 'queries' AS key, CAST(count(*) AS VARCHAR) AS detail FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'unique query', CAST(c_nationkey AS VARCHAR), CAST(count(*) AS VARCHAR) FROM customer GROUP BY c_nationkey HAVING count(*) > 1")
def search_query_rules(spark: SparkSession, sf: str) -> DataFrame:
    return V.query_violations(read(spark, sf, "customer").select(F.col("c_nationkey").alias("id"), (F.col("c_acctbal") > 0).alias("enabled")))


# Functions


@query("parsed_dates", "SELECT event_id, epoch_ms(date_trunc('second', ts)) AS iso, epoch_ms(date_trunc('second', ts)) AS mail, CAST(NULL AS BIGINT) AS odd FROM events")
def parsed_dates(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    ms = lambda c: F.unix_millis(X.parse_date(c))
    return e.select("event_id", ms(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("iso"), ms(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss '+0000'")).alias("mail"), ms(F.lit("not a date")).alias("odd"))


@query("seoul_dates", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 9 HOUR, '%Y.%m.%d') AS shown FROM orders")
def seoul_dates(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select("o_orderkey", X.seoul_date("o_orderdate").alias("shown"))


@query("summary_and_tags", r"SELECT doc_id, md5(concat_ws(' ', NULLIF(regexp_replace(text, '^\s+|\s+$', '', 'g'), ''), lang, source)) AS joined FROM documents")
def summary_and_tags(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.array(F.concat(F.lit(" "), "lang"), F.lit("  "), F.col("source"))
    return read(spark, sf, "documents").select("doc_id", F.md5(X.join_summary_and_tags("text", tags)).alias("joined"))


@query("inline_text", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))) AS bare FROM documents")
def inline_text(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.md5(X.strip_inline_html("text")).alias("bare"))


@query("folded_contains", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def folded_contains(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").where(X.contains_fold("text", F.lit("LICENSE"))).select("doc_id")


@query("ellipses", r"SELECT doc_id, md5(regexp_replace(text, '\.{2,}|…+', ' ', 'g')) AS plain FROM documents")
def ellipses(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.md5(X.normalize_ellipses("text")).alias("plain"))


@query("summary_leads", "SELECT doc_id, substring(string_split(text, chr(10))[1], 1, 100) AS lead FROM documents")
def summary_leads(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", X.summary_lead(F.split("text", "\n")).alias("lead"))


@query("video_ids", "SELECT p_partkey, 'youtube_' || p_partkey AS id FROM part")
def video_ids(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", X.video_id(F.col("p_partkey").cast("string")).alias("id"))


@query(
    "title_overlap",
    r"""WITH w AS (SELECT doc_id, lower(text) AS t, list_distinct(regexp_extract_all(lower(source || ' ' || lang), '[\p{L}\p{N}]+')) AS words, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n FROM documents),
o AS (SELECT *, len(list_filter(words, lambda x: contains(t, x))) / CAST(len(words) AS DOUBLE) AS ratio FROM w) SELECT doc_id, round(ratio, 6) AS ratio, round(0.4 + 0.3 * ratio + 0.3 * least(n / 120.0, 1.0), 6) AS completeness FROM o""",
)
def title_overlap(spark: SparkSession, sf: str) -> DataFrame:
    title = F.concat_ws(" ", "source", "lang")
    return read(spark, sf, "documents").select("doc_id", F.round(X.title_overlap_ratio(title, "text"), 6).alias("ratio"), F.round(X.completeness(title, "text"), 6).alias("completeness"))


# Classification

_RULES = A.Rules(strong=("license",), high_interest=("idiot", "stupid", "version"), labels={"idiot": "an insult"})
_ISSUES = [A.Issue("terms", ("apache", "warranty")), A.Issue("law", ("law",), excluded=("license",))]
_PEOPLE = [A.Person("p", "Moron", ("moron",))]


@query(
    "classified_documents",
    """WITH t AS (SELECT doc_id, lower(text) AS t FROM documents),
h AS (SELECT doc_id, contains(t, 'license') AS org, contains(t, 'apache') OR contains(t, 'warranty') AS terms, contains(t, 'moron') AS person, contains(t, 'idiot') AS idiot,
  CAST(contains(t, 'idiot') AS INT) + CAST(contains(t, 'stupid') AS INT) + CAST(contains(t, 'version') AS INT) AS high FROM t)
SELECT doc_id, CAST(6 * org::INT + 4 * terms::INT + 3 * person::INT + 2 * least(2, high) AS INT) AS score, terms, person, idiot AS labelled FROM h""",
)
def classified_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select("doc_id", F.lit("").alias("title"), F.col("text").alias("summary"), F.lit(False).alias("isOfficial"))
    got = A.classified(rows, lambda: A.Classifier(_RULES, [_ISSUES[0]], _PEOPLE)).select("doc_id", "classification.*")
    return got.select("doc_id", F.col("relevanceScore").alias("score"), F.array_contains("issueTags", "terms").alias("terms"), F.array_contains("personTags", "p").alias("person"), F.array_contains("labels", "an insult").alias("labelled"))


@query(
    "scoped_classification",
    """WITH t AS (SELECT doc_id, lower(source) AS a, lower(text) AS b FROM documents)
SELECT doc_id, contains(b, 'apache') OR contains(b, 'warranty') AS terms, contains(b, 'moron') AS person, CAST(0 AS INT) AS title_words,
  CAST(6 * contains(b, 'license')::INT + 4 * (contains(b, 'apache') OR contains(b, 'warranty'))::INT + 3 * contains(b, 'moron')::INT + 2 * least(2, contains(b, 'idiot')::INT + contains(b, 'stupid')::INT + contains(b, 'version')::INT) AS INT) AS score FROM t""",
)
def scoped_classification(spark: SparkSession, sf: str) -> DataFrame:
    """What the classifier finds in documents under the name of their source, seen by one field."""
    rows = read(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("summary"), F.lit(True).alias("isOfficial"))
    got = A.classified(rows, lambda: A.Classifier(_RULES, [_ISSUES[0]], _PEOPLE))
    title, summary = A.scoped("classification", "title"), A.scoped("classification", "summary")
    return got.select("doc_id", F.array_contains(summary["issueTags"], "terms").alias("terms"), F.array_contains(summary["personTags"], "p").alias("person"), F.size(title["matchedKeywords"]).alias("title_words"), summary["relevanceScore"].alias("score"))


# Pages, sources and sinks


@query("source_link_page", DI + "SELECT id, s * 1000 AS published_ms, CAST((SELECT count(*) FROM di WHERE doc_id % 7 = 3) AS BIGINT) AS total FROM di WHERE doc_id % 7 = 3 AND doc_id % 79 <> 0 ORDER BY s DESC LIMIT 25")
def source_link_page(spark: SparkSession, sf: str) -> DataFrame:
    page = G.source_link_page(document_rows(spark, sf), I.Filters(scope="all", issue="k3"), I.Page(0, 25))
    return page.rows.select("id", "published_ms").withColumn("total", F.lit(page.total).cast("long"))


@query("sitemap", "SELECT 'https://x.example/about' AS url, CAST(NULL AS VARCHAR) AS modified UNION ALL SELECT 'https://x.example/issues/' || n_nationkey, n_name FROM nation UNION ALL SELECT 'https://x.example/people/' || r_regionkey, r_name FROM region")
def sitemap(spark: SparkSession, sf: str) -> DataFrame:
    issues = read(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("latest"))
    people = read(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("latest"))
    return P.sitemap("https://x.example", ["/about"], issues, people)


@query("versions_round_trip", DI + "SELECT CASE WHEN doc_id % 79 <> 0 THEN substring(iso, 1, 10) END AS shard_date, count(*) AS n, CAST(sum(doc_id % 110) AS BIGINT) AS score FROM di GROUP BY 1")
def versions_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Items written twice as versions by day, and the current version read again."""
    root = f"{shared_folder(spark)}/items"
    items = document_rows(spark, sf)
    P.write_shards(items.where("relevanceScore < 50"), root)
    P.write_shards(items, root)
    rows = P.read_versions(spark, root).withColumn("shard_date", F.when(F.col("shard_date") != "__HIVE_DEFAULT_PARTITION__", F.col("shard_date")))
    return rows.groupBy("shard_date").agg(F.count("*").alias("n"), F.sum("relevanceScore").alias("score"))


@query(
    "history_scan",
    DI + """, v AS (SELECT 1 AS version, id, iso, doc_id % 79 = 0 AS undated, doc_id, 0 AS score FROM di WHERE doc_id % 3 = 0
UNION ALL SELECT 2, id, iso, doc_id % 79 = 0, doc_id, 10 FROM di WHERE doc_id % 2 = 0 AND doc_id % 600 < 300 UNION ALL SELECT 2, id, iso, doc_id % 79 = 0, doc_id, 0 FROM di WHERE doc_id % 3 = 0 AND doc_id % 600 >= 300
UNION ALL SELECT 3, id, iso, doc_id % 79 = 0, doc_id, 0 FROM di WHERE doc_id % 3 = 0 AND doc_id % 600 >= 300),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY undated, version DESC) AS n FROM v) SELECT id, CAST(score AS INT) AS score FROM r WHERE n = 1""",
)
def history_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Three versions of the documents as items: the second changes some days, the third drops those."""
    root, n = f"{shared_folder(spark)}/items", F.substring("id", 2, 20).cast("long")
    items, early = document_rows(spark, sf).withColumn("relevanceScore", F.lit(0)), n % 600 < 300
    third = items.where(n % 3 == 0)
    P.write_shards(third, root)
    P.write_shards(items.where((n % 2 == 0) & early).withColumn("relevanceScore", F.lit(10)).unionByName(third.where(~early)), root)
    P.write_shards(third.where(~early), root)
    return P.first_seen(spark, root).select("id", F.col("relevanceScore").alias("score"))


@query(
    "landed_news",
    r"""SELECT source AS query, trim(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS title, 'https://example.com/' || doc_id AS original, 1700000000000 + doc_id * 600000 AS published FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 11 <> 0""",
)
def landed_news(spark: SparkSession, sf: str) -> DataFrame:
    """Search responses written as landed JSON lines and read again; some rows lack a field."""
    folder, n = f"{shared_folder(spark)}/news", F.col("doc_id")
    when = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + n * 600), "EEE, dd MMM yyyy HH:mm:ss '+0000'")
    row = F.struct(F.col("text").alias("title"), F.lit("").alias("originallink"), F.concat(F.lit("https://example.com/"), n).alias("link"), F.when(n % 5 != 0, F.col("source")).alias("description"), F.when(n % 11 != 0, when).alias("pubDate"))
    read(spark, sf, "documents").select(F.to_json(F.struct(F.col("source").alias("query"), F.array(row).alias("items"))).alias("value")).write.text(folder)
    return C.read_news(spark, folder).select("query", "title", "original", F.unix_millis("published").alias("published"))

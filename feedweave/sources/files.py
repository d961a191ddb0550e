"""Items by day, dimension files and versioned snapshots."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from feedweave.operators.items import ITEM, public_items

_S, _L = T.StringType(), T.ArrayType(T.StringType())


def _struct(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in types.items()])


PERSON = _struct(id=_S, name=_S, aliases=_L, role=_S, keywords=_L, contextKeywords=_L, searchQueries=_L, priority=T.IntegerType(), published=T.BooleanType())
ISSUE = _struct(id=_S, name=_S, description=_S, keywords=_L, searchQueries=_L, requiredKeywordGroups=T.ArrayType(_L), contextKeywords=_L, excludedKeywords=_L, priority=T.IntegerType())
SOURCE = _struct(id=_S, name=_S, type=_S, url=_S, enabled=T.BooleanType())
SEARCH_QUERY = _struct(id=_S, query=_S, enabled=T.BooleanType())
CLUSTER = _struct(id=_S, seedItemId=_S, memberIds=_L)
NEWS_ROW = _struct(title=_S, originallink=_S, link=_S, description=_S, pubDate=_S)


def shard_date(published: Column | str = "publishedAt") -> Column:
    """The day of an item: the first ten characters of its time as written; null if they
    are no date."""
    day = F.substring(F.col(published) if isinstance(published, str) else published, 1, 10)
    return F.when(F.regexp_like(day, F.lit(r"^\d{4}-\d{2}-\d{2}$")), day)


def read_json(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """JSON files of a path or pattern with a schema; no rows where there are no files."""
    try:
        return spark.read.schema(schema).option("multiLine", not lines).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Items of the files YYYY-MM-DD.json of a folder; other files are left alone."""
    return read_json(spark, f"{folder}/[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9].json", ITEM)


def write_shards(items: DataFrame, root: str, stories: DataFrame | None = None) -> str:
    """Items by day as Parquet in a new version folder of `root`, beside it their stories,
    and then one pointer to both.  Days without items are gone with the old version; readers
    of that aren't disturbed, and a step that fails leaves it the current one.  A day is
    one file, and several where its rows are too many for a task."""
    path = f"{root}/v-{time.time_ns():020d}"
    items.withColumn("shard_date", shard_date()).hint("rebalance", "shard_date").write.partitionBy("shard_date").parquet(path)
    if stories is not None:
        stories.write.parquet(f"{path}-stories")
    schema = T.StructType([*items.schema.fields, T.StructField("shard_date", T.StringType())])
    _digests(items.sparkSession.read.schema(schema).parquet(path), path).write.parquet(f"{path}-digests")
    _replace(items.sparkSession, f"{root}/current.json", {"path": path, "stories": f"{path}-stories" if stories is not None else None})
    return path


class LostPointer(OSError):
    """Versions without a pointer to the current one."""


def _current(spark: SparkSession, root: str) -> dict | None:
    """What the pointer says; None where nothing was ever written."""
    pointer = read_text(spark, f"{root}/current.json")
    if pointer is not None:
        return json.loads(pointer)
    fs, folder = _path(spark, root)
    # the first version may be on its way, but one that another came after has been current
    if fs.exists(folder) and sum(s.isDirectory() and s.getPath().getName().startswith("v-") and "-" not in s.getPath().getName()[2:] for s in fs.listStatus(folder)) > 1:
        raise LostPointer(f"{root} has versions and no current.json")
    return None


def read_versions(spark: SparkSession, root: str) -> DataFrame:
    """The current version of what `write_shards` wrote; no rows where nothing was written.
    Versions without a pointer raise LostPointer."""
    schema = T.StructType([*ITEM.fields, T.StructField("shard_date", T.StringType())])
    now = _current(spark, root)
    return spark.createDataFrame([], schema) if now is None else spark.read.schema(schema).parquet(now["path"])


def read_stories(spark: SparkSession, root: str) -> DataFrame:
    """The stories of the current version; no rows where it has none."""
    now = _current(spark, root)
    return spark.createDataFrame([], CLUSTER) if now is None or not now.get("stories") else spark.read.schema(CLUSTER).parquet(now["stories"])


def drop_old_versions(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete all but the `keep` newest versions, the current one in any case not; their names."""
    now = _current(spark, root)
    fs, folder = _path(spark, root)
    if now is None:
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory() and s.getPath().getName().startswith("v-"))
    version = lambda name: "-".join(name.split("-")[:2])
    versions = sorted({version(n) for n in names})
    gone = [v for v in versions[: -keep if keep else None] if not now["path"].endswith(v)]
    for name in names:
        if version(name) in gone:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, name), True)
    return gone


def _digests(rows: DataFrame, path: str) -> DataFrame:
    """(version, shard_date, n, digest) of the rows of a version: equal for days that hold the same rows."""
    row = F.xxhash64(*(c for c in sorted(rows.columns) if c != "shard_date"))
    by_day = rows.groupBy(F.col("shard_date").cast("string").alias("shard_date")).agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("digest"))
    return by_day.select(F.lit(path.rsplit("/", 1)[-1]).alias("version"), "shard_date", "n", "digest")


def history(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all versions that are there, with `version` and `shard_date`, each content of a day once:
    that of the newest version that holds it.  A day that didn't change is read from one version only.

    The folders to read are listed on the driver: a row a distinct content of a day.
    """
    schema = T.StructType([*ITEM.fields, T.StructField("shard_date", T.StringType()), T.StructField("version", T.StringType())])
    fs, folder = _path(spark, root)
    names = {s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()} if fs.exists(folder) else set()
    versions = sorted(n for n in names if n.startswith("v-") and "-" not in n[2:])
    if not versions:
        return spark.createDataFrame([], schema)
    plain = T.StructType(schema.fields[:-1])
    read = lambda v: spark.read.schema(plain).parquet(f"{root}/{v}")
    known = [f"{root}/{v}-digests" for v in versions if f"{v}-digests" in names]
    digests = [spark.read.parquet(*known)] if known else []
    digests += [_digests(read(v), v) for v in versions if f"{v}-digests" not in names]
    every = digests[0]
    for more in digests[1:]:
        every = every.unionByName(more)
    wanted: dict[str, list[str | None]] = {}
    for r in every.groupBy("shard_date", "n", "digest").agg(F.max("version").alias("version")).select("version", "shard_date").distinct().collect():
        wanted.setdefault(r["version"], []).append(r["shard_date"])
    out = None
    for v, days in sorted(wanted.items()):
        named = F.col("shard_date").isin([d for d in days if d is not None])
        rows = read(v).where(named | F.col("shard_date").isNull() if None in days else named).withColumn("version", F.lit(v))
        out = rows if out is None else out.unionByName(rows)
    return out


def first_seen(spark: SparkSession, root: str) -> DataFrame:
    """The items that any version held, each as its first day has it, and of that day the newest content."""
    return from_history(history(spark, root), [F.asc_nulls_last("shard_date"), F.desc("version")])


def from_history(versions: DataFrame, order: list[Column]) -> DataFrame:
    """The first row of each id in an order, over versions of all shards."""
    from feedweave.operators.items import top_per_group

    return top_per_group(versions, ["id"], order, 1, "_n").drop("_n")


# Small files through Hadoop's file systems, so that any store Spark reads will do


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> bool:
    """Write beside the place and rename, so that readers see all or nothing.  With
    replace false an existing file stays; says whether it wrote."""
    jvm = spark.sparkContext._jvm
    fs, p = _path(spark, path)
    if not replace and fs.exists(p):
        return False
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{time.time_ns()}.tmp")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE if replace else jvm.org.apache.hadoop.fs.Options.Rename.NONE
    # one step of the file system: a reader finds the old file or the new one
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(p), options)
    return True


def _replace(spark: SparkSession, path: str, value: dict) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False))


def write_local(path: str, text: str) -> None:
    """Atomic write of a file of the driver's own."""
    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(path) or ".", delete=False, encoding="utf-8") as f:
        f.write(text)
    os.replace(f.name, path)


# Snapshots


class BadSnapshot(ValueError):
    """A snapshot that isn't what its manifest says."""


def serialize(items: DataFrame, tables: dict[str, list[dict]], collected_at: str) -> tuple[str, dict]:
    """Body and manifest of a published snapshot: public items in order of id, and tables.

    A snapshot is one file that clients load whole, so its items are within the retention
    budgets; larger tables are written with `write_shards`.
    """
    rows = [json.loads(r["j"]) for r in public_items(items).orderBy("id").select(F.to_json(F.struct("*")).alias("j")).collect()]
    body = json.dumps({"items": rows, **tables, "collectedAt": collected_at}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    digest = hashlib.sha256(body.encode()).hexdigest()
    return body, {"version": 1, "objectKey": f"snapshots/{digest}.json", "collectedAt": collected_at, "sha256": digest, "byteLength": len(body.encode())}


def parse(body: str, manifest: dict) -> dict:
    """The snapshot of a body, whose key, length, checksum, parts and time must be right."""
    raw = body.encode()
    digest = hashlib.sha256(raw).hexdigest()
    if manifest.get("version") != 1 or manifest.get("objectKey") != f"snapshots/{manifest.get('sha256')}.json":
        raise BadSnapshot("the manifest's key isn't that of its checksum")
    if len(raw) != manifest["byteLength"]:
        raise BadSnapshot(f"{len(raw)} bytes, not {manifest['byteLength']}")
    if digest != manifest["sha256"]:
        raise BadSnapshot("the checksum is another")
    value = json.loads(body)
    if not isinstance(value, dict) or not isinstance(value.get("items"), list):
        raise BadSnapshot("there are no items")
    if value.get("collectedAt") != manifest["collectedAt"]:
        raise BadSnapshot("the collection time is another")
    return value


def publish(spark: SparkSession, root: str, body: str, manifest: dict) -> None:
    """Put the immutable snapshot, read it again, and only then point to it."""
    place = f"{root}/{manifest['objectKey']}"
    write_text(spark, place, body, replace=False)
    parse(read_text(spark, place) or "", manifest)
    _replace(spark, f"{root}/current.json", manifest)


@dataclass
class SnapshotLoader:
    """The current snapshot, kept for `ttl` seconds; a failed refresh keeps the old one and
    is tried again after `retry` seconds.  Without any snapshot the failure is raised.  Of
    callers at the same time one refreshes: others get the old one, or wait for the first."""

    spark: SparkSession
    root: str
    ttl: float = 60.0
    retry: float = 30.0
    clock: Callable[[], float] = time.monotonic
    value: dict | None = None
    manifest: dict | None = None
    stale: bool = False
    _due: float = field(default=float("-inf"))
    _one: threading.Lock = field(default_factory=threading.Lock)

    def get(self) -> dict:
        if self.value is None or self.clock() >= self._due:
            if self._one.acquire(blocking=self.value is None):
                try:
                    if self.value is None or self.clock() >= self._due:
                        self._refresh()
                finally:
                    self._one.release()
        return self.value

    def _refresh(self) -> None:
        try:
            text = read_text(self.spark, f"{self.root}/current.json")
            if text is None:
                raise BadSnapshot("nothing is published")
            manifest = json.loads(text)
            if manifest != self.manifest:
                body = read_text(self.spark, f"{self.root}/{manifest['objectKey']}")
                if body is None:
                    raise BadSnapshot(f"{manifest['objectKey']} is missing")
                self.value, self.manifest = parse(body, manifest), manifest
            self.stale, self._due = False, self.clock() + self.ttl
        except Exception:
            if self.value is None:
                raise
            self.stale, self._due = True, self.clock() + min(self.retry, self.ttl)


def load_items(spark: SparkSession, folder: str | None = None, loader: SnapshotLoader | None = None) -> DataFrame:
    """Items of the published snapshot if there is a loader, else of a folder of day files."""
    if loader is not None:
        return spark.createDataFrame([json.dumps(i) for i in loader.get()["items"]], T.StringType()).select(F.from_json("value", ITEM).alias("i")).select("i.*")
    if folder is None:
        raise ValueError("neither a folder nor a loader")
    return read_shards(spark, folder)


def revision(items: DataFrame, stories: DataFrame | None = None) -> DataFrame:
    """One row: a hash of what the feed shows of all items, and of their stories if given,
    whatever the order of rows.

    The rows' hashes are added up as numbers, so no task holds them all.
    """
    from feedweave.operators.items import REVISION

    def sums(rows: DataFrame) -> DataFrame:
        h = F.sha2(F.to_json(F.struct("*")), 256)
        part = lambda i: F.conv(F.substring(h, i, 15), 16, 10).cast("decimal(38,0)")
        added = rows.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(part(i)), F.lit(0)).alias(f"s{i}") for i in (1, 16, 31, 46)))
        return added.select(F.sha2(F.concat_ws(":", "n", "s1", "s16", "s31", "s46"), 256).alias("revision"))

    shown = sums(items.select([c for c in REVISION if c in items.columns]))
    if stories is None:
        return shown
    both = shown.crossJoin(sums(stories.select("id", "seedItemId", "memberIds")).withColumnRenamed("revision", "of_stories"))  # one row each
    return both.select(F.sha2(F.concat_ws(":", "revision", "of_stories"), 256).alias("revision"))


# Feeds for readers and crawlers


def rss_items(items: DataFrame, limit: int = 50) -> DataFrame:
    """(rank, xml) of the newest items."""
    from feedweave.functions.text import feed_millis, xml_escape
    from feedweave.operators.items import top_per_group

    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), xml_escape(c), F.lit(f"</{name}>"))
    xml = F.concat(F.lit("<item>"), tag("title", "title"), tag("link", "url"), tag("description", "summary"), tag("guid", "id"), F.lit("</item>"))
    newest = items.withColumn("_ms", feed_millis("publishedAt")).orderBy(F.desc("_ms"), "id").limit(limit).withColumn("_g", F.lit(0))
    return top_per_group(newest, ["_g"], [F.desc("_ms"), F.asc("id")], limit).select("rank", xml.alias("xml"))


def rss(items: DataFrame, title: str, link: str, limit: int = 50) -> str:
    from html import escape

    rows = rss_items(items, limit).orderBy("rank").collect()
    return f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{escape(title)}</title><link>{escape(link)}</link>{"".join(r["xml"] for r in rows)}</channel></rss>'


def sitemap(base: str, pages: list[str], issues: DataFrame, people: DataFrame) -> DataFrame:
    """(url, modified) of fixed pages and of issues and people (id, latest)."""
    spark = issues.sparkSession
    fixed = spark.createDataFrame([(f"{base}{p}", None) for p in pages], "url string, modified string")
    of = lambda d, name: d.select(F.concat(F.lit(f"{base}/{name}/"), "id").alias("url"), F.col("latest").cast("string").alias("modified"))
    return fixed.unionByName(of(issues, "issues")).unionByName(of(people, "people"))
